"""Licence scan by canonical digests, with DataFrame functions only.

A unit of text is normalised, digested and hash-joined as a whole to the digests of known licence
texts and notices. Units are the whole text, each of its lines, and each run of words, over line
and sentence ends, that starts with the first words of a known one and has as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and short licence texts by SPDX identifier; any line or text that normalises to one is it.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "This work is licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
#: SPDX identifier, digest, number of words and first words of full licence texts and standard headers.
TEXTS = (
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c", 163, "permission is hereby"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164", 165, "mit license permission"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127", 167, "the mit license"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2", 217, "redistribution and use"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15", 221, "bsd 3 clause"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30", 186, "redistribution and use"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2", 190, "bsd 2 clause"),
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100", 1571, "apache license version"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", 2965, "gnu general public"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f", 5662, "gnu general public"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", 4366, "gnu lesser general"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 1231, "gnu lesser general"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", 2414, "mozilla public license"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 1088, "creative commons legal"),
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7", 86, "licensed under the"),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca", 1400, "apache license version"),
    ("GPL-2.0", "37e7211948f14e106c4faf02ad2a5868bcdf3a9c934f62a7feeaf7fd9981a89c", 80, "this program is"),
    ("GPL-3.0", "d95501c20fae0a7abb0b3e71517e31fed2aa55d89fdce61d7178ab1720af4bd5", 80, "this program is"),
)
#: So many first words of a known text are looked for, fewer if it has fewer.
HEAD = 3
#: Spellings that count as equal, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
    ("organisation", "organization"), ("favour", "favor"), ("analogue", "analog"), ("non-commercial", "noncommercial"), ("https:", "http:"),
)
#: Lines that only say whose work it is.
COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"


def normalised(text: Column) -> Column:
    """Canonical form: ASCII lower case words without punctuation and copyright lines."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known(spark) -> DataFrame:
    """``license, _digest, words, head``: the fixed notices and texts above, one row for each digest."""
    rows = spark.createDataFrame(list(KNOWN), "license string, notice string").withColumn("w", F.split(normalised(F.col("notice")), " "))
    notices = rows.select("license", digest(F.col("notice")).alias("_digest"), F.size("w").alias("words"), F.concat_ws(" ", F.slice("w", 1, HEAD)).alias("head"))
    texts = spark.createDataFrame(list(TEXTS), "license string, _digest string, words int, head string")
    return notices.union(texts).groupBy("_digest").agg(F.min("license").alias("license"), F.first("words").alias("words"), F.first("head").alias("head"))


def _passages(rows: DataFrame, listed: list) -> DataFrame:
    """``doc_id, _digest`` of the runs of words that start and are as long as a known text."""
    heads = sorted({r.head for r in listed if r.head})
    if not heads:
        return rows.select("doc_id", F.lit(None).cast("string").alias("_digest")).where("false")
    lengths = {h: sorted({r.words for r in listed if r.head == h}) for h in heads}
    begins = rows.select("doc_id", normalised(F.col("text")).alias("_norm")).where(F.col("_norm").rlike("(?:^| )(?:" + "|".join(heads) + ")(?: |$)"))
    words = begins.select("doc_id", F.split("_norm", " ").alias("w"))
    first = sorted({h.split(" ")[0] for h in heads})
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.get("w", i - 1).isin(first))
    of = F.create_map(*(F.lit(x) for h in heads for x in (h, h.count(" ") + 1)))
    sizes = F.create_map(*(c for h in heads for c in (F.lit(h), F.array(*map(F.lit, lengths[h])))))
    text = lambda i, n: F.concat_ws(" ", F.slice("w", i, n))
    counts = sorted({h.count(" ") + 1 for h in heads})
    fits = F.flatten(F.transform(starts, lambda i: F.filter(F.array(*(F.struct(i.alias("i"), text(i, n).alias("head")) for n in counts)), lambda x: of[x["head"]].isNotNull())))
    runs = F.flatten(F.transform(fits, lambda x: F.transform(sizes[x["head"]], lambda n: F.sha2(text(x["i"], n), 256))))
    return words.select("doc_id", F.explode(F.array_distinct(runs)).alias("_digest"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_digest, text_license, licenses`` for each row of ``df``.

    ``text_license`` is the licence that the whole text is, ``licenses`` the sorted distinct ones
    of its whole text, lines and runs of words, joined by commas ('' if none). A null text is an
    empty one and no licence. Rows with equal doc_id share ``licenses``; a null doc_id has those of
    its whole text only. Of licences with one digest the first by name is it. Repeated rows stay,
    very long texts are read in full, an empty table gives an empty table. Only the two columns
    are read, so others may have any names. ``digests``, a table like :func:`known`, replaces the fixed list; it is broadcast,
    and texts are never shuffled.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    full = (known(spark) if digests is None else digests).select("license", "_digest", "words", "head")
    listed = full.collect()
    table = F.broadcast(spark.createDataFrame(listed, full.schema).select("_digest", "license"))
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("[A-Za-z0-9]"))
    units = lines.select("doc_id", digest(F.col("line")).alias("_digest")).union(_passages(rows, listed))
    hits = units.join(table, "_digest")
    of_lines = hits.groupBy("doc_id").agg(F.collect_set("license").alias("_lines"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("text_digest")).join(table.withColumnRenamed("license", "text_license"), F.col("text_digest") == F.col("_digest"), "left")
    both = whole.join(of_lines, "doc_id", "left")
    found = F.array_union(F.coalesce("_lines", F.array().cast("array<string>")), F.when(F.col("text_license").isNotNull(), F.array("text_license")).otherwise(F.array().cast("array<string>")))
    return both.select("doc_id", "text_digest", "text_license", F.array_join(F.array_sort(found), ",").alias("licenses"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""

    def norm(column: str) -> str:
        out = f"regexp_replace(lower({column}), {_quoted(COPYRIGHT)}, '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
        return f"sha256(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')))"

    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)
    return f"""
    WITH notices(license, notice) AS (VALUES {values}),
    known AS (SELECT {norm('notice')} AS d, min(license) AS license FROM notices GROUP BY 1),
    docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    hits AS (SELECT doc_id, license FROM (SELECT doc_id, {norm('line')} AS d FROM lines WHERE regexp_matches(line, '[A-Za-z0-9]')) JOIN known USING (d)),
    whole AS (SELECT doc_id, {norm('text')} AS text_digest FROM docs),
    units AS (SELECT doc_id, license FROM hits UNION SELECT doc_id, license FROM whole JOIN known ON d = text_digest),
    named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM units GROUP BY 1)
    SELECT w.doc_id, w.text_digest, k.license AS text_license, coalesce(n.licenses, '') AS licenses
    FROM whole w LEFT JOIN known k ON k.d = w.text_digest LEFT JOIN named n ON n.doc_id = w.doc_id"""
