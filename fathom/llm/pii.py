"""Personal data and the terms that give it away, with DataFrame functions only.

Base kinds are found by patterns. The information-theoretic part then asks the corpus how
strongly a word reveals an entity that the patterns found. An entity's information content is
-log2 of the share of documents that hold it; what a word tells of it is their pointwise mutual
information, from the documents that hold both, anywhere in their texts outside personal data. A
word that tells at least the share ``DISCLOSURE`` of an entity's information and leaves no more
than ``LEFT_BITS`` of it open, in at least ``SUPPORT`` different texts, is a span of kind ``term``
in every document that holds it.

Every pattern is written so that Java's matcher neither recurses nor restarts inside a run of
characters that has already failed, so very long texts cost linear time; the matches are those
of the plain pattern (``\\G`` admits a start right behind the match before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, stored

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word is a run of two or more letters, marks and digits; two or three Han characters in a row are words as well.
WORD = r"[\p{L}\p{M}\p{N}]{2,}"
HAN = r"(?=(\p{IsHan}{%d}))"
#: What cannot be next to a term: scripts that do not part words have no such bound.
BOUND = r"[[\p{L}\p{M}\p{N}]&&[^\p{IsHan}]]"
SUPPORT, DISCLOSURE, LEFT_BITS = 3, 0.75, 1.0
#: Disclosing terms, and documents with some, of at most so many rows are broadcast.
BROADCAST_ROWS = 50_000
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, pattern: Column, found: Column) -> Column:
    """Structs (start, end, value) of the matches ``found`` of a pattern; starts in code points."""
    step = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc, x):
        begin, end = start(acc, x), start(acc, x) + F.length(x["value"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out")))

    return F.when(F.size(found) > 0, F.aggregate(step, empty, add, lambda acc: acc["out"])).otherwise(F.array().cast(_SPANS))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        def weighed(i):
            d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
            doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return F.when(i % 2 == 0, doubled).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weighed(i))
        return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(False)
    return F.lit(True)


def _test(kind: str):
    return lambda x: _valid(kind, x["value"])


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``email``, ``ip``, ``card`` and ``phone``: arrays of (start, end, value).

    A null text is an empty one. Matches are leftmost and do not overlap within a kind; those
    that fail the kind's further test are dropped without another try.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = {k: fresh([*df.columns, *PATTERNS], f"matches_{k}") for k in PATTERNS}
    found = df.withColumns({own[k]: F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    spans = {k: F.filter(_matches(whole, F.lit(p), F.col(own[k])), _test(k)) for k, p in PATTERNS.items()}
    return found.withColumns(spans).drop(*own.values())


def _named(kind: str):
    return lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x["value"]).alias("entity"), x["start"].alias("start"), x["end"].alias("end"))


def _outside(text: Column, spans: Column) -> Column:
    """``text`` with a space for each of the spans, which are sorted by their starts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, x):
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(" "))).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _words(text: Column) -> Column:
    found = lambda p, group=0: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    han = F.concat(found(WORD), found(HAN % 2, 1), found(HAN % 3, 1))
    return F.array_distinct(F.when(text.rlike(r"\p{IsHan}{2}"), han).otherwise(found(WORD)))


def _vocabulary(plain: DataFrame) -> DataFrame:
    """One row for each row of ``plain``: key, hash of the text, its entities, its words outside them."""
    spans = F.array_sort(F.flatten(F.array(*(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in PATTERNS))))
    entities = F.flatten(F.array(*(F.transform(k, _named(k)) for k in PATTERNS)))
    based = base_spans(plain).withColumn("_spans", spans)
    return based.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("copy"), F.array_distinct(F.transform(entities, lambda x: x["entity"])).alias("entities"), _words(F.lower(_outside(F.col("text"), F.col("_spans")))).alias("words"))


def disclosing_terms(rows: DataFrame) -> DataFrame | None:
    """``entity, term, content, told``: terms that give an entity away, and bits; None if there are none.

    ``rows`` is a table of :func:`_vocabulary`. Equal texts are counted together first, so that
    copies of one document do not support a term and a frequent entity is no large group; shares
    are over documents. A term that cannot be within LEFT_BITS of any entity goes before its pairs
    are joined. An entity that all documents hold has no content, and nothing tells of it.
    """
    texts = rows.where("size(entities) > 0").groupBy("copy").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("copies"))
    texts = stored(texts, "pii-texts")
    pairs = texts.select(F.explode("entities").alias("entity"), "words", "copies").select("entity", F.explode("words").alias("term"), "copies")
    counted = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("both"))
    supported = stored(counted.where(F.col("texts") >= SUPPORT).drop("texts"), "pii-supported")
    best = supported.groupBy("term").agg(F.max("both").alias("most"))
    counts = rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("in_all"))
    terms = stored(best.join(counts, "term").where(F.col("most") >= 2**-LEFT_BITS * F.col("in_all")).select("term", "in_all"), "pii-terms")
    entities = texts.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("holders"))
    all_rows = F.lit(rows.count())
    content, told = F.log2(all_rows / F.col("holders")), F.log2(F.col("both") * all_rows / (F.col("holders") * F.col("in_all")))
    # What a term leaves open is -log2 of the entity's share of the term's documents: compared without logarithms.
    near = supported.join(terms, "term").where(F.col("both") >= 2**-LEFT_BITS * F.col("in_all"))
    measured = near.join(entities, "entity").select("entity", "term", content.alias("content"), told.alias("told"))
    out = stored(measured.where((F.col("content") > 0) & (F.col("told") >= DISCLOSURE * F.col("content"))), "pii-disclosing")
    discard(texts, supported, terms)
    return out if out.limit(1).count() else None


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the base kinds' arrays and ``term``, an array of (start, end, value) as well.

    A null text is an empty one. Terms are marked in every row that holds them, with or without
    the entity they disclose, and whatever its doc_id, null ones too. Repeated rows stay, and of
    copies of a text one supports a term. Spans that start alike are in the order of the kinds.
    An empty table gives an empty table. Columns of ``df`` with the names of the results are
    replaced, all others stay, whatever their names. Very long texts cost linear time.
    """
    docs = df.drop(*KINDS)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stored(_vocabulary(plain), "pii-words")
    found = disclosing_terms(rows)
    based = base_spans(docs, text)
    if found is None:
        discard(rows)
        return based.withColumn("term", F.array().cast(_SPANS))
    terms = stored(found.select("term").distinct(), "pii-marked")
    held = rows.select("key", F.explode("words").alias("term")).join(_small(terms), "term").select("key", "term")
    longest = lambda a, b: F.length(b) - F.length(a)
    row, listed_, pattern, matches = (fresh(based.columns, n) for n in ("row", "terms", "pattern", "matches"))
    own = stored(held.groupBy(F.col("key").alias(row)).agg(F.array_sort(F.collect_set("term"), longest).alias(listed_)), "pii-own-terms")
    discard(rows, found, terms)
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = based.join(_small(own), F.xxhash64(F.col(doc_id), whole) == F.col(row), "left")
    joined = joined.withColumn(pattern, F.concat(F.lit(f"(?iu)(?<!{BOUND})(?:"), F.array_join(listed_, "|"), F.lit(f")(?!{BOUND})")))
    joined = joined.withColumn(matches, F.when(F.col(listed_).isNotNull(), F.regexp_extract_all(whole, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    return joined.withColumn("term", _matches(whole, F.col(pattern), F.col(matches))).drop(row, listed_, pattern, matches)


def _placed(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("n"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _ordered(kinds: tuple[str, ...]) -> Column:
    """All spans of some kinds as (start, number of the kind, end, kind), in this order."""
    return F.array_sort(F.flatten(F.array(*(F.transform(k, _placed(k)) for k in kinds))))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans by start, then kind, joined by commas."""
    return F.array_join(F.transform(_ordered(kinds), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` of :func:`find` with each span generalised to its kind, as ``[EMAIL]``.

    Overlapping spans become one, named after the first; a null text stays null.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, x):
        after = F.greatest(acc["at"], x["end"])
        gap = F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(after.alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(_ordered(KINDS), start, put, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    touched = F.size(F.flatten(F.array(*(F.col(k) for k in KINDS)))) > 0
    return found.withColumn(text, F.when(F.col(text).isNotNull() & touched, done).otherwise(F.col(text)))
