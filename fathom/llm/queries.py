"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, langid, lattice, licenses, pii, token_files, toxicity, warc

END_ID = 2
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(made.drop("text"))


def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = pii.KINDS[:4]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return pii.find(docs).select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(pii.KINDS).alias("spans"), F.size("term").cast("long").alias("n_term"))


def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_embeddings(spark, sf_dir):
    return lattice.links(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("found", lambda x: x["item_id"].cast("string")), ",")
    return made.select("doc_id", F.size("found").cast("long").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("found", lambda x: x["distance"])).cast("long").alias("least_distance"))


def op7_warc(spark, sf_dir):
    made = warc.round_trip(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    prototypes = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).drop("set_id", "group_id")


def op10_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return made.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_bpe": op2_bpe, "op3_pii": op3_pii, "op4_licenses": op4_licenses, "op5_embeddings": op5_embeddings, "op6_decontamination": op6_decontamination, "op7_warc": op7_warc, "op8_language": op8_language, "op9_jaccard": op9_jaccard, "op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.oracle_sql(),
    "op5_embeddings": """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([abs(x) FOR x IN e]) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.x),
    least AS (SELECT x AS vec_id, min(c) AS component_id FROM reach GROUP BY 1),
    degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN least c USING (vec_id) LEFT JOIN degree d USING (vec_id)""",
    "op9_jaccard": """
    WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
    e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach(x, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.x),
    least AS (SELECT x AS doc_id, min(c) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN least USING (doc_id)""",
    "op7_warc": """
    WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    sized AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM rows),
    best AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS target FROM sized)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN target <> page_id THEN target END AS refers_to
    FROM best""",
}
