"""From raw documents to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, decontam, jaccard, langid, pii
from fathom.llm.arrow import settle, unload
from fathom.llm.shared import discard, fresh, stored

#: Chance cosine of a text of n n-grams with a foreign language, times the root of n, and the part of it that does not shrink.
LANGUAGE_NOISE, LANGUAGE_SCORE = 1.0, 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those that are like no language of the table.

    Prototypes are learned from the documents whose crc32(doc_id) mod 3 is not 1; a null doc_id is
    not among them. A text goes if its best cosine is below ``LANGUAGE_SCORE``; the shorter the
    text, the further below it must be to tell it from chance: of that bound, the chance cosine
    of ``LANGUAGE_NOISE`` over the root of the number of characters is taken off. Null and empty
    texts have no letter and go. Rows are judged one by one, so repeated ones fare alike. An empty
    table stays empty.
    """
    settle(spark)
    unload(spark)
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))
    prototypes = langid.train(docs.where(learn))
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    scored = langid.predict(docs, prototypes, pred=pred, score=score)
    bound = LANGUAGE_SCORE - LANGUAGE_NOISE / F.sqrt(F.length("text"))
    return scored.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= bound)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: that with the least doc_id (ties: least set).

    Rows are judged by doc_id and set of shingles, so different texts under one doc_id are judged
    apart, and of repeated rows of the kept document one stays. A null doc_id counts as larger
    than all others. Texts without shingles are linked with nothing and all stay. An empty table
    stays empty.
    """
    settle(spark)
    unload(spark)
    groups = stored(jaccard.join(docs).where("n_shingles > 0").select("doc_id", "group_id", "set_id"), "pipeline-groups")
    own = fresh(docs.columns, "set")
    lost_id, lost_set = fresh([*docs.columns, own], "lost_id"), fresh([*docs.columns, own], "lost_set")
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(own) == F.col(lost_set))
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("set_id").alias("set"))
    keeper = stored(groups.groupBy("group_id").agg(F.min(rank).alias("k"), F.count("*").alias("n")).where("n > 1").select("group_id", "k"), "pipeline-keepers")
    kept_one = F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("set_id") == F.col("k.set"))
    named = [F.col("doc_id").alias(lost_id), F.col("set_id").alias(lost_set)]
    lost = stored(groups.join(keeper, "group_id").where(~kept_one).select(*named).distinct(), "pipeline-lost")
    twice = stored(groups.groupBy("doc_id", "set_id").count().where("count > 1").select(*named), "pipeline-twice")
    discard(groups, keeper)
    # What goes is broadcast up to a size; beyond, the texts are shuffled by their keys.
    few = lost.count() <= jaccard.BROADCAST_IDS
    kept = jaccard.with_sets(docs, set_id=own).join(F.broadcast(lost) if few else lost, same, "left_anti")
    if not twice.limit(1).count():
        return kept.select(docs.columns)
    once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(twice, same, "left_anti").unionByName(once).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay; rows are judged one by one, so repeated ones fare
    alike; an empty benchmark drops nothing, an empty table stays empty.
    """
    settle(spark)
    unload(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = fresh(docs.columns, "found")
    return decontam.find(docs, benchmark, found=found).where(F.size(found) == 0).select(docs.columns)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and disclosing terms; ``n_chars`` follows the new text.

    A null text stays null and keeps its ``n_chars``, an empty one stays empty. All rows stay,
    repeated ones too; copies of a text count once as support of a term. Columns named like the
    kinds of spans are kept. An empty table stays empty. DataFrame functions only: no step of
    this stage runs Python on the executors.
    """
    settle(spark)
    hidden = {c: fresh(docs.columns, f"kept_{c}") for c in docs.columns if c.lower() in pii.KINDS}
    clean = pii.redact(pii.find(docs.withColumnsRenamed(hidden))).drop(*pii.KINDS).withColumnsRenamed({v: k for k, v in hidden.items()})
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and how many there are: ``doc_id, ids, n_tokens``.

    Null and empty texts have none; repeated rows and null ids stay. An empty table gives an
    empty table.
    """
    settle(spark)
    unload(spark)
    made = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=None)
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("sanitised", sanitised), ("tokens", tokens)]
#: No stage but the PII patterns can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
