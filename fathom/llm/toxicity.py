"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning rates are per coordinate and L1 keeps most weights at exactly 0, so the model is a
short list of (bucket, weight) pairs, at most ``2 ** BITS`` of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns

BITS = 20
#: Labelled rows of each class that the model is fitted on, at most: the first by a hash of the id.
FIT_ROWS = 5000
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.15, 1.0, 6.0, 0.5
#: Lengths of word beginnings, and the shares of a text's words that a stem may reach.
STEMS = (5, 6, 7)
STEM_SHARES = (0.004, 0.008, 0.016, 0.032)
#: Odd multipliers that spread hashes over the buckets.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

#: Of each level of a stem's share.
_LEVELS = np.arange(1, len(STEM_SHARES) + 1, dtype=np.uint64) * _MIX[1]


def features(words: np.ndarray, stems: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct buckets of a text: words, pairs of words up to two words apart, and stems.

    ``words`` are word hashes, ``stems`` a row of hashes of each word's beginnings (0: none). A
    stem has a bucket for its presence and, where it recurs, for each level of its share of the
    words that it reaches, since languages that join words insult by a recurring part of them.
    """
    out = [words * _MIX[0]]
    for gap in (1, 2, 3):
        if len(words) > gap:
            out.append((words[:-gap] * _MIX[1] + words[gap:] * _MIX[2] + np.uint64(gap)) * _MIX[0])
    found, counts = np.unique(stems, return_counts=True)
    found, counts = found[found != 0], counts[found != 0]
    out.append(found * _MIX[1])
    found, counts = found[counts > 1], counts[counts > 1]
    for level, share in zip(_LEVELS, STEM_SHARES):
        out.append(found[counts >= share * len(words)] * _MIX[2] + level)
    return np.unique(np.concatenate(out) * _MIX[0] >> np.uint64(64 - bits)).astype(np.int32)


def _hash(word: bytes) -> int:
    return zlib.crc32(word) | (zlib.adler32(word) + len(word)) << 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, of their stems, and each text's bounds.

    Words are lower-cased runs of ASCII letters and of whatever is beyond ASCII.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[\x00-`{-\x7f]+")
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.array([_hash(w.encode()) if w else 0 for w in distinct], np.uint64).reshape(-1)
    stems = np.array([[_hash(w[:k].encode()) if len(w) >= k else 0 for k in STEMS] for w in distinct], np.uint64).reshape(-1, len(STEMS))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    kept = (hashes != 0)[codes] if len(codes) else np.zeros(0, bool)
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return hashes[codes[kept]], stems[codes[kept]], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _buckets(texts: pa.Array, bits: int) -> list[np.ndarray]:
    words, stems, bounds = word_hashes(texts)
    return [features(words[a:b], stems[a:b].ravel(), bits) for a, b in zip(bounds, bounds[1:])]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (dense) and bias of one FTRL-proximal run over the rows, in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for index, label in zip(rows, labels):
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            gradient = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            square = gradient * gradient
            n[index] = ni + square
            z[index] = zi + gradient - (np.sqrt(ni + square) - np.sqrt(ni)) / ALPHA * w
            bias_n += square
            bias -= 0.1 * gradient / (1 + np.sqrt(bias_n))
    return weights(z, n), bias


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """``(buckets, weights, bias)`` learned from ``labels.toxic`` of the documents.

    At most ``rows`` ids of each class are taken, the first by a hash of the id, and their texts
    found by a broadcast of these ids. The texts' buckets are dealt to ``SHARDS`` tasks; their
    models are averaged. Labels other than 0 and 1 and null texts are left out; a doc_id with
    both labels counts as toxic, null ids count for nothing, and of texts under one id each is a
    row. Without both classes, as in empty tables, the model is empty and its bias the share. Only
    the named columns are read, so others may have any names; whole texts count, however long.
    """
    spark = docs.sparkSession
    clean = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [r for k in (0, 1) for r in clean.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    share = sum(r.toxic for r in picked) / len(picked) if picked else 0.0
    if share in (0, 1):
        return np.empty(0, np.int64), np.empty(0), 6.0 * (1 if share else -1)
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, float(r.toxic)) for r in picked], "doc_id long, y double"))
    found = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id")
    made = add_columns(found, "text", lambda: lambda t: [pa.array(_buckets(t, bits), pa.list_(pa.int32()))], [T.StructField("index", T.ArrayType(T.IntegerType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"])
        w, bias = ftrl([np.asarray(x) for x in pdf["index"]], pdf["y"].to_numpy(), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1), "w": np.append(w[at], bias)})

    dealt = made.select("doc_id", "y", "index", F.xxhash64("doc_id", F.lit(7)).alias("order")).withColumn("shard", F.pmod("order", F.lit(SHARDS)))
    fitted = dealt.groupBy("shard").applyInPandas(fit, "bucket long, w double")
    model = fitted.groupBy("bucket").agg((F.sum("w") / SHARDS).alias("w")).orderBy("bucket").toPandas()
    w = model[model.bucket >= 0]
    return w.bucket.to_numpy(), w.w.to_numpy(), float(model.w[model.bucket < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 from the whole text.

    Null and empty texts get the score of the bias alone; equal texts have equal scores. Rows are
    kept as they are, repeated ones and null ids too; a column named ``score`` is replaced, all
    others stay. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        buckets, weights, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[buckets] = weights

        def work(texts):
            total = np.array([dense[b].sum(dtype=np.float64) for b in _buckets(texts, bits)])
            return [pa.array(1 / (1 + np.exp(-np.clip(bias + total, -35, 35))))]

        return work

    return add_columns(docs, text, make, [T.StructField("score", T.DoubleType())])
