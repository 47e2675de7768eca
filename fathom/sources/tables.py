"""Readers, writers and adapters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str, quote: str = '"', strip_names: bool = True, casts: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header by a given schema: quotes of any kind, names cleaned, keys cast."""
    df = spark.read.option("header", True).option("quote", quote).schema(schema).csv(path)
    if strip_names:
        df = df.toDF(*(c.strip(" '\"") for c in df.columns))
    return df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()}) if casts else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def from_arrays(spark: SparkSession, X, y=None, sample_weight=None, offset=None) -> DataFrame:
    """NumPy arrays (or lists) as a table with columns ``_col_0``..., ``y``, ``sample_weight``, ``offset``.

    Of a sparse matrix (anything with ``tocsr``) only the entries travel; they become columns on the executors.
    """
    import pandas as pd

    sparse = hasattr(X, "tocsr")
    X = X.tocsr() if sparse else np.asarray(X, float)
    rows, width = X.shape
    if sparse:
        cuts = X.indptr[1:-1]
        data = {"_at": np.split(X.indices + 1, cuts), "_entries": np.split(X.data.astype(float), cuts)} if rows else {"_at": [], "_entries": []}
    else:
        data = {f"_col_{k}": X[:, k] for k in range(width)}
    named = [(n, v) for n, v in (("y", y), ("sample_weight", sample_weight), ("offset", offset)) if v is not None]
    for name, value in named:
        data[name] = np.broadcast_to(np.asarray(value, float), (rows,))
    if not sparse:
        return spark.createDataFrame(pd.DataFrame(data))
    schema = ", ".join(["_at array<int>", "_entries array<double>", *(f"{n} double" for n, _ in named)])
    listed = [([int(i) for i in r[0]], [float(v) for v in r[1]], *map(float, r[2:])) for r in zip(*data.values())]
    entries = F.map_from_arrays("_at", "_entries")
    columns = [F.coalesce(F.try_element_at("_m", F.lit(k + 1)), F.lit(0.0)).alias(f"_col_{k}") for k in range(width)]
    return spark.createDataFrame(listed, schema).withColumn("_m", entries).select(*columns, *(n for n, _ in named))


def spread_array(df: DataFrame, column: str, size: int, prefix: str = "_col_") -> DataFrame:
    """An array (or vector) column as ``size`` numeric columns."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "udt":
        from pyspark.ml.functions import vector_to_array

        c = vector_to_array(c)
    return df.select("*", *(c[k].cast("double").alias(f"{prefix}{k}") for k in range(size))).drop(column)
