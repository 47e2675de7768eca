"""Seeded synthetic tables for GLM tests and benchmarks, generated in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import get_family
from ..functions.links import get_link


def tweedie_sample(rng: np.random.Generator, mu: np.ndarray, dispersion: float = 1.0, p: float = 1.5) -> np.ndarray:
    """Compound Poisson-gamma variates of mean ``mu`` and variance ``dispersion mu ** p``."""
    rate = mu ** (2 - p) / (dispersion * (2 - p))
    shape, scale = (2 - p) / (p - 1), dispersion * (p - 1) * mu ** (p - 1)
    n = rng.poisson(rate)
    return np.where(n > 0, rng.gamma(np.maximum(n * shape, 1e-300), scale), 0.0)


def sample(family: str, rng: np.random.Generator, mu: np.ndarray) -> np.ndarray:
    f = get_family(family)
    p = getattr(f, "p", None)
    if p is not None:
        if p == 0:
            return rng.normal(mu)
        if p == 1:
            return rng.poisson(mu).astype(float)
        if p == 2:
            return rng.gamma(1.0, mu)
        if p == 3:
            return rng.wald(mu, 1.0)
        return tweedie_sample(rng, mu, 1.0, p)
    if hasattr(f, "theta"):
        return rng.poisson(rng.gamma(1 / f.theta, mu * f.theta)).astype(float)
    return rng.binomial(1, mu).astype(float)


def mixed_data(spark: SparkSession, family: str, rows: int, dense: int = 10, categorical: tuple[int, ...] = (10, 10), seed: int = 1, link: str = "auto", intercept: float = 0.2) -> DataFrame:
    """``dense0``..., ``cat0``..., ``y``, ``sample_weight`` and ``offset`` of a known model."""
    f = get_family(family)
    g = get_link(link, f)
    fixed = np.random.default_rng(seed)
    coefs = np.resize([1, 0.5, 0.1, -0.1, -0.5, -1, 0, 0, 0, 0], dense).astype(float)
    effects = [fixed.random(n) for n in categorical]
    names = [*(f"dense{k}" for k in range(dense)), *(f"cat{k}" for k in range(len(categorical))), "y", "sample_weight", "offset"]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rng = np.random.default_rng([seed, int(ids[0])]) if len(ids) else fixed
            x = rng.normal(size=(len(ids), dense)) / 4
            c = [rng.integers(0, n, len(ids)) for n in categorical]
            eta = intercept + x @ coefs + sum((e[k] for e, k in zip(effects, c)), np.zeros(len(ids)))
            mu = g.inverse(np.clip(eta, -5, 5) if family != "binomial" else eta)
            columns = [*x.T, *(np.char.add("l", k.astype(str)) for k in c), sample(family, rng, mu), rng.random(len(ids)), np.log(rng.random(len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(v.tolist()) for v in columns], names)

    schema = ", ".join(f"{n} {'string' if n.startswith('cat') else 'double'}" for n in names)
    return spark.range(rows).mapInArrow(run, schema)


def glm_dataset(spark: SparkSession, rows: int, family: str = "poisson", share: float = 0.01, seed: int = 42) -> DataFrame:
    """Standard normal features ``x0``..., ``share`` times as many as rows, a tenth of them in the model."""
    width = max(1, int(rows * share))
    coefs = np.random.default_rng(seed).normal(size=width) * (np.random.default_rng(seed + 1).random(width) < 0.1) / 3
    xs = [F.randn(seed + k).alias(f"x{k}") for k in range(width)]
    base = spark.range(rows).select("id", *xs)
    eta = F.greatest(F.least(sum((float(c) * F.col(f"x{k}") for k, c in enumerate(coefs) if c), F.lit(0.0)), F.lit(5.0)), F.lit(-5.0))
    f = get_family(family)
    g = get_link("auto", f)
    out = base.withColumn("_mu", g.inverse(eta))

    def run(batches):
        for batch in batches:
            rng = np.random.default_rng([seed, int(batch.column("id")[0].as_py())]) if batch.num_rows else None
            y = sample(family, rng, batch.column("_mu").to_numpy()) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(y, pa.float64())], [*batch.schema.names[1:-1], "y"])

    return out.mapInArrow(run, ", ".join(f"x{k} double" for k in range(width)) + ", y double")


def categorical_dataset(spark: SparkSession, rows: int, levels: tuple[int, ...] = (50, 200), family: str = "poisson", seed: int = 1) -> DataFrame:
    """Categorical features ``cat0``... only, with Zipf-like frequencies of their levels, and ``y``."""
    f = get_family(family)
    g = get_link("auto", f)
    effects = [np.random.default_rng([seed, k]).normal(scale=0.3, size=n) for k, n in enumerate(levels)]
    shares = [(1 / np.arange(1, n + 1)) / (1 / np.arange(1, n + 1)).sum() for n in levels]
    names = [*(f"cat{k}" for k in range(len(levels))), "y"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rng = np.random.default_rng([seed, int(batch.column(0)[0].as_py())])
                codes = [rng.choice(n, batch.num_rows, p=p) for n, p in zip(levels, shares)]
                y = sample(family, rng, g.inverse(sum(e[c] for e, c in zip(effects, codes))))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.char.add("l", c.astype(str)).tolist()) for c in codes), pa.array(y, pa.float64())], names)

    return spark.range(rows).mapInArrow(run, ", ".join(f"{n} {'string' if n != 'y' else 'double'}" for n in names))
