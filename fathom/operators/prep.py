"""Feature preparation around a model: joins, windows, bins and splits on DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(c: Column, lower=None, upper=None) -> Column:
    c = c if lower is None else F.greatest(c, F.lit(lower))
    return c if upper is None else F.least(c, F.lit(upper))


def join_sums(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join with per-key sums of ``right``; rows without a match get 0."""
    sums = right.groupBy(key).agg(*(F.sum(v).alias(v) for v in values))
    return left.join(sums, key, "left").fillna(0, values)


def outer_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a key with ``match``: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    both = a.join(b, key, "outer")
    return both.withColumn("match", F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")).drop("_l", "_r")


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that raises if a row has no match."""
    if left.join(right, key, "left_anti").limit(1).count():
        raise ValueError(f"rows without a match on {key}")
    return left.join(right, key, "left")


def survival_split(df: DataFrame, duration: str, event: str, times: DataFrame | None = None) -> DataFrame:
    """A row for each subject and distinct event time up to its end, with ``time`` and ``died``.

    A range join by equal keys: the span of the times is cut into about as many slots as there
    are thousands of times, a subject meets every slot up to that of its end, and only in that
    last one times beyond the end are left out. The driver sees three numbers.
    """
    times = times if times is not None else df.where(F.col(event) > 0).select(F.col(duration).alias("time")).distinct()
    span = times.agg(F.min("time").alias("low"), F.max("time").alias("high"), F.count("*").alias("n")).first()
    low, high = float(span.low or 0), float(span.high or 0)
    slots = 1 + span.n // 1000
    slot = lambda c: F.least(F.floor((c.cast("double") - low) * (slots / max(high - low, 1e-300))), F.lit(slots - 1)).cast("int")
    last = F.when(F.col(duration) >= low, slot(F.col(duration)))
    spread = df.withColumn("_slot", F.explode(F.sequence(F.lit(0), last)))
    rows = spread.join(times.select("time", slot(F.col("time")).alias("_slot")), "_slot").where(F.col("time") <= F.col(duration)).drop("_slot")
    return rows.select(*df.columns, "time").withColumn("died", ((F.col("time") == F.col(duration)) & (F.col(event) > 0)).cast("int"))


def categorise(c: Column, edges: list[float]) -> Column:
    """The number of edges at or below a value (as ``digitize`` counts)."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))


def quantile_bins(df: DataFrame, column: str, bins: int, by: str | None = None, name: str = "bin") -> DataFrame:
    """Equal-count bins by exact quantiles, repeated edges merged; the least value is in bin 0."""
    cuts = F.array_distinct(F.percentile(column, F.array(*(F.lit(k / bins) for k in range(bins + 1)))))
    if by is None:
        edges = df.agg(cuts.alias("_e")).first()["_e"]
        at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column)))
        return df.withColumn(name, F.greatest(at - 1, F.lit(0)))
    edges = df.groupBy(by).agg(cuts.alias("_e"))
    at = F.size(F.filter("_e", lambda e: e < F.col(column)))
    return df.join(edges, by).withColumn(name, F.greatest(at - 1, F.lit(0))).drop("_e")


def cumcount(df: DataFrame, by: str, order: str, name: str = "seen") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def lag_lead(df: DataFrame, by: str, order, column: str, steps: list[int], default=None) -> DataFrame:
    """``column_lag_k`` and, for negative steps, ``column_lead_k``."""
    w = Window.partitionBy(by).orderBy(*([order] if isinstance(order, str) else order))
    return df.withColumns({f"{column}_{'lag' if k > 0 else 'lead'}_{abs(k)}": F.coalesce(F.lag(column, k).over(w), F.lit(default)) for k in steps})


def rolling_zscore(df: DataFrame, by: str, order, column: str, window: int, name: str = "zscore") -> DataFrame:
    """The value in standard deviations (population) from the mean of the ``window`` rows before it.

    Null until there are ``window`` rows, and where these do not vary.
    """
    w = Window.partitionBy(by).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(-window, -1)
    sd = F.stddev_pop(column).over(w)
    return df.withColumn(name, F.when((F.count(column).over(w) >= window) & (sd > 0), (F.col(column) - F.avg(column).over(w)) / sd))


def lagged_average(df: DataFrame, by: str, order, value: str, count: str, window: int, lag: int, name: str = "average") -> DataFrame:
    """Sum of ``value`` over sum of ``count`` in ``window`` rows that end ``lag`` rows before."""
    w = Window.partitionBy(by).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(-(window + lag) + 1, -lag)
    return df.withColumn(name, F.sum(value).over(w) / F.nullif(F.sum(count).over(w), F.lit(0)))


def ewma(df: DataFrame, by: str, order, column: str, span: float, name: str = "ewma") -> DataFrame:
    """Adjusted exponentially weighted mean over all rows up to each one, nulls ignored.

    A row's value is the sum of x_i (1-a)^(n-i) over the sum of (1-a)^(n-i), with i counting
    non-null rows. Both sums are running window sums within blocks of rows, of terms scaled by
    (1-a)^-i. A block is as long as that factor stays below e^60, so a dozen blocks later its
    share is below the least double: what earlier blocks carry into one is a sum over the lags of
    their totals, and no step grows with the number of blocks.
    """
    keys = [order] if isinstance(order, str) else list(order)
    decay = 1 - 2 / (span + 1)
    fade = -math.log(decay) if 0 < decay < 1 else 750.0
    block = max(1, int(60 / fade))
    whole = Window.partitionBy(by).orderBy(*keys)
    at = F.count(column).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_i", at).withColumn("_b", F.floor((F.greatest("_i", F.lit(1)) - 1) / block))
    inside = Window.partitionBy(by, "_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_i") - F.col("_b") * block
    grown = F.when(F.col(column).isNotNull(), F.exp(place * fade))
    rows = rows.withColumns({"_x": F.coalesce(F.sum(grown * F.col(column)).over(inside), F.lit(0.0)), "_w": F.coalesce(F.sum(grown).over(inside), F.lit(0.0)), "_p": place})
    # All blocks but the last of a key are full, so the totals of a block fade alike over each later one.
    end = math.exp(-block * fade)
    ends = rows.groupBy(by, "_b").agg((F.max_by("_x", "_p") * end).alias("x"), (F.max_by("_w", "_p") * end).alias("w"))
    blocks, gone = Window.partitionBy(by).orderBy("_b"), 1 + int(745 / (block * fade))
    carry = lambda c: sum((F.coalesce(F.lag(c, k).over(blocks), F.lit(0.0)) * math.exp(-block * fade * (k - 1)) for k in range(1, gone + 1)), F.lit(0.0))
    carried = ends.select(by, "_b", carry("x").alias("_cx"), carry("w").alias("_cw"))
    out = rows.join(carried, [by, "_b"])
    value = (F.col("_x") + F.col("_cx")) / F.nullif(F.col("_w") + F.col("_cw"), F.lit(0.0))
    return out.select(*df.columns, value.alias(name)) if name not in df.columns else out.withColumn(name, value).select(*df.columns)


def key(*columns: str) -> Column:
    return F.concat_ws("_", *columns)


def date_parts(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(column)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "padded_month": F.lpad(F.month(d).cast("string"), 2, "0")})


def snake_case(df: DataFrame) -> DataFrame:
    import re

    return df.toDF(*(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower() for c in df.columns))


def union_tagged(tables: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    out = None
    for name, t in tables.items():
        t = t.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def keep_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys, key, "left_semi")


def weighted_moments(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted mean and variance by group: the second pass sums squares about the groups' means.

    Groups with a total weight of 0 have neither.
    """
    w, x = F.col(weight), F.col(value)
    means = df.groupBy(by).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("mean"))
    about = df.select(F.col(by).alias("_by"), x.alias("_x"), w.alias("_w")).join(means, F.col("_by").eqNullSafe(F.col(by)))
    gap = F.col("_x") - F.col("mean")
    # The squares' mean is corrected by that of the gaps, which is 0 but for rounding of the mean.
    sums = about.groupBy(by).agg(F.first("mean").alias("mean"), F.sum(F.col("_w") * gap).alias("_g"), F.sum(F.col("_w") * gap * gap).alias("_q"), F.sum("_w").alias("weight"))
    off = F.try_divide(F.col("_g"), F.col("weight"))
    return sums.select(by, (F.col("mean") + off).alias("mean"), (F.try_divide(F.col("_q"), F.col("weight")) - off * off).alias("variance"), "weight")


def target_and_exposure(df: DataFrame, family: str, *, claims: str, amount: str, exposure: str) -> DataFrame:
    """``y`` and ``exposure`` of an insurance portfolio for a family of models.

    Frequencies (Poisson, negative binomial, binomial: whether there was a claim) are by
    exposure, severities (gamma, inverse Gaussian) by claim and only of rows with one, pure
    premiums (Tweedie) and the other families are amounts by exposure.
    """
    kind = family.split("(")[0].strip().replace(".", "").replace("-", "").replace("_", "").lower()
    n, total, e = F.col(claims).cast("double"), F.col(amount).cast("double"), F.col(exposure).cast("double")
    if kind in ("poisson", "negativebinomial"):
        return df.withColumns({"y": n / e, "exposure": e})
    if kind == "binomial":
        return df.withColumns({"y": (n > 0).cast("double"), "exposure": e})
    if kind in ("gamma", "inversegaussian"):
        return df.where((n > 0) & (total > 0)).withColumns({"y": total / n, "exposure": n})
    return df.withColumns({"y": total / e, "exposure": e})


def distance_penalty(places: list[tuple[float, float]], exposure: list[float] | None = None, scale: float = 1.0, zeros: int = 0) -> list[list[float]]:
    """A P2 matrix that draws the coefficients of near places together, after ``zeros`` free ones.

    Places are linked by 1 / distance, and less the more exposure the two have (over the root of
    its product); the links are shares of the largest times ``scale``. The matrix is the graph's
    Laplacian, so its penalty is the weighted sum of squared differences. Places at one point
    are linked by the largest weight.
    """
    import numpy as np

    at = np.asarray(places, float).reshape(-1, 2)
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    link = np.divide(1.0, far, out=np.zeros_like(far), where=far > 0)
    if exposure is not None:
        root = np.sqrt(np.asarray(exposure, float))
        link /= np.outer(root, root)
    most = link.max(initial=0) or 1.0
    link[(far == 0) & ~np.eye(len(at), dtype=bool)] = most
    link *= scale / most
    out = np.zeros((zeros + len(at),) * 2)
    out[zeros:, zeros:] = np.diag(link.sum(axis=1)) - link
    return out.tolist()


def exposure_to_weights(df: DataFrame, power: float, y: str, exposure: str, weight: str | None = None) -> DataFrame:
    """An exposure (log offset) as weights: y / e with weight w e ** (2 - power)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.withColumns({"y_rate": F.col(y) / F.col(exposure), "weight": w * F.pow(exposure, F.lit(2 - power))})


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores of the numeric columns that have more than two distinct values."""
    row = df.agg(*(a for c in columns for a in (F.countDistinct(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"] for c in columns if row[f"n_{c}"] > 2 and row[f"s_{c}"]})


def one_hot(df: DataFrame, column: str, levels: list) -> DataFrame:
    """Wide indicators, for export only: models never need them."""
    return df.withColumns({f"{column}__{v}": (F.col(column) == v).cast("int") for v in levels})


def ordinal(df: DataFrame, column: str, levels: list, name: str | None = None) -> DataFrame:
    found = F.lit(None).cast("int")
    for k, v in enumerate(levels):
        found = F.when(F.col(column) == v, k).otherwise(found)
    return df.withColumn(name or f"{column}_code", found)


def bootstrap(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(True, fraction, seed)


def swap_noise(df: DataFrame, column: str, share: float, seed: int, order: str, bucket_rows: int = 10_000) -> DataFrame:
    """A share of the rows gets another row's value: that of the next row within a random bucket.

    There are as many buckets as it takes for about ``bucket_rows`` rows in each.
    """
    buckets = 1 + df.count() // bucket_rows
    w = Window.partitionBy(F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(buckets))).orderBy(F.xxhash64(order, F.lit(seed + 1)))
    chosen = F.pmod(F.xxhash64(order, F.lit(seed + 2)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.withColumn(column, F.when(chosen, F.coalesce(F.lead(column).over(w), F.col(column))).otherwise(F.col(column)))


def split(df: DataFrame, keys: list[str], test_share: float) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the keys: the same at every size and partitioning."""
    test = F.pmod(F.xxhash64(*keys), F.lit(10_000)) < int(test_share * 10_000)
    return df.where(~test), df.where(test)


def rmspe(df: DataFrame, y: str, predicted: str) -> float:
    return df.where(F.col(y) != 0).agg(F.sqrt(F.avg(F.pow((F.col(y) - F.col(predicted)) / F.col(y), F.lit(2.0))))).first()[0]


def objective(df: DataFrame, family, y: Column, mu: Column, weight: Column, alpha: float, l1_ratio: float, coefs) -> float:
    """The penalised objective of given coefficients in one aggregate."""
    d = df.agg((family.deviance(y, mu, weight) / F.sum(weight)).alias("d")).first().d
    return 0.5 * d + alpha * (l1_ratio * sum(abs(c) for c in coefs) + 0.5 * (1 - l1_ratio) * sum(c * c for c in coefs))


def zone_effects(df: DataFrame, zone: str, y: Column, mu: Column, power: float) -> DataFrame:
    """The log fixed effect of each zone given means without it."""
    return df.groupBy(zone).agg((F.log(F.sum(y * F.pow(mu, F.lit(1 - power)))) - F.log(F.sum(F.pow(mu, F.lit(2 - power))))).alias("effect"))


def kernel_average(zones: DataFrame, zone: str, x: str, y: str, value: str, weight: str, width: float, reach: float = 4.0, rho: float | None = None) -> DataFrame:
    """``smooth``: the Gaussian kernel average of the other zones' values, and ``near``, its sum of weights.

    Zones meet those in neighbouring grid cells only: the kernel is cut ``reach`` widths away,
    where it is below 4e-4 of its largest value. A zone with no other so near takes the first
    reach among the doubled ones that has some, so only a zone alone in the table has a null.
    With ``rho`` a zone's own value is mixed in by the share ``(own weight / near) ** rho``.
    """
    kept = [F.col(zone).alias("_zone"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")]
    all_ = zones.select(*kept)
    span = all_.agg(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"), F.count("*")).first()
    todo, out, far = all_, None, reach * width
    while True:
        found = _neighbours(todo, all_, far, width)
        out = found if out is None else out.unionByName(found)
        if not span[2] or far > max(span[0], span[1]):
            break
        todo = todo.join(found.select("_zone"), "_zone", "left_anti")
        if not todo.limit(1).count():
            break
        far *= 2
    joined = all_.join(out, "_zone", "left")
    share = F.lit(0.0) if rho is None else F.pow(F.col("_w") / F.col("near"), F.lit(rho))
    return joined.select(F.col("_zone").alias(zone), (share * F.col("_v") + (1 - share) * F.col("average")).alias("smooth"), "near")


def _neighbours(some: DataFrame, zones: DataFrame, far: float, width: float) -> DataFrame:
    """``_zone, average, near`` of the zones of ``some`` that have others at most ``far`` away."""
    cell = lambda c: F.floor(F.col(c) / far)
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    other = zones.select(*(F.col(c).alias(f"{c}2") for c in ("_zone", "_x", "_y", "_v", "_w")), F.explode(near).alias("_dx"), cell("_x").alias("_cx"), cell("_y").alias("_cy"))
    other = other.withColumn("_dy", F.explode(near)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    both = some.withColumns({"_cx": cell("_x"), "_cy": cell("_y")}).join(other, ["_cx", "_cy"])
    square = F.pow(F.col("_x") - F.col("_x2"), F.lit(2.0)) + F.pow(F.col("_y") - F.col("_y2"), F.lit(2.0))
    both = both.where((F.col("_zone") != F.col("_zone2")) & (square <= far * far))
    k = F.exp(-square / (2 * width * width)) * F.col("_w2")
    sums = both.groupBy("_zone").agg(F.sum(k * F.col("_v2")).alias("s"), F.sum(k).alias("near"))
    return sums.where("near > 0").select("_zone", (F.col("s") / F.col("near")).alias("average"), "near")
