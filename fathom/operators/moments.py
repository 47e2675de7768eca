"""The engine's one physical primitive: a vectorised partial aggregate over coded rows.

Each task sums, over its Arrow batches, what an optimiser asks for at given coefficients
(deviance, gradient, curvature) and sends one row of doubles; the driver adds a few of them.
Level blocks contribute by ``bincount`` on their codes, so a step costs as much for a
categorical variable of a thousand levels as for a numeric column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of all tasks that the driver takes at once; beyond, a second round of tasks adds them up first.
DRIVER_BYTES = 64 << 20


@dataclass
class Rows:
    """A batch of coded rows as arrays."""

    y: np.ndarray
    w: np.ndarray
    offset: np.ndarray
    fold: np.ndarray | None
    dense: np.ndarray
    codes: list[tuple[np.ndarray, np.ndarray | None, int, int]]  # code, value, size, first column
    places: list[int]
    width: int

    def predictor(self, coef: np.ndarray) -> np.ndarray:
        """``coef`` has the intercept first."""
        eta = self.offset + coef[0]
        if self.places:
            eta = eta + self.dense @ coef[1:][self.places]
        for code, value, size, at in self.codes:
            part = np.append(coef[1 + at : 1 + at + size], 0.0)[code]
            eta = eta + (part if value is None else part * value)
        return eta

    def gradient(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(1 + self.width)
        out[0] = g.sum()
        if self.places:
            out[1:][self.places] = g @ self.dense
        for code, value, size, at in self.codes:
            out[1 + at : 1 + at + size] = np.bincount(code + 1, g if value is None else g * value, size + 1)[1:]
        return out

    def gram(self, d: np.ndarray) -> np.ndarray:
        """The weighted cross product of all columns, intercept first."""
        out = np.zeros((1 + self.width, 1 + self.width))
        out[0] = self.gradient(d)
        if self.places:
            at = 1 + np.array(self.places)
            out[np.ix_(at, at)] = self.dense.T @ (self.dense * d[:, None])
        for k, (code, value, size, first) in enumerate(self.codes):
            rows = slice(1 + first, 1 + first + size)
            own = d if value is None else d * value
            for j, place in enumerate(self.places):
                out[1 + place, rows] = np.bincount(code + 1, own * self.dense[:, j], size + 1)[1:]
                out[rows, 1 + place] = out[1 + place, rows]
            for other, factor, wide, start in self.codes[k:]:
                both = own if factor is None else own * factor
                grid = np.bincount((code + 1) * (wide + 1) + other + 1, both, (size + 1) * (wide + 1)).reshape(size + 1, wide + 1)[1:, 1:]
                columns = slice(1 + start, 1 + start + wide)
                out[rows, columns], out[columns, rows] = grid, grid.T
        out[:, 0] = out[0]
        return out

    def scores(self, s: np.ndarray) -> np.ndarray:
        """Row scores as a dense matrix; callers bound the rows."""
        out = np.zeros((len(s), 1 + self.width))
        out[:, 0] = s
        if self.places:
            out[:, 1 + np.array(self.places)] = self.dense * s[:, None]
        for code, value, _, at in self.codes:
            some = np.flatnonzero(code >= 0)
            out[some, 1 + at + code[some]] = (s if value is None else s * value)[some]
        return out


@dataclass
class Coded:
    """A cached narrow table and how its columns make up the design."""

    table: DataFrame
    layout: list[tuple[str | None, str | None, int]]
    centres: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: Whether ``fold`` holds bits for training and testing in each split, not the number of a row's fold.
    pairs: bool = False

    @property
    def width(self) -> int:
        return sum(n for _, _, n in self.layout)

    def dense_places(self) -> list[int]:
        out, at = [], 0
        for _, code, n in self.layout:
            if code is None:
                out.append(at)
            at += n
        return out


def batch_rows(batch: pa.RecordBatch, layout, centres: np.ndarray) -> Rows:
    names = batch.schema.names
    get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    dense, codes, places, at = [], [], [], 0
    for value, code, size in layout:
        if code is None:
            dense.append(get(value) - centres[at])
            places.append(at)
        else:
            codes.append((get(code).astype(np.int64), get(value) if value else None, size, at))
        at += size
    y = get("y") if "y" in names else np.zeros(batch.num_rows)
    return Rows(y, get("w") if "w" in names else np.ones(batch.num_rows), get("o") if "o" in names else np.zeros(batch.num_rows), get("fold") if "fold" in names else None, np.column_stack(dense) if dense else np.zeros((batch.num_rows, 0)), codes, places, at)


def summed(table: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over all rows of ``partial(batch) -> array of size`` doubles.

    ``partial`` runs on each Arrow batch; tasks add up their batches. Many tasks with wide sums
    are added in a second round of tasks, so the driver never takes more than DRIVER_BYTES or
    one round's worth of the square root of the number of tasks. Sums are added in task order.
    """

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "sums"])

    parts = table.mapInArrow(run, "part long, sums array<double>")
    count = table.rdd.getNumPartitions() if 8 * size > DRIVER_BYTES / 10_000 else 0
    if count * size * 8 > DRIVER_BYTES:

        def add(batches):
            total, first = np.zeros(size), None
            for batch in batches:
                for part, values in sorted(zip(batch.column("part").to_pylist(), batch.column("sums"))):
                    total += values.values.to_numpy()
                    first = part if first is None else min(first, part)
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "sums"])

        parts = parts.repartition(max(1, math.isqrt(count)), "part").mapInArrow(add, "part long, sums array<double>")
    total = np.zeros(size)
    for _, values in sorted((r.part, r.sums) for r in parts.collect()):
        total += np.array(values)
    return total


@dataclass
class Request:
    """What one optimiser asks of a pass: deviances at all ``coefs``, and the slope at the first."""

    coefs: list[np.ndarray]
    slope: str = "hessian"  # "gradient", or "" for deviances only
    fold: int | None = None
    test: bool = False


@dataclass
class Answer:
    deviances: list[float]
    largest: list[float]
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None


def _chosen(fold: np.ndarray, number: int, test: bool, pairs: bool) -> np.ndarray:
    """The rows that train split ``number``, or test it."""
    return (fold.astype(np.int64) >> (2 * number + test)) & 1 == 1 if pairs else (fold == number) == test


def evaluate(coded: Coded, family, link, requests: list[Request]) -> list[Answer]:
    """One pass over the rows that answers every request.

    Coefficients are for the centred dense columns, intercept first. With a fold a request sees
    the rows outside of it, with ``test`` those inside. Weights are as the table has them.
    """
    layout, centres, k, pairs = coded.layout, coded.centres, coded.width + 1, coded.pairs
    sizes = [2 * len(r.coefs) + (k if r.slope else 0) + (k * k if r.slope == "hessian" else 0) for r in requests]
    packed = [(np.array(r.coefs), r.slope, r.fold, r.test) for r in requests]

    def partial(batch):
        whole = batch_rows(batch, layout, centres)
        out = []
        for coefs, slope, fold, test in packed:
            rows, keep = whole, None
            if fold is not None:
                keep = _chosen(whole.fold, fold, test, pairs)
            for n, coef in enumerate(coefs):
                eta = rows.predictor(coef)
                with np.errstate(all="ignore"):
                    mu = link.inverse(eta)
                    w = rows.w if keep is None else np.where(keep, rows.w, 0.0)
                    unit = family.unit_deviance(rows.y, mu)
                out += [[np.sum(np.where(w > 0, w * unit, 0.0)), 0.0 if np.all(np.abs(mu[w > 0]) < 1e43) and np.all(np.isfinite(eta)) else 1.0]]
                if n == 0 and slope:
                    with np.errstate(all="ignore"):
                        g, h = family.rows(link, rows.y, eta, mu, w)
                    first = [rows.gradient(g)] + ([rows.gram(h).ravel()] if slope == "hessian" else [])
            if slope:
                out += first
        return np.concatenate(out)

    total, answers = summed(coded.table, partial, sum(sizes)), []
    for r, size in zip(requests, sizes):
        part, total = total[:size], total[size:]
        n = 2 * len(r.coefs)
        answer = Answer(part[0:n:2].tolist(), part[1:n:2].tolist())
        if r.slope:
            answer.gradient = part[n : n + k]
        if r.slope == "hessian":
            answer.hessian = part[n + k :].reshape(k, k)
        answers.append(answer)
    return answers


def column_moments(coded: Coded, folds: int = 0, log_power: float | None = None) -> list[dict]:
    """Weighted moments of all design columns: of all rows, then of each fold's training rows.

    Each has ``weight``, ``mean``, ``std``, ``y``, ``offset`` and ``rows``, those of folds also
    ``test_weight``; standard deviations are of the population. Dense columns are taken about
    ``centres``, so call it again with the means as centres for wide scales. With ``log_power``
    p there is ``log_start`` as well: the best intercept beside the offset under a log link and a
    variance of the mean to the power p.
    """
    layout, k, pairs = coded.layout, coded.width, coded.pairs
    centres = coded.centres if len(coded.centres) else np.zeros(k)
    size = 2 * k + 7
    power = 1.0 if log_power is None else log_power

    def partial(batch):
        rows = batch_rows(batch, layout, centres)
        out = []
        for f in range(-1, folds):
            w = rows.w if f < 0 else np.where(_chosen(rows.fold, f, False, pairs), rows.w, 0.0)
            first = rows.gradient(w)[1:]
            second = np.zeros(k)
            if rows.places:
                second[rows.places] = w @ (rows.dense * rows.dense)
            for code, value, wide, at in rows.codes:
                second[at : at + wide] = np.bincount(code + 1, w if value is None else w * value * value, wide + 1)[1:]
            tested = rows.w[_chosen(rows.fold, f, True, pairs)].sum() if f >= 0 else 0.0
            with np.errstate(over="ignore"):
                logs = [(w * rows.y * np.exp((1 - power) * rows.offset)).sum(), (w * np.exp((2 - power) * rows.offset)).sum()] if log_power is not None else [0.0, 0.0]
            out += [first, second, [w.sum(), (w * rows.y).sum(), (w * rows.offset).sum(), float((w > 0).sum()) if folds else float(len(w)), tested, *logs]]
        return np.concatenate(out)

    out = []
    for s in summed(coded.table, partial, size * (1 + folds)).reshape(-1, size):
        total, y, offset, rows, tested, first, second = s[2 * k :]
        weight = total or 1.0
        mean = s[:k] / weight
        start = math.log(first / second) if first > 0 and second > 0 else None
        out.append({"weight": total, "mean": mean + centres, "std": np.sqrt(np.maximum(s[k : 2 * k] / weight - mean * mean, 0.0)), "y": y / weight, "offset": offset / weight, "rows": rows, "test_weight": tested, "log_start": start})
    return out


def cached(table: DataFrame) -> DataFrame:
    """``table`` spread over the cluster's cores if it has fewer partitions, and kept in memory with spill."""
    from pyspark import StorageLevel

    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores)
    return table.persist(StorageLevel.MEMORY_AND_DISK)


def profile(df: DataFrame, checks: dict[str, F.Column]) -> dict:
    """All validation aggregates in one job."""
    return df.agg(*(c.alias(n) for n, c in checks.items())).first().asDict()
