"""A grid of model fits as tables: what to run, what came out, how two runs differ."""

from __future__ import annotations

import itertools
import statistics
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import get_family


@dataclass(frozen=True)
class Case:
    """One fit: which problem, family, solver and penalty, over how many rows."""

    problem: str
    family: str = "poisson"
    solver: str = "auto"
    alpha: float = 0.001
    l1_ratio: float = 0.0
    rows: int = 10_000

    @property
    def power(self) -> float | None:
        """The power of the family's variance, None if it is none."""
        p = getattr(get_family(self.family), "p", None)
        return None if p is None else float(p)


RESULT = "problem string, family string, solver string, alpha double, l1_ratio double, rows long, seconds double, n_iter int, objective double, intercept double, coef_l1 double, coef_l2 double, error string"


def grid(**choices) -> list[Case]:
    """All combinations of the given fields' values; a single value stands for a list of one."""
    listed = [v if isinstance(v, (list, tuple)) else [v] for v in choices.values()]
    return [Case(**dict(zip(choices, values))) for values in itertools.product(*listed)]


def timed(f: Callable, repeats: int = 3):
    """The result of ``f`` and its median seconds, after one call to warm up."""
    out, took = f(), []
    for _ in range(repeats):
        began = time.perf_counter()
        out = f()
        took.append(time.perf_counter() - began)
    return out, statistics.median(took)


def run(spark: SparkSession, cases: list[Case], data: Callable[[SparkSession, Case], DataFrame], y: str = "y", repeats: int = 1) -> DataFrame:
    """A row of results for each case, with the error's text where a fit fails; ``data`` gives its table."""
    from .glm import GeneralizedLinearRegressor

    rows = []
    for case in cases:
        table = data(spark, case)
        fit = lambda: GeneralizedLinearRegressor(family=case.family, solver=case.solver, alpha=case.alpha, l1_ratio=case.l1_ratio).fit(table, y)  # noqa: B023, E731
        try:
            m, seconds = timed(fit, repeats)
            last = m.diagnostics_[-1]["objective_fct"] if m.diagnostics_ else None
            made = (seconds, int(m.n_iter_), last, m.intercept_, float(abs(m.coef_).sum()), float((m.coef_**2).sum() ** 0.5), None)
        except (ValueError, ArithmeticError, NotImplementedError) as error:
            made = (None, None, None, None, None, None, str(error))
        rows.append((*asdict(case).values(), *made))
    return spark.createDataFrame(rows, RESULT)


_KEYS = ["problem", "family", "alpha", "l1_ratio", "rows"]


def analysed(results: DataFrame) -> DataFrame:
    """Seconds of each solver side by side for each problem, and how far the objectives are apart."""
    spread = results.groupBy(*_KEYS).agg((F.max("objective") - F.min("objective")).alias("objective_gap"), F.min("seconds").alias("best"))
    wide = results.groupBy(*_KEYS).pivot("solver").agg(F.min("seconds"))
    return wide.join(spread, _KEYS)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each case of two runs: the ratio of its seconds and the change of its objective."""
    keys = [*_KEYS, "solver"]
    old = before.select(*keys, F.col("seconds").alias("seconds_before"), F.col("objective").alias("objective_before"))
    new = after.select(*keys, F.col("seconds").alias("seconds_after"), F.col("objective").alias("objective_after"))
    both = old.join(new, keys, "outer")
    return both.withColumns({"ratio": F.try_divide(F.col("seconds_after"), F.col("seconds_before")), "objective_change": F.col("objective_after") - F.col("objective_before")})
