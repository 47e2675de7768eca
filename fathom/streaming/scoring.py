"""Scoring of streams and mergeable least squares. Extras: the models themselves are fitted in batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators import moments


def score_stream(model, stream: DataFrame, **kwargs) -> DataFrame:
    """A prediction is a projection, so it applies to a stream as it is."""
    return model.predict(stream, **kwargs)


class RunningLeastSquares:
    """Ridge regression over micro-batches: sums of squares and products add up.

    Use :meth:`update` as a ``foreachBatch`` function; a batch number already seen is skipped.
    """

    def __init__(self, features: list[str], y: str, alpha: float = 0.0):
        self.features, self.y, self.alpha = features, y, alpha
        k = len(features) + 1
        self.gram, self.moment, self.rows, self.last = np.zeros((k, k)), np.zeros(k), 0, -1

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        names, y, k = self.features, self.y, len(self.features) + 1

        def partial(b):
            x = np.column_stack([np.ones(b.num_rows), *(b.column(n).to_numpy() for n in names)])
            return np.concatenate([(x.T @ x).ravel(), x.T @ b.column(y).to_numpy(), [b.num_rows]])

        total = moments.summed(batch.selectExpr(*(f"cast(`{n}` as double) `{n}`" for n in [*names, y])), partial, k * k + k + 1)
        self.gram += total[: k * k].reshape(k, k)
        self.moment += total[k * k : -1]
        self.rows, self.last = self.rows + int(total[-1]), number

    def coefficients(self) -> np.ndarray:
        penalty = self.alpha * self.rows * np.diag([0.0] + [1.0] * len(self.features))
        return np.linalg.lstsq(self.gram + penalty, self.moment, rcond=None)[0]
