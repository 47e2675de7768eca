"""Cross-validated choice of the penalty and the L1 share, all folds in one pass a step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import formula as M
from . import moments, solvers
from .glm import GeneralizedLinearRegressor


def fold_column(df: DataFrame, folds: int, order_by: str | list[str], name: str = "_fold") -> tuple[DataFrame, DataFrame]:
    """``df`` with ``name``: contiguous folds in an explicit order, the first n % folds one row longer.

    Rows are numbered without a single-task window: a range partition by the order, the rows
    of each partition counted, and numbers within a partition shifted by the counts before it.
    Also returns the cached table under it, to let go of once the folds have been read.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    sizes = {r.p: r.n for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    base = F.element_at(F.create_map(*(F.lit(x) for p, b in before.items() for x in (int(p), int(b)))), part.cast("int")) if before else F.lit(0)
    row = base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    small, longer = divmod(total, folds)
    cut = longer * (small + 1)
    fold = F.when(row < cut, F.floor(row / max(small + 1, 1))).otherwise(longer + F.floor((row - cut) / max(small, 1)))
    return dealt.withColumn(name, fold.cast("int")).drop("_at"), dealt


def split_mask(splits: list[tuple[Column, Column]]) -> Column:
    """A number whose bits 2k and 2k + 1 say whether a row trains and tests split k."""
    if not 1 <= len(splits) <= 31:
        raise ValueError("cv must have between 1 and 31 splits")
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << (2 * k + side))).otherwise(F.lit(0)).cast("long") for k, split in enumerate(splits) for side, c in enumerate(split)]
    return sum(bits[1:], bits[0])


class GeneralizedLinearRegressorCV(GeneralizedLinearRegressor):
    """A GLM whose ``alpha`` and ``l1_ratio`` have the least mean test deviance over folds.

    ``cv`` is a number of folds (with ``order_by``), the name of a column of fold numbers, a
    Column, or a list of splits: pairs of boolean Columns that say which rows train and which test
    (they may overlap, and need not cover all rows). ``l1_ratio`` may be a list. All folds and
    shares are fitted in the same passes, so ``n_jobs`` is there for compatibility and must be
    None or a number.

    The model is refitted to all rows along the whole path of the chosen ``l1_ratio``: ``predict``
    takes any of its penalties by ``alpha`` or ``alpha_index``, and the chosen one without.
    """

    def __init__(self, *, cv=None, order_by=None, n_jobs=None, l1_ratio=0.0, alphas=None, n_alphas=100, **kwargs):
        super().__init__(l1_ratio=l1_ratio, alphas=alphas, n_alphas=n_alphas, **kwargs)
        self.cv, self.order_by, self.n_jobs = cv, order_by, n_jobs

    def get_params(self, deep=True):
        import inspect

        names = [*inspect.signature(GeneralizedLinearRegressor.__init__).parameters, "cv", "order_by", "n_jobs"]
        return {n: getattr(self, n) for n in names if n != "self"}

    def _validate_penalty(self, demand, number):
        ratios = np.atleast_1d(self.l1_ratio)
        demand(all(number(float(r)) and 0 <= r <= 1 for r in ratios), ValueError, f"l1_ratio must be a number in interval [0, 1]; got (l1_ratio={self.l1_ratio})")
        demand(self.alphas is None or (np.asarray(self.alphas, float) >= 0).all(), ValueError, "alphas must be non-negative")

    def fit(self, df: DataFrame, y=None, sample_weight=None, offset=None, *, features=None, store_covariance_matrix=False, clusters=None, context=None):
        """Fit paths on all folds together, choose, and fit the chosen share's path to all rows."""
        used = {c for c in (y, sample_weight, offset) if isinstance(c, str)}
        kept, pairs = None, False
        if features is None and self.formula is None:
            features = [c for c in df.columns if c not in used | ({self.cv} if isinstance(self.cv, str) else set())]
        if isinstance(self.cv, (str, Column)):
            fold = F.col(self.cv) if isinstance(self.cv, str) else self.cv
            numbers = [r[0] for r in df.select(fold.alias("f")).distinct().orderBy("f").collect()]
            fold = sum((F.when(fold == n, F.lit(k)).otherwise(0) for k, n in enumerate(numbers)), F.lit(0))
            count = len(numbers)
        elif isinstance(self.cv, (list, tuple)):
            fold, count, pairs = split_mask(self.cv), len(self.cv), True
        else:
            count = 5 if self.cv is None else self.cv
            if not isinstance(count, int) or isinstance(count, bool) or count < 2:
                raise ValueError(f"cv must be a number of folds of at least 2, a fold column or a list of splits; got {self.cv!r}")
            if self.order_by is None:
                raise ValueError("order_by must name the columns that order the rows for the folds")
            df, kept = fold_column(df, count, self.order_by)
            fold = F.col("_fold")
        coded = self._prepare(df, y, sample_weight, offset, features, M.captured(context), fold)
        coded.pairs = pairs
        self.covariance_matrix_ = None
        try:
            self._search(coded, count)
            if store_covariance_matrix:
                self.covariance_matrix(df, y, sample_weight, offset, clusters=clusters, store_covariance_matrix=True, context=context)
        finally:
            coded.table.unpersist()
            if kept is not None:
                kept.unpersist()
        return self

    def _search(self, coded, count):
        whole, *parts = self._moments(coded, count)
        self.weight_, self.n_rows_ = whole["weight"], int(whole["rows"])
        constrained, ratios = self._constraints(), [float(r) for r in np.atleast_1d(self.l1_ratio)]
        space = self._space(whole, coded)
        grids, family, link = [], self.family_instance_, self.link_instance_
        null = np.zeros(coded.width + 1)
        null[0] = self._guess(whole) if self.fit_intercept else 0.0
        slope = None
        for r in ratios:
            if self.alphas is not None:
                grids.append(np.sort(np.asarray(self.alphas, float))[::-1])
                continue
            if slope is None:
                got = moments.evaluate(coded, family, link, [moments.Request([space.inward(null)], "gradient")])[0]
                slope = np.abs(space.gradient(got.gradient)[1:] / whole["weight"])
            grids.append(self._grid(slope, space, self._penalties(r)[0], r, whole["rows"]))
        runs = []
        for r, grid in zip(ratios, grids):
            p1, p2 = self._penalties(r)
            name = self._solver_name(bool(p1.any()), constrained)
            for k, m in enumerate(parts):
                # Rows are centred at the means of all rows; a fold's own means enter by the shift.
                own = self._space(m, coded)
                own.shift = own.mean.copy()
                if self.fit_intercept:
                    dense = coded.dense_places()
                    own.shift[dense] = own.mean[dense] - coded.centres[dense]
                problems = [self._problem(own, m["weight"], a, p1, p2, constrained, name, fold=k) for a in grid]
                runs.append((own, solvers.along(name, problems, self._start(own, m, constrained))))
        paths = solvers.run(coded, family, link, [c for _, c in runs])
        requests = [moments.Request([own.inward(b) for b, _ in path], "", n % count, test) for n, ((own, _), path) in enumerate(zip(runs, paths)) for test in (True, False)]
        answers = moments.evaluate(coded, family, link, requests)
        inside = [m["test_weight"] for m in parts]
        shape = (len(ratios), count, len(grids[0]))
        test = np.array([np.array(a.deviances) / inside[n % count] for n, a in enumerate(answers[0::2])]).reshape(shape)
        train = np.array([np.array(a.deviances) / parts[n % count]["weight"] for n, a in enumerate(answers[1::2])]).reshape(shape)
        self.deviance_path_, self.train_deviance_path_ = test.transpose(1, 0, 2), train.transpose(1, 0, 2)
        mean = test.mean(axis=1)
        best, at = np.unravel_index(int(np.argmin(mean)), mean.shape)
        self.alphas_, self.l1_ratio_, self.alpha_ = np.array(grids), ratios[best], float(grids[best][at])
        self.n_folds_ = count
        p1, p2 = self._penalties(self.l1_ratio_)
        self._alphas, name = grids[best], self._solver_name(bool(p1.any()), constrained)
        problems = [self._problem(space, whole["weight"], a, p1, p2, constrained, name) for a in grids[best]]
        path = solvers.run(coded, family, link, [solvers.along(name, problems, self._start(space, whole, constrained))])[0]
        outward = [space.outward(b) for b, _ in path]
        self.intercept_path_ = np.array([i if self.fit_intercept else 0.0 for i, _ in outward])
        self.coef_path_ = np.array([c for _, c in outward])
        self.intercept_, self.coef_, self.n_iter_, self.solver_ = float(self.intercept_path_[at]), self.coef_path_[at], path[at][1], name
        self.fold_coefs_ = [[(own.outward(b)) for b, _ in path] for (own, _), path in zip(runs, paths)]
        self.fold_coef_path_ = np.array([c for path in self.fold_coefs_ for _, c in path]).reshape(*shape, -1).transpose(1, 0, 2, 3)
        self.diagnostics_ = [d for p in problems for d in p.diagnostics]
        self._log()

    def cv_table(self, spark) -> DataFrame:
        """Deviances of all fits: ``fold, l1_ratio, alpha_index, alpha, test_deviance, train_deviance``."""
        rows = []
        for k in range(self.n_folds_):
            for i, r in enumerate(np.atleast_1d(self.l1_ratio)):
                for j, a in enumerate(self.alphas_[i]):
                    rows.append((k, float(r), j, float(a), float(self.deviance_path_[k, i, j]), float(self.train_deviance_path_[k, i, j])))
        return spark.createDataFrame(rows, "fold int, l1_ratio double, alpha_index int, alpha double, test_deviance double, train_deviance double")
