"""Generalized linear models on DataFrames: fit, path, predict, score, inference."""

from __future__ import annotations

import json
import logging
import math
import numbers
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import BinomialFamily, NormalFamily, get_family
from ..functions.links import CloglogLink, IdentityLink, LogitLink, LogLink, get_link
from ..functions.maths import chi2_tail, normal_quantile, normal_tails
from ..plans import design as D
from ..plans import formula as M
from ..plans import monotone
from . import moments, solvers

SOLVERS = ("auto", "irls-ls", "irls-cd", "lbfgs", "trust-constr", "closed-form", "irls-ls-monotonic")

#: The parts of messages that callers match on; what follows them is ours.
SAYS = {
    "gradient_tol": "Tolerance for the gradient stopping",
    "step_size_tol": "Tolerance for the step-size stopping",
    "shape": "must be 1D array or scalar",
    "no_data": "Either X and y must be provided",
    "other_options": "Cannot reestimate the covariance matrix with different",
    "overwritten": "A covariance matrix has already been computed.",
    "penalised": "Covariance matrix estimation assumes",
    "ridge": "There is no",
}


class WaldTestResult(NamedTuple):
    test_statistic: float
    p_value: float
    df: int


def _column(c, default) -> Column:
    if c is None:
        return F.lit(float(default))
    if not isinstance(c, (numbers.Real, Column, str)):
        raise ValueError(f"a response, weight or offset {SAYS['shape']}: a column's name, a Column or a number; got {type(c).__name__}")
    if isinstance(c, numbers.Real) and not math.isfinite(c):
        raise ValueError(f"a weight or offset must be finite; got {c}")
    return F.lit(float(c)) if isinstance(c, numbers.Real) else (c if isinstance(c, Column) else F.col(f"`{c}`")).cast("double")


class GeneralizedLinearRegressor:
    """A penalised GLM: ``deviance / (2 sum of weights) + alpha (l1_ratio |P1 w| + (1 - l1_ratio) w'P2w / 2)``.

    Feature, response, weight and offset are columns of one DataFrame: ``fit(df, y="y",
    sample_weight="w", offset="o", features=[...])`` or ``formula="y ~ a + C(b)"``.
    """

    def __init__(
        self, *, alpha=None, l1_ratio=0.0, P1="identity", P2="identity", fit_intercept=True, family="normal", link="auto", solver="auto", max_iter=100, max_inner_iter=100_000,
        gradient_tol=None, step_size_tol=None, hessian_approx=0.0, warm_start=False, alpha_search=False, alphas=None, n_alphas=100, min_alpha_ratio=None, min_alpha=None,
        start_params=None, selection="cyclic", random_state=None, copy_X=None, check_input=True, verbose=0, scale_predictors=False, lower_bounds=None, upper_bounds=None,
        A_ineq=None, b_ineq=None, monotonic_constraints=None, force_all_finite=True, drop_first=False, robust=True, expected_information=False, formula=None,
        interaction_separator=":", categorical_format="{name}[{category}]", cat_missing_method="fail", cat_missing_name="(MISSING)", categorical_levels=None,
    ):
        for name, value in list(locals().items()):
            if name != "self":
                setattr(self, name, value)

    _own = ("alpha", "l1_ratio")

    def get_params(self, deep=True) -> dict:
        import inspect

        return {n: getattr(self, n) for n in inspect.signature(type(self).__init__).parameters if n != "self"}

    def set_params(self, **params):
        for name, value in params.items():
            if name not in self.get_params():
                raise ValueError(f"Invalid parameter {name}")
            setattr(self, name, value)
        return self

    @property
    def family_instance(self):
        """The family as an object, also before a fit."""
        return getattr(self, "family_instance_", None) or get_family(self.family)

    @property
    def link_instance(self):
        return getattr(self, "link_instance_", None) or get_link(self.link, self.family_instance)

    @property
    def categorical_levels_(self) -> dict[str, list[str]]:
        """The levels of each categorical variable of the fitted design."""
        if not hasattr(self, "design_"):
            raise AttributeError("the model has no levels before a fit")
        return {f.variable: list(map(str, f.levels)) for f in self.design_.factors() if f.categorical}

    # -- checks ------------------------------------------------------------------------

    def _validate(self):
        def demand(ok, kind, text):
            if not ok:
                raise kind(text)

        positive = lambda x: isinstance(x, numbers.Integral) and not isinstance(x, bool) and x > 0
        number = lambda x: isinstance(x, numbers.Real) and not isinstance(x, bool)
        demand(isinstance(self.fit_intercept, bool), TypeError, f"The argument fit_intercept must be bool; got {self.fit_intercept}")
        demand(self.solver in SOLVERS, ValueError, f"solver must be one of {SOLVERS}; got {self.solver!r}")
        demand(positive(self.max_iter), ValueError, f"Maximum number of iterations must be a positive integer; got max_iter={self.max_iter!r}")
        demand(self.gradient_tol is None or number(self.gradient_tol) and self.gradient_tol > 0, ValueError, f"{SAYS['gradient_tol']} rule: a positive number or None")
        demand(self.step_size_tol is None or number(self.step_size_tol) and self.step_size_tol > 0, ValueError, f"{SAYS['step_size_tol']} rule: a positive number or None")
        demand(positive(self.max_inner_iter), ValueError, f"max_inner_iter must be a positive integer; got {self.max_inner_iter!r}")
        demand(number(self.hessian_approx) and 0 <= self.hessian_approx <= 1, ValueError, f"hessian_approx must be a number in interval [0, 1]; got {self.hessian_approx!r}")
        demand(positive(self.n_alphas), ValueError, f"n_alphas must be a positive integer; got {self.n_alphas!r}")
        demand(self.min_alpha_ratio is None or number(self.min_alpha_ratio) and 0 < self.min_alpha_ratio < 1, ValueError, f"min_alpha_ratio must be a number between 0 and 1; got {self.min_alpha_ratio!r}")
        demand(self.min_alpha is None or number(self.min_alpha) and self.min_alpha > 0, ValueError, f"min_alpha must be a positive number; got {self.min_alpha!r}")
        demand(self.random_state is None or isinstance(self.random_state, numbers.Integral), TypeError, f"random_state must be None or an integer; got {self.random_state!r}")
        demand(isinstance(self.force_all_finite, bool), TypeError, f"force_all_finite must be bool; got {self.force_all_finite!r}")
        demand(isinstance(self.verbose, (bool, numbers.Integral)) and self.verbose >= 0, ValueError, f"verbose must be a non-negative integer; got {self.verbose!r}")
        demand(isinstance(self.warm_start, bool), TypeError, f"The argument warm_start must be bool; got {self.warm_start}")
        demand(self.selection in ("cyclic", "random"), ValueError, f"The argument selection must be 'cyclic' or 'random'; got {self.selection!r}")
        demand(self.copy_X is None or isinstance(self.copy_X, bool), TypeError, f"The argument copy_X must be None or bool; got {self.copy_X}")
        demand(isinstance(self.check_input, bool), TypeError, f"The argument check_input must be bool; got {self.check_input}")
        demand(not self.scale_predictors or self.fit_intercept, ValueError, "scale_predictors needs an intercept")
        bounded = self.lower_bounds is not None or self.upper_bounds is not None
        inequal = self.A_ineq is not None or self.b_ineq is not None
        l1 = self.l1_ratio if not isinstance(self.l1_ratio, (list, tuple, np.ndarray)) else max(self.l1_ratio)
        demand(not bounded or self.solver in ("auto", "irls-cd"), ValueError, "bounds need solver='auto' or 'irls-cd'")
        demand(not inequal or self.solver in ("auto", "trust-constr", "irls-ls-monotonic"), ValueError, "inequalities need solver='auto', 'trust-constr' or 'irls-ls-monotonic'")
        demand((self.A_ineq is None) == (self.b_ineq is None), ValueError, "A_ineq and b_ineq come together")
        demand(not (bounded and inequal), ValueError, "bounds and inequalities exclude each other")
        if self.monotonic_constraints is not None:
            demand(self.solver in ("auto", "trust-constr", "irls-ls-monotonic"), ValueError, "monotonic_constraints need solver='auto', 'irls-ls-monotonic' or 'trust-constr'")
            demand(isinstance(self.monotonic_constraints, dict) and self.monotonic_constraints, TypeError, "monotonic_constraints must be a non-empty mapping")
            demand(not inequal and not bounded, ValueError, "monotonic_constraints cannot be combined with other constraints")
            demand(self.formula is not None, ValueError, "monotonic_constraints need a formula")
            demand(not l1, ValueError, "monotonic_constraints need l1_ratio=0")
        if not isinstance(self.P1, str):
            demand((np.asarray(self.P1, float) >= 0).all(), ValueError, "P1 must not have negative values.")
        self._validate_penalty(demand, number)

    def _validate_penalty(self, demand, number):
        alphas = self.alpha if isinstance(self.alpha, (list, tuple, np.ndarray)) else [0 if self.alpha is None else self.alpha]
        demand(all(number(a) and a >= 0 for a in alphas), ValueError, f"Penalty term must be a non-negative number; got (alpha={self.alpha})")
        demand(number(self.l1_ratio) and 0 <= self.l1_ratio <= 1, ValueError, f"l1_ratio must be a number in interval [0, 1]; got (l1_ratio={self.l1_ratio})")
        if not self.alpha_search:
            demand(not isinstance(self.alpha, (list, tuple, np.ndarray)), ValueError, "alpha must be a number unless alpha_search=True")

    # -- set-up ------------------------------------------------------------------------

    def _prepare(self, df: DataFrame, y, sample_weight, offset, features, context, fold: Column | None = None):
        """Design, coded table and profile of a fit; sets the fitted schema."""
        self._validate()
        self.family_instance_ = get_family(self.family)
        self.link_instance_ = get_link(self.link, self.family_instance_)
        options = {"drop_first": self.drop_first, "levels": self.categorical_levels, "format": self.categorical_format, "missing_method": self.cat_missing_method, "missing_name": self.cat_missing_name}
        if self.formula is not None:
            left, terms, says = M.parse(self.formula)
            if says is not None and says != self.fit_intercept and not says:
                raise ValueError(f"The formula sets the intercept to {says}, contradicting fit_intercept={self.fit_intercept}.")
            self.design_ = M.to_design(df, terms, intercept=self.fit_intercept, context=context, separator=self.interaction_separator, **options)
            y = M.expression(left.strip("{} "), df.columns, context) if left else y
            source = [t for t, _, _ in self.design_.terms]
        else:
            used = {c for c in (y, sample_weight, offset) if isinstance(c, str)}
            source = list(features) if features is not None else [c for c in df.columns if c not in used]
            self.design_ = D.from_columns(df, source, **options)
        if y is None:
            raise ValueError("y is needed")
        self.feature_names_, self.term_names_ = self.design_.feature_names(), self.design_.term_names()
        self.source_ = source
        extra = [_column(y, 0).alias("y"), _column(sample_weight, 1).alias("w"), _column(offset, 0).alias("o")]
        table, layout = self.design_.encoded(df, extra + ([fold.alias("fold")] if fold is not None else []))
        coded = moments.Coded(moments.cached(table), layout)
        if self.check_input:
            self._check_rows(coded.table, layout)
        return coded

    def _check_rows(self, table: DataFrame, layout):
        bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        values = [v for v, _, _ in layout if v]
        anything = bad("y") | bad("w") | bad("o")
        for v in values:
            anything = anything | bad(v)
        # The same job gives the dense columns' means, about which the moments are taken later.
        places, at = {}, 0
        for value, code, size in layout:
            if code is None:
                places[at] = value
            at += size
        means = {f"mean_{k}": F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum("w")) for k, v in places.items()} if len(places) <= 100 else {}
        used = F.when(F.col("w") > 0, F.col("y"))
        got = moments.profile(table, {"bad": F.max(anything), "least_w": F.min("w"), "sum_w": F.sum("w"), "outside": F.max(~self.family_instance_.in_y_range(F.col("y"))), "n": F.count("*"), "low": F.min(used), "high": F.max(used), **means})
        self._profile = {"constant": got["low"] == got["high"], "centres": {k: got[f"mean_{k}"] for k in places} if means or not places else None}
        if not got["n"]:
            raise ValueError("there is no row to fit")
        if got["bad"] and self.force_all_finite:
            raise ValueError("Input contains NaN, infinity or a null value.")
        if got["least_w"] < 0:
            raise ValueError("Sample weights must be non-negative.")
        if not got["sum_w"] > 0:
            raise ValueError("Sample weights must not all be zero.")
        if got["outside"]:
            raise ValueError(f"Some value(s) of y are out of the valid range for family {type(self.family_instance_).__name__}")

    def _penalties(self, l1_ratio):
        k = len(self.feature_names_)
        p1 = D.expand_penalty(self.P1, self.source_, self.design_)
        p1 = np.ones(k) if isinstance(p1, str) or p1 is None else np.asarray(p1, float)
        p2 = D.expand_penalty(self.P2, self.source_, self.design_) if not isinstance(self.P2, str) and np.ndim(self.P2) == 1 else self.P2
        p2 = np.eye(k) if isinstance(p2, str) or p2 is None else np.asarray(p2, float)
        p2 = np.diag(p2) if p2.ndim == 1 else (p2 + p2.T) / 2
        if p1.shape != (k,) or p2.shape != (k, k):
            raise ValueError(f"P1 and P2 must fit the {k} columns of the design")
        if np.linalg.eigvalsh(p2).min(initial=0) < -10 * np.finfo(float).epsneg:
            raise ValueError("P2 must be positive semi-definite.")
        return l1_ratio * p1, (1 - l1_ratio) * p2

    def _constraints(self):
        k = len(self.feature_names_)
        lower = upper = None
        if self.lower_bounds is not None or self.upper_bounds is not None:

            def full(x, default):
                if x is None or np.ndim(x) == 0:
                    return np.full(k, default if x is None else float(x))
                x = np.asarray(D.expand_penalty(list(x), self.source_, self.design_) if len(x) != k else x, float)
                if x.shape != (k,) or np.isnan(x).any():
                    raise ValueError(f"bounds must be numbers or have a value for each of the {k} columns, infinite ones where there is none")
                return x

            lower, upper = full(self.lower_bounds, -np.inf), full(self.upper_bounds, np.inf)
            if (lower > upper).any():
                raise ValueError("some lower bounds are above the upper bounds")
        a, b = self.A_ineq, self.b_ineq
        if self.monotonic_constraints:
            a, b = monotone.rows(self.design_, self.monotonic_constraints)
        if a is not None:
            a, b = np.asarray(a, float), np.asarray(b, float)
            if a.ndim != 2 or a.shape[1] != k or b.shape != (len(a),):
                raise ValueError("A_ineq must be 2D with a column for each feature and b_ineq 1D with its rows")
        return lower, upper, a, b

    def _solver_name(self, l1, constrained) -> str:
        normal = self.family_instance_ == NormalFamily() and self.link_instance_ == IdentityLink()
        if self.solver != "auto":
            if self.solver == "closed-form" and not (normal and not l1):
                raise ValueError("solver=closed-form needs a normal family, an identity link and no L1 penalty")
            if l1 and self.solver not in ("irls-cd", "trust-constr"):
                raise ValueError(f"solver={self.solver} has no L1 penalty: irls-cd has")
            return self.solver
        if self.monotonic_constraints:
            return "irls-ls-monotonic"
        if constrained[2] is not None:
            return "trust-constr"
        if constrained[0] is not None:
            return "irls-cd"
        return "irls-cd" if l1 else "closed-form" if normal else "irls-ls"

    def _space(self, m: dict, coded) -> solvers.Space:
        return solvers.Space(m["mean"], m["std"], coded.dense_places(), self.fit_intercept)

    def _problem(self, space, weight, alpha, p1, p2, constrained, name, fold=None) -> solvers.Problem:
        lower, upper, a, b = constrained
        s = space.scale
        p1, p2 = alpha * p1, alpha * p2
        if not self.scale_predictors:
            p1, p2 = p1 * s, p2 * np.outer(s, s)
        tol = self.gradient_tol if self.gradient_tol is not None else 1e-8 if name == "trust-constr" else 1e-4
        normal = self.family_instance_ == NormalFamily() and self.link_instance_ == IdentityLink()
        return solvers.Problem(
            space, weight, p1, p2, None if lower is None else lower / s, None if upper is None else upper / s, None if a is None else a * s, b, fold, tol, self.step_size_tol,
            self.max_iter, self.max_inner_iter, self.selection, self.random_state, normal and a is None and lower is None, getattr(self, "n_rows_", 0),
        )

    def _start(self, space, m: dict, constrained) -> np.ndarray:
        k = len(self.feature_names_)
        if self.warm_start and hasattr(self, "coef_"):
            beta = space.from_outward(self.intercept_, self.coef_)
        elif self.start_params is not None:
            given = np.asarray(self.start_params, float)
            beta = space.from_outward(given[0], given[1:]) if self.fit_intercept else np.concatenate([[0.0], given / space.scale])
        else:
            beta = np.zeros(k + 1)
            if self.fit_intercept:
                beta[0] = self._guess(m)
        if constrained[0] is not None:
            beta[1:] = np.clip(beta[1:], constrained[0] / space.scale, constrained[1] / space.scale)
        if constrained[2] is not None and (constrained[2] @ (beta[1:] * space.scale) > constrained[3]).any():
            beta[1:] = 0.0
        return beta

    def _guess(self, m: dict) -> float:
        """The intercept that fits best beside the offset alone, as far as a closed form says so.

        Under a log link that is the log of a ratio of two sums with the powers of exp(offset) that
        the family's variance asks for; under the others the mean's link less the mean offset.
        """
        y, o, link = m["y"], m["offset"], self.link_instance_
        if isinstance(link, (LogLink, LogitLink, CloglogLink)) and m.get("constant"):
            raise ValueError("No variation in `y`. Coefficients can't be estimated.")
        mean = np.float64(y)
        if isinstance(link, LogLink) and m.get("log_start") is not None and math.isfinite(m["log_start"]):
            return m["log_start"]
        if isinstance(self.family_instance_, BinomialFamily) or isinstance(link, (LogitLink, CloglogLink)):
            mean = np.clip(mean, 1e-10, 1 - 1e-10)
        return float(link.link(mean)) - o if link != IdentityLink() else float(mean) - o

    def _log_power(self) -> float | None:
        """The power of the family's variance, 1 if it is no power; None under other links than the log."""
        p = getattr(self.family_instance_, "p", None)
        return (1.0 if p is None else float(p)) if isinstance(self.link_instance_, LogLink) else None

    def _moments(self, coded, folds=0) -> list[dict]:
        known = getattr(self, "_profile", None) if self.check_input else None
        if self.fit_intercept:
            coded.centres = np.zeros(coded.width)
            if known and known["centres"] is not None:
                for place, mean in known["centres"].items():
                    coded.centres[place] = mean
            else:
                coded.centres = moments.column_moments(coded, 0)[0]["mean"]
        out = moments.column_moments(coded, folds, self._log_power())  # the second moments about the means
        out[0]["mean"][coded.dense_places()] = coded.centres[coded.dense_places()] if self.fit_intercept else out[0]["mean"][coded.dense_places()]
        if not isinstance(self.link_instance_, IdentityLink):
            if known is None:
                row = coded.table.where("w > 0").agg(F.min("y"), F.max("y")).first()
                known = {"constant": row[0] == row[1]}
            out[0]["constant"] = known["constant"]
        return out

    # -- fit ---------------------------------------------------------------------------

    def fit(self, df: DataFrame, y=None, sample_weight=None, offset=None, *, features=None, store_covariance_matrix=False, clusters=None, context=None):
        """Fit to the rows of ``df``; columns are given by name, weight and offset also as numbers."""
        coded = self._prepare(df, y, sample_weight, offset, features, M.captured(context))
        self._args = {"y": y, "sample_weight": sample_weight, "offset": offset}
        self.covariance_matrix_, self._info = None, {}
        try:
            m = self._moments(coded)[0]
            self.weight_, self.n_rows_ = m["weight"], int(m["rows"])
            space, constrained = self._space(m, coded), self._constraints()
            p1, p2 = self._penalties(self.l1_ratio)
            alpha = 0.0 if self.alpha is None else self.alpha
            search = self.alpha_search or isinstance(alpha, (list, tuple, np.ndarray))
            name = self._solver_name(p1.any() and (search or alpha > 0), constrained)
            start = self._start(space, m, constrained)
            if search:
                given = self.alphas if self.alphas is not None else alpha if np.ndim(alpha) else None
                self._alphas = np.sort(np.asarray(given, float))[::-1] if given is not None else self.alpha_grid(coded, space, m, p1, self.l1_ratio)
            else:
                self._alphas = np.array([alpha])
            problems = [self._problem(space, m["weight"], a, p1, p2, constrained, name) for a in self._alphas]
            path = solvers.run(coded, self.family_instance_, self.link_instance_, [solvers.along(name, problems, start)])[0]
            outward = [space.outward(b) for b, _ in path]
            self.solver_, self.n_iter_ = name, path[-1][1]
            self.diagnostics_ = [d for p in problems for d in p.diagnostics]
            self.intercept_path_ = np.array([i if self.fit_intercept else 0.0 for i, _ in outward])
            self.coef_path_ = np.array([c for _, c in outward])
            self.intercept_, self.coef_ = float(self.intercept_path_[-1]), self.coef_path_[-1]
            self._log()
            if store_covariance_matrix:
                self.covariance_matrix(df, y, sample_weight, offset, clusters=clusters, store_covariance_matrix=True, context=context)
        finally:
            coded.table.unpersist()
        return self

    def alpha_grid(self, coded, space, m, p1, l1_ratio) -> np.ndarray:
        """Penalties from the one that leaves no coefficient down, evenly by logarithm."""
        null = np.zeros(len(p1) + 1)
        null[0] = self._guess(m) if self.fit_intercept else 0.0
        answer = moments.evaluate(coded, self.family_instance_, self.link_instance_, [moments.Request([space.inward(null)], "gradient")])[0]
        return self._grid(np.abs(space.gradient(answer.gradient)[1:] / m["weight"]), space, p1, l1_ratio, m["rows"])

    def _grid(self, slope, space, p1, l1_ratio, rows):
        if l1_ratio:
            weight = p1 if self.scale_predictors else p1 * space.scale
            most = (slope[weight > 0] / weight[weight > 0]).max() if (weight > 0).any() else 0.0
        else:
            most = slope.max() / 0.001
        most = most or 10.0
        least = self.min_alpha if self.min_alpha is not None else most * (self.min_alpha_ratio if self.min_alpha_ratio is not None else 1e-6 if rows >= len(p1) else 1e-2)
        return np.logspace(math.log10(most), math.log10(least), self.n_alphas)

    # -- use ---------------------------------------------------------------------------

    def _index(self, alpha, alpha_index):
        if alpha is None and alpha_index is None:
            return None
        if alpha is not None and alpha_index is not None:
            raise ValueError("Please specify only one of {alpha_index, alpha}.")
        if not (self.alpha_search or hasattr(self, "l1_ratio_")):
            raise ValueError("alpha and alpha_index need alpha_search=True")
        if alpha_index is not None:
            one = range(len(self._alphas))[alpha_index] if not np.ndim(alpha_index) else [range(len(self._alphas))[i] for i in alpha_index]
            return one

        def place(a):
            found = np.flatnonzero(np.isclose(self._alphas, a, atol=0))
            if not len(found):
                raise IndexError(f"Could not determine a unique index for alpha={a}.")
            return int(found[0])

        return [place(a) for a in alpha] if np.ndim(alpha) else place(alpha)

    def linear_predictor(self, df: DataFrame, offset=None, *, alpha_index=None, alpha=None, column="linear_predictor", context=None) -> DataFrame:
        """``df`` with the linear predictor: a lazy projection, an array for several alphas.

        A fitted formula holds its functions as expressions, so names of ``context`` are needed at the
        fit only; those given here are checked and change nothing.
        """
        M.captured(context)
        at = self._index(alpha, alpha_index)
        several = isinstance(at, list)
        models = [(self.intercept_, self.coef_)] if at is None else [(self.intercept_path_[i], self.coef_path_[i]) for i in (at if several else [at])]
        kept, parts, out = df.columns, [], df
        for k, (intercept, coef) in enumerate(models):
            if k == 0:
                out, eta = self.design_.predictor(out, coef, intercept)
            else:
                _, eta = self.design_.predictor(out, coef, intercept)
            parts.append(eta if offset is None else eta + _column(offset, 0))
        return out.select(*(f"`{c}`" for c in kept if c != column), (F.array(*parts) if several else parts[0]).alias(column))

    def predict(self, df: DataFrame, sample_weight=None, offset=None, *, alpha_index=None, alpha=None, column="prediction", context=None) -> DataFrame:
        """``df`` with the mean, times the weight if one is given; works on streams too."""
        out = self.linear_predictor(df, offset, alpha_index=alpha_index, alpha=alpha, column="_eta", context=context)
        w = F.lit(1.0) if sample_weight is None else _column(sample_weight, 1)
        mean = F.transform("_eta", lambda e: self.link_instance_.inverse(e) * w) if isinstance(out.schema["_eta"].dataType, D.T.ArrayType) else self.link_instance_.inverse(F.col("_eta")) * w
        return out.withColumn(column, mean).drop("_eta")

    def _with_mu(self, df, y, sample_weight, offset) -> DataFrame:
        out = self.predict(df, offset=offset, column="_mu")
        return out.select(self._y(df, y).alias("y"), _column(sample_weight, 1).alias("w"), F.col("_mu").alias("mu"))

    def _y(self, df, y, context=None):
        if y is None and self.formula is not None and "~" in self.formula:
            return M.expression(M.parse(self.formula)[0].strip("{} "), df.columns, context).cast("double")
        return _column(y, 0)

    def score(self, df: DataFrame, y=None, sample_weight=None, offset=None) -> float:
        """Share of the deviance of the mean model that the model explains."""
        rows, f = self._with_mu(df, y, sample_weight, offset), self.family_instance_
        mean = df.agg((F.sum(_column(sample_weight, 1) * self._y(df, y)) / F.sum(_column(sample_weight, 1))).alias("m")).first().m
        got = rows.agg(f.deviance(F.col("y"), F.col("mu"), F.col("w")).alias("d"), f.deviance(F.col("y"), F.lit(float(mean)), F.col("w")).alias("n")).first()
        return 1 - got.d / got.n

    # -- inference ---------------------------------------------------------------------

    def covariance_matrix(self, df=None, y=None, sample_weight=None, offset=None, *, dispersion=None, robust=None, clusters=None, expected_information=None, store_covariance_matrix=False, context=None) -> np.ndarray:
        """Covariance of (intercept, coefficients): classical, robust (HC1) or clustered."""
        context = M.captured(context)
        options = {k: v for k, v in (("dispersion", dispersion), ("robust", robust), ("clusters", clusters), ("expected_information", expected_information)) if v is not None}
        if df is None:
            if getattr(self, "covariance_matrix_", None) is None:
                raise ValueError(f"{SAYS['no_data']}: no covariance matrix is stored")
            if options:
                raise ValueError(f"{SAYS['other_options']} options from the stored one: give the data")
            return self.covariance_matrix_
        if getattr(self, "covariance_matrix_", None) is not None and store_covariance_matrix:
            warnings.warn(f"{SAYS['overwritten']} The new one takes its place.", stacklevel=2)
        if self.alpha or self.alpha_search or hasattr(self, "l1_ratio_"):
            warnings.warn(f"{SAYS['penalised']} an unpenalised model; under a penalty, errors and tests are off.", stacklevel=2)
        robust = self.robust if robust is None else robust
        expected = self.expected_information if expected_information is None else expected_information
        key = None if clusters is None else (F.col(f"`{clusters}`") if isinstance(clusters, str) else clusters).cast("string")
        extra = [self._y(df, y, context).alias("y"), _column(sample_weight, 1).alias("w"), _column(offset, 0).alias("o")] + ([key.alias("cluster")] if key is not None else [])
        table, layout = self.design_.encoded(df, extra)
        coded = moments.Coded(moments.cached(table), layout, np.zeros(len(self.coef_)))
        try:
            out = self._covariance(coded, dispersion, robust or clusters is not None, clusters is not None, expected)
        finally:
            coded.table.unpersist()
        if store_covariance_matrix:
            self.covariance_matrix_ = out
        return out

    def _covariance(self, coded, dispersion, robust, clustered, expected):
        k, layout, centres = len(self.coef_) + 1, coded.layout, coded.centres
        coef = np.concatenate([[self.intercept_], self.coef_])
        family, link = self.family_instance_, self.link_instance_

        def partial(batch):
            rows = moments.batch_rows(batch, layout, centres)
            eta = rows.predictor(coef)
            mu = link.inverse(eta)
            weight = family.observed_weight(link, rows.y, eta, mu, rows.w) if robust and not expected else family.fisher_weight(link, eta, mu, rows.w)
            pearson = np.sum(rows.w * (rows.y - mu) ** 2 / family.unit_variance(mu))
            meat = np.zeros((k, k))
            if robust and not clustered:
                meat = rows.gram(family.score_weight(link, rows.y, eta, mu, rows.w) ** 2)
            return np.concatenate([[rows.w.sum(), pearson], rows.gram(weight).ravel(), meat.ravel(), rows.gram(np.ones(len(rows.y))).ravel()])

        sums = moments.summed(coded.table, partial, 2 + 3 * k * k)
        total, pearson = sums[:2]
        information, meat, plain = sums[2:].reshape(3, k, k)
        use = slice(0 if self.fit_intercept else 1, k)
        information, meat, plain = information[use, use], meat[use, use], plain[use, use]
        if np.linalg.cond(plain) > 1 / np.finfo(float).eps ** 2:
            raise np.linalg.LinAlgError("Matrix is singular. Cannot estimate standard errors.")
        free = total - len(information)
        if not robust:
            phi = dispersion if dispersion is not None else pearson / free
            return phi * np.linalg.inv(information) * total / free
        factor = total / free
        if clustered:
            groups, meat = self._cluster_meat(coded, coef)
            meat = meat[use, use]
            factor = groups / (groups - 1) * (total - 1) / free
        return np.linalg.solve(information, np.linalg.solve(information, meat).T) * factor

    def _cluster_meat(self, coded, coef):
        """Number of clusters and the sum of outer products of their scores: scores are summed
        within batches before they are dealt by cluster, so a hot cluster moves one row a batch."""
        import pyarrow as pa

        k, layout, centres, family, link = len(coef), coded.layout, coded.centres, self.family_instance_, self.link_instance_

        def by_key(keys: pa.Array, scores: np.ndarray):
            """The sum of scores of each key, in the order of its first row."""
            coded_keys = keys.dictionary_encode()
            at = coded_keys.indices.fill_null(len(coded_keys.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.add.reduceat(scores[order], firsts, axis=0) if len(firsts) else scores[:0]
            names = coded_keys.dictionary.to_pylist()
            return [names[k] if k < len(names) else None for k in at[order][firsts].tolist()], sums

        def partial(batches):
            for batch in batches:
                # Scores are dense rows, so only some millions of numbers of them at once.
                for start in range(0, batch.num_rows, max(1, (4 << 20) // k)):
                    part = batch.slice(start, max(1, (4 << 20) // k))
                    rows = moments.batch_rows(part, layout, centres)
                    eta = rows.predictor(coef)
                    names, sums = by_key(part.column("cluster"), rows.scores(family.score_weight(link, rows.y, eta, link.inverse(eta), rows.w)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), _lists(sums)], ["cluster", "s"])

        def _lists(rows: np.ndarray):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(rows.ravel()))

        def squares(batches):
            """Rows sorted by cluster: only the one that may go on is held."""
            groups, total = 0, np.zeros((k, k))
            name, held = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                names, sums = by_key(batch.column("cluster"), batch.column("s").flatten().to_numpy().reshape(-1, k))
                if held is not None and names[0] == name:
                    sums[0] += held
                elif held is not None:
                    groups, total = groups + 1, total + np.outer(held, held)
                groups, total = groups + len(names) - 1, total + sums[:-1].T @ sums[:-1]
                name, held = names[-1], sums[-1]
            if held is not None:
                groups, total = groups + 1, total + np.outer(held, held)
            yield pa.RecordBatch.from_arrays([pa.array([groups]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "m"])

        schema = "cluster string, s array<double>"
        parts = coded.table.mapInArrow(partial, schema).repartition("cluster").sortWithinPartitions("cluster").mapInArrow(squares, "n long, m array<double>").collect()
        return sum(p.n for p in parts), sum(np.array(p.m) for p in parts).reshape(k, k)

    def std_errors(self, *args, **kwargs) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance_matrix(*args, **kwargs)))

    def _named(self):
        names = (["intercept"] if self.fit_intercept else []) + list(self.feature_names_)
        return names, np.concatenate([[self.intercept_] if self.fit_intercept else [], self.coef_])

    def coef_table(self, df=None, y=None, sample_weight=None, offset=None, *, spark=None, confidence_level=0.95, **kwargs):
        """Coefficients, errors, normal test values and intervals as a DataFrame."""
        import pandas as pd

        names, beta = self._named()
        if df is None and getattr(self, "covariance_matrix_", None) is None:
            out = pd.DataFrame({"name": names, "coef": beta})
        else:
            se = self.std_errors(df, y, sample_weight, offset, **kwargs)
            t, z = beta / se, normal_quantile(0.5 + confidence_level / 2)
            out = pd.DataFrame({"name": names, "coef": beta, "se": se, "t_value": t, "p_value": [normal_tails(x) for x in t], "ci_lower": beta - z * se, "ci_upper": beta + z * se})
        spark = spark or (df.sparkSession if df is not None else None)
        return spark.createDataFrame(out) if spark else out

    def wald_test(self, df=None, y=None, sample_weight=None, offset=None, *, R=None, features=None, terms=None, formula=None, r=None, **kwargs) -> WaldTestResult:
        """Test ``R coefficients = r``, given as a matrix, features, terms or a text."""
        if sum(x is not None for x in (R, features, terms, formula)) != 1:
            raise ValueError("Exactly one of R, features, terms or formula must be specified.")
        names, beta = self._named()
        if formula is not None:
            if r is not None:
                raise ValueError("r cannot be given with a formula")
            R, r = M.constraint(formula, names)
        elif R is None:
            labels = names if features is not None else (["intercept"] if self.fit_intercept else []) + list(self.term_names_)
            wanted = [features] if isinstance(features, str) else [terms] if isinstance(terms, str) else list(features if features is not None else terms)
            rows, values = [], []
            given = np.zeros(len(wanted)) if r is None else np.broadcast_to(np.asarray(r, float), (len(wanted),))
            for name, value in zip(wanted, given):
                at = [k for k, n in enumerate(labels) if n == name]
                if not at:
                    raise KeyError(f"{name} is not in the model")
                rows += [np.eye(len(names))[k] for k in at]
                values += [value] * len(at)
            R, r = np.array(rows), np.array(values)
        R = np.atleast_2d(np.asarray(R, float))
        r = np.zeros(len(R)) if r is None else np.asarray(r, float)
        if R.shape[1] != len(beta) or r.shape != (len(R),):
            raise ValueError("R must have a column for each coefficient and r a value for each row of R")
        v = self.covariance_matrix(df, y, sample_weight, offset, **kwargs)
        gap = R @ beta - r
        value = float(gap @ np.linalg.solve(R @ v @ R.T, gap))
        return WaldTestResult(value, chi2_tail(value, len(R)), len(R))

    def _criteria(self, df, y, sample_weight, offset) -> dict:
        if self.alpha is None or np.any(np.asarray(self.alpha, float) > 0):
            if self.l1_ratio < 1:
                warnings.warn(f"{SAYS['ridge']} one count of a ridge model's parameters; all non-zero ones are counted here.", stacklevel=3)
        rows, f = self._with_mu(df, y, sample_weight, offset), self.family_instance_
        y_, mu, w = F.col("y"), F.col("mu"), F.col("w")
        phi = 1.0
        if f.estimates_dispersion:
            phi = float(rows.agg(f.dispersion(y_, mu, w, ddof=0, method="deviance").alias("d")).first().d)
        p = getattr(f, "p", None)
        if p is not None and 1 < p < 2:
            from ..functions.families import tweedie_unit_log_likelihood

            size = lambda b: [np.sum(b.column("w").to_numpy() * tweedie_unit_log_likelihood(b.column("y").to_numpy(), b.column("mu").to_numpy(), p, phi)), float(b.num_rows)]
            ll, n = moments.summed(rows, lambda b: np.array(size(b)), 2)
        else:
            ll, n = rows.agg(F.sum(f.unit_log_likelihood(y_, mu, w, phi)), F.count("*")).first()
        if int(n) != self.n_rows_:
            raise ValueError(f"the criteria need the {self.n_rows_} rows of the fit; got {int(n)}")
        k = int((np.abs(self.coef_) > np.finfo(float).eps).sum()) + self.fit_intercept
        return {"aic": -2 * ll + 2 * k, "aicc": -2 * ll + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1e-300), "bic": -2 * ll + math.log(n) * k, "log_likelihood": ll}

    def aic(self, df, y=None, sample_weight=None, offset=None):
        return self._criteria(df, y, sample_weight, offset)["aic"]

    def aicc(self, df, y=None, sample_weight=None, offset=None):
        return self._criteria(df, y, sample_weight, offset)["aicc"]

    def bic(self, df, y=None, sample_weight=None, offset=None):
        return self._criteria(df, y, sample_weight, offset)["bic"]

    # -- diagnostics -------------------------------------------------------------------

    def get_formatted_diagnostics(self, spark, full_report=False, custom_columns=None) -> DataFrame:
        """The optimiser's iterations as a DataFrame."""
        few = ["n_iter", "convergence", "objective_fct", "n_active_cols", "n_line_search"]
        columns = custom_columns or (list(self.diagnostics_[0]) if full_report and self.diagnostics_ else few)
        if not self.diagnostics_:
            return spark.createDataFrame([], "n_iter int, convergence double")
        return spark.createDataFrame(self.diagnostics_).select(*columns)

    def report_diagnostics(self, spark, full_report=False, custom_columns=None) -> None:
        self.get_formatted_diagnostics(spark, full_report, custom_columns).show(1000, truncate=False)

    def _log(self) -> None:
        """With ``verbose`` the iterations go to the log."""
        if self.verbose:
            for row in self.diagnostics_:
                logging.getLogger("fathom").info("iteration %(n_iter)d: objective %(objective_fct).10g, convergence %(convergence).3g", row)

    def export(self, spark) -> DataFrame:
        """The model as rows ``alpha_index, alpha, term, feature, coef``."""
        rows = []
        for i, a in enumerate(self._alphas):
            rows += [(i, float(a), "intercept", "intercept", float(self.intercept_path_[i]))] + [(i, float(a), t, n, float(c)) for t, n, c in zip(self.term_names_, self.feature_names_, self.coef_path_[i])]
        return spark.createDataFrame(rows, "alpha_index int, alpha double, term string, feature string, coef double")

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.get_params().items() if isinstance(v, (str, int, float, bool, list, tuple, dict, type(None), np.ndarray))})
