"""Queries over what the others leave out: own families, given splits, paths, saved models, sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import families as fam
from ..functions import links as lk
from ..operators import benchmarks, prep
from ..operators.glm import GeneralizedLinearRegressor as GLM
from ..operators.glm_cv import GeneralizedLinearRegressorCV as GLMCV
from ..sources import models, synthetic, tables
from . import design as D
from .fit_queries import _CV, TIGHT, coefs, lines
from .scalar_queries import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- families, links, formulas -------------------------------------------------------------


@query("""WITH e AS (SELECT value::DOUBLE y FROM events), s AS (SELECT e.y, j.j, (-1 * ln(0.5) + ln(y) - 2 * ln(2) - ln(0.5)) * j.j - lgamma(j.j + 1) - lgamma(j.j) t FROM e, range(1, 400) j(j) WHERE y > 0),
m AS (SELECT y, max(t) top FROM s GROUP BY y), w AS (SELECT s.y, m.top + ln(sum(exp(s.t - m.top))) l FROM (SELECT DISTINCT * FROM s) s JOIN m ON s.y = m.y GROUP BY s.y, m.top)
SELECT round(sum(CASE WHEN e.y > 0 THEN e.y * 10 ^ -0.5 / (2 * -0.5) - 10 ^ 0.5 / (2 * 0.5) + w.l - ln(e.y) ELSE -(10 ^ 0.5) / (2 * 0.5) END), 4) AS log_likelihood, count(*) AS n FROM e LEFT JOIN w ON e.y = w.y""")
def loglik_tweedie15(spark, sf_dir):
    """Power 1.5, dispersion 2 and mean 10: a vectorised partial aggregate of the series."""
    from ..operators.moments import summed

    rows = table(spark, sf_dir, "events").select(F.col("value").alias("y"), (F.col("value") * 0 + 10.0).alias("mu"))
    total = summed(rows, lambda b: np.array([fam.tweedie_unit_log_likelihood(b.column("y").to_numpy(), b.column("mu").to_numpy(), 1.5, 2.0).sum(), b.num_rows]), 2)
    return spark.createDataFrame([(round(float(total[0]), 4), int(total[1]))], "log_likelihood double, n long")


class CubicVariance(fam.Family):
    """An own family: variance mu ** 3, with the deviance that belongs to it."""

    lower = 0.0

    def default_link(self):
        return RootLink()

    def unit_variance(self, mu):
        return mu * mu * mu

    def unit_variance_derivative(self, mu):
        return 3 * mu * mu

    def unit_deviance(self, y, mu):
        return (y - mu) * (y - mu) / (y * mu * mu)


class RootLink(lk.Link):
    """An own link: the square root."""

    def link(self, mu):
        return mu**0.5

    def derivative(self, mu):
        return 0.5 * mu**-0.5

    def inverse(self, eta):
        return eta * eta

    def inverse_derivative(self, eta):
        return 2 * eta

    def inverse_derivative2(self, eta):
        return eta * 0 + 2


@query("SELECT 'l_returnflag[' || l_returnflag || ']' AS name, round(sqrt(avg(l_quantity)), 5) AS coef FROM lineitem GROUP BY 1")
def own_family_and_link(spark, sf_dir):
    m = GLM(family=CubicVariance(), link=RootLink(), alpha=0, fit_intercept=False, start_params=[5.0] * 3, **TIGHT)
    return coefs(spark, m.fit(lines(spark, sf_dir), "l_quantity", features=["l_returnflag"]))


@query("SELECT * FROM (VALUES ('binomial', NULL), ('gamma', 2.0), ('inverse.gaussian', 3.0), ('negative.binomial', NULL), ('normal', 0.0), ('poisson', 1.0), ('tweedie (1.7)', 1.7)) t(family, power)")
def tweedie_powers(spark, sf_dir):
    names = ("binomial", "gamma", "inverse.gaussian", "negative.binomial", "normal", "poisson", "tweedie (1.7)")
    found = [(n, getattr(fam.get_family(n).to_tweedie(), "p", None)) for n in names]
    return spark.createDataFrame([(n, None if p is None else float(p)) for n, p in found], "family string, power double")


_OLS = "WITH r AS (SELECT {y} y, {x} x FROM lineitem), f AS (SELECT covar_pop(x, y) / var_pop(x) b, avg(x) mx, avg(y) my FROM r)"


@query(f"{_OLS.format(y='l_quantity', x='l_discount / 2')} SELECT 'halved(l_discount)' AS name, round(b, 5) AS coef FROM f UNION ALL SELECT 'intercept', round(my - b * mx, 5) FROM f")
def formula_context(spark, sf_dir):
    return coefs(spark, GLM(alpha=0, formula="l_quantity ~ halved(l_discount)").fit(lines(spark, sf_dir), context={"halved": lambda c: c / 2}))


@query(f"{_OLS.format(y='l_quantity', x='l_discount')} SELECT 'l_discount' AS name, round(least(b, -3), 4) AS coef FROM f UNION ALL SELECT 'intercept', round(my - least(b, -3) * mx, 4) FROM f")
def trust_constrained_fit(spark, sf_dir):
    """A slope that an inequality holds at -3 or below, by the trust-constr solver."""
    m = GLM(alpha=0, solver="trust-constr", A_ineq=np.array([[1.0]]), b_ineq=np.array([-3.0]), max_iter=100)
    return coefs(spark, m.fit(lines(spark, sf_dir), "l_quantity", features=["l_discount"]), 4)


# -- cross-validation and paths ------------------------------------------------------------


def _cv_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_quantity y", "l_discount x", "CAST(l_orderkey % 4 AS INTEGER) f")


@query(f"{_CV} SELECT fold, alpha_index, round(test, 5) AS test_deviance, round(train, 5) AS train_deviance FROM d")
def cv_given_splits(spark, sf_dir):
    """The folds as pairs of conditions for training and test rows."""
    splits = [(F.col("f") != k, F.col("f") == k) for k in range(4)]
    m = GLMCV(cv=splits, alphas=[0.01, 0.001, 0.0], gradient_tol=1e-10).fit(_cv_rows(spark, sf_dir), "y", features=["x"])
    return m.cv_table(spark).select("fold", "alpha_index", F.round("test_deviance", 5).alias("test_deviance"), F.round("train_deviance", 5).alias("train_deviance"))


_PATH = "WITH r AS (SELECT l_quantity y, l_discount x FROM lineitem), s AS (SELECT covar_pop(x, y) c, var_pop(x) v, avg(x) mx, avg(y) my FROM r), a AS (SELECT * FROM (VALUES (0, 0.01), (1, 0.001), (2, 0.0)) t(alpha_index, alpha))"


@query(f"{_PATH} SELECT alpha_index, alpha::DOUBLE AS alpha, round(c / (v + alpha), 4) AS coef, round(my - c / (v + alpha) * mx, 4) AS intercept FROM s, a")
def cv_refit_path(spark, sf_dir):
    """After the choice the model is fitted to all rows at every penalty."""
    m = GLMCV(cv="f", alphas=[0.01, 0.001, 0.0], gradient_tol=1e-10).fit(_cv_rows(spark, sf_dir), "y", features=["x"])
    rows = m.export(spark).groupBy("alpha_index", "alpha")
    pick = lambda name: F.round(F.max(F.when(F.col("feature") == name, F.col("coef"))), 4)
    return rows.agg(pick("x").alias("coef"), pick("intercept").alias("intercept"))


@query(f"{_PATH} SELECT alpha::DOUBLE AS alpha, round(avg((my + c / (v + alpha) * (x - mx)) ^ 2), 4) AS square FROM r, s, a GROUP BY 1")
def path_lookup(spark, sf_dir):
    """Predictions of a path by penalty, in one projection."""
    rows, alphas = _cv_rows(spark, sf_dir), [0.01, 0.001, 0.0]
    m = GLM(alpha_search=True, alphas=alphas, gradient_tol=1e-10).fit(rows, "y", features=["x"])
    each = m.predict(rows, alpha=alphas).select(F.posexplode("prediction").alias("k", "p"))
    known = F.element_at(F.array(*map(F.lit, alphas)), F.col("k") + 1)
    return each.groupBy(known.alias("alpha")).agg(F.round(F.avg(F.col("p") * F.col("p")), 4).alias("square"))


@query("SELECT 'l_returnflag[' || l_returnflag || ']' AS name, round(ln(avg(l_quantity)), 5) AS coef FROM lineitem GROUP BY 1")
def warm_start_fit(spark, sf_dir):
    """A second fit that starts at the first one's solution."""
    rows = lines(spark, sf_dir).select("l_quantity", "l_returnflag")
    m = GLM(family="poisson", alpha=0, fit_intercept=False, warm_start=True, **TIGHT).fit(rows, "l_quantity")
    m.fit(rows, "l_quantity")
    return coefs(spark, m) if m.n_iter_ <= 1 else coefs(spark, m).where("false")


@query("SELECT round(var_pop(l_quantity) * (1 - corr(l_discount, l_quantity) ^ 2) / 2, 4) AS objective, true AS converged FROM lineitem")
def fit_diagnostics(spark, sf_dir):
    """The last recorded iteration has the objective of the least squares."""
    m = GLM(alpha=0, solver="irls-ls", gradient_tol=1e-9).fit(lines(spark, sf_dir), "l_quantity", features=["l_discount"])
    last = m.get_formatted_diagnostics(spark, full_report=True).orderBy(F.desc("n_iter")).limit(1)
    return last.select(F.round("objective_fct", 4).alias("objective"), (F.col("convergence") < 1e-6).alias("converged"))


# -- designs, saved models, sources --------------------------------------------------------


@query("WITH l AS (SELECT DISTINCT l_returnflag k FROM lineitem) SELECT 'l_returnflag[' || k || ']' AS name, 0.5 AS p1 FROM l UNION ALL SELECT 'l_discount', 2.0")
def expanded_penalty(spark, sf_dir):
    """A penalty for each column of the table is one for each level of the design."""
    rows, features = lines(spark, sf_dir), ["l_returnflag", "l_discount"]
    design = D.from_columns(rows, features)
    return spark.createDataFrame(list(zip(design.feature_names(), D.expand_penalty([0.5, 2.0], features, design))), "name string, p1 double")


@query("SELECT count(DISTINCT l_returnflag) - 1 AS known, sum((l_returnflag <> 'R')::INT)::BIGINT AS rows FROM lineitem")
def frozen_levels(spark, sf_dir):
    """Levels are those of the fit; rows of another level cannot be scored."""
    rows = lines(spark, sf_dir)
    m = GLM(alpha=0).fit(rows.where("l_returnflag <> 'R'"), "l_quantity", features=["l_returnflag"])
    levels = m.categorical_levels_["l_returnflag"]
    return m.predict(rows.where(F.col("l_returnflag").isin(levels))).agg(F.lit(len(levels)).cast("long").alias("known"), F.count("prediction").alias("rows"))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def saved_model(spark, sf_dir):
    """A model that went through JSON scores like the one that was fitted."""
    rows = lines(spark, sf_dir).select("l_quantity", "l_returnflag")
    again = models.from_json(models.to_json(GLM(family="gamma", alpha=0, formula="l_quantity ~ l_returnflag", drop_first=True, **TIGHT).fit(rows)))
    return again.predict(rows).groupBy("l_returnflag").agg(F.round(F.avg("prediction"), 4).alias("mean"))


@query("SELECT 'dense' AS kind, 60::BIGINT AS n, 2::BIGINT AS levels UNION ALL SELECT 'mixed', 300, 4 UNION ALL SELECT 'levels', 300, 5")
def synthetic_tables(spark, sf_dir):
    dense = tables.from_arrays(spark, np.arange(120.0).reshape(60, 2)).agg(F.lit("dense").alias("kind"), F.count("*").alias("n"), F.lit(2).cast("long").alias("levels"))
    mixed = synthetic.mixed_data(spark, "tweedie", 300, dense=1, categorical=(4,)).agg(F.lit("mixed"), F.count("y"), F.countDistinct("cat0"))
    levels = synthetic.categorical_dataset(spark, 300, (5,)).agg(F.lit("levels"), F.count("y"), F.countDistinct("cat0"))
    return dense.union(mixed).union(levels)


@query("SELECT count(*) AS n, true AS close, true AS positive FROM range(20000)")
def tweedie_variates(spark, sf_dir):
    """Mean and share of zeros of sampled compound Poisson variates, beside what they should be."""
    rng = np.random.default_rng(3)
    y = synthetic.tweedie_sample(rng, np.full(20_000, 2.0), 1.0, 1.5)
    zeros = np.exp(-(2.0**0.5) / 0.5)
    close = abs(y.mean() - 2) < 0.06 and abs((y == 0).mean() - zeros) < 0.01 and abs(y.var() - 2.0**1.5) < 0.25
    return spark.createDataFrame([(len(y), bool(close), bool((y >= 0).all()))], "n long, close boolean, positive boolean")


# -- data preparation ----------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def prep_checked_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return prep.checked_join(table(spark, sf_dir, "customer").select("c_nationkey"), nation, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def prep_snake_case(spark, sf_dir):
    return prep.snake_case(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("regionKey"), F.col("r_name").alias("RegionName")))


@query("SELECT true AS about_as_many, true AS known, true AS repeated FROM range(1)")
def prep_bootstrap(spark, sf_dir):
    """As many rows as the table, give or take, all of it, some of them more than once."""
    keys = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("k"))
    drawn, n = prep.bootstrap(keys, 1.0, 7), keys.count()
    got = drawn.agg(F.count("*").alias("n"), F.countDistinct("k").alias("d")).first()
    return spark.createDataFrame([(abs(got.n / n - 1) < 6 / n**0.5, got.d <= n, got.d < got.n)], "about_as_many boolean, known boolean, repeated boolean")


@query("SELECT count(*) AS n, true AS share, true AS known FROM orders")
def prep_swap_noise(spark, sf_dir):
    """About a fifth of the rows gets another row's value, and no value is new."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    noisy = prep.swap_noise(rows, "o_totalprice", 0.2, 5, "o_orderkey").withColumnRenamed("o_totalprice", "noisy")
    known = rows.select(F.col("o_totalprice").alias("noisy")).distinct().withColumn("_known", F.lit(True))
    both = rows.join(noisy, "o_orderkey").join(known, "noisy", "left")
    moved = F.avg((F.col("noisy") != F.col("o_totalprice")).cast("double"))
    return both.agg(F.count("*").alias("n"), (F.abs(moved - 0.2) < 0.05).alias("share"), F.every(F.coalesce("_known", F.lit(False))).alias("known"))


@query("SELECT count(*) AS n, 0::BIGINT AS both, true AS share FROM orders")
def prep_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    train, test = prep.split(rows, ["o_orderkey"], 0.25)
    n, t = train.count(), test.count()
    return spark.createDataFrame([(n + t, train.join(test, "o_orderkey").count(), abs(t / (n + t) - 0.25) < 0.05)], "n long, both long, share boolean")


@query("SELECT round(0.5 * sum((1 + l_tax) * 2 * (l_quantity * ln(l_quantity / 20) - l_quantity + 20)) / sum(1 + l_tax) + 0.1 * (0.25 * 3 + 0.5 * 0.75 * 5), 6) AS objective FROM lineitem")
def prep_objective(spark, sf_dir):
    """Penalised objective of the Poisson mean 20 and coefficients 1 and -2."""
    rows = table(spark, sf_dir, "lineitem")
    value = prep.objective(rows, fam.PoissonFamily(), F.col("l_quantity"), F.lit(20.0), 1 + F.col("l_tax"), 0.1, 0.25, [1.0, -2.0])
    return spark.createDataFrame([(round(value, 6),)], "objective double")


@query("""WITH n AS (SELECT n_nationkey k, (n_nationkey % 5)::DOUBLE x, (n_nationkey // 5)::DOUBLE y FROM nation), d AS (SELECT a.k i, b.k j, 1 / sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) l FROM n a JOIN n b ON a.k <> b.k),
m AS (SELECT max(l) top FROM d) SELECT i, i AS j, round(sum(l) / max(top), 6) AS p FROM d, m GROUP BY 1 UNION ALL SELECT i, j, round(-l / top, 6) FROM d, m""")
def prep_distance_penalty(spark, sf_dir):
    """The graph Laplacian of the nations on a grid five wide."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    p = prep.distance_penalty([(float(k % 5), float(k // 5)) for k in keys])
    return spark.createDataFrame([(int(a), int(b), round(p[i][j], 6)) for i, a in enumerate(keys) for j, b in enumerate(keys)], "i long, j long, p double")


# -- benchmark grid ------------------------------------------------------------------------


@query("SELECT p AS problem, s AS solver, true AS agrees FROM (VALUES ('by_flag'), ('by_status')) a(p), (VALUES ('irls-ls'), ('lbfgs')) b(s)")
def benchmark_grid(spark, sf_dir):
    """Two problems by two solvers; both reach the same objective, and a run agrees with itself."""
    cases = benchmarks.grid(problem=["by_flag", "by_status"], solver=["irls-ls", "lbfgs"], alpha=0.01)
    column = {"by_flag": "l_returnflag", "by_status": "l_linestatus"}
    results = benchmarks.run(spark, cases, lambda _, c: lines(spark, sf_dir).select(F.col("l_quantity").alias("y"), column[c.problem]))
    gaps = benchmarks.analysed(results).select("problem", (F.abs("objective_gap") < 1e-4).alias("same"))
    change = benchmarks.compared(results, results).select("problem", "solver", (F.abs("objective_change") < 1e-9).alias("still"))
    return change.join(gaps, "problem").select("problem", "solver", (F.col("same") & F.col("still")).alias("agrees"))
