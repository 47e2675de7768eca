"""Queries that fit models, against closed forms or a Newton recursion in SQL."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import functions as F

from ..functions import families as fam
from ..operators import moments
from ..operators.glm import GeneralizedLinearRegressor as GLM
from ..operators.glm_cv import GeneralizedLinearRegressorCV as GLMCV
from ..operators.glm_cv import fold_column
from . import design as D
from .scalar_queries import table

QUERIES, ORACLE_SQL = {}, {}
TIGHT = {"gradient_tol": 1e-10, "max_iter": 60}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark, sf_dir, *more):
    """The columns of ``lineitem`` that the fits use, and only these."""
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", *more)


def coefs(spark, model, digits=5):
    names, values = model._named()
    return spark.createDataFrame([(n, round(float(v), digits) + 0.0) for n, v in zip(names, values)], "name string, coef double")


def matrix(spark, names, m, digits):
    return spark.createDataFrame([(a, b, round(float(m[i, j]), digits) + 0.0) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, value double")


# -- saturated one-way models: the coefficient of a level is the link of its mean ----------

_WAYS = {
    "poisson": ("poisson", "auto", "l_quantity", "ln(avg(y))"), "gamma": ("gamma", "auto", "l_quantity", "ln(avg(y))"), "inverse_gaussian": ("inverse.gaussian", "auto", "l_quantity", "ln(avg(y))"),
    "tweedie": ("tweedie (1.5)", "auto", "l_quantity", "ln(avg(y))"), "negative_binomial": ("negative.binomial (0.5)", "auto", "l_quantity", "ln(avg(y))"), "normal": ("normal", "auto", "l_quantity", "avg(y)"),
    "logit": ("binomial", "auto", "CASE WHEN l_quantity > 30 THEN 1.0D ELSE 0.0D END", "ln(avg(y) / (1 - avg(y)))"), "cloglog": ("binomial", "cloglog", "CASE WHEN l_quantity > 30 THEN 1.0D ELSE 0.0D END", "ln(-ln(1 - avg(y)))"),
    "normal_log": ("normal", "log", "l_quantity", "ln(avg(y))"),
}


def _one_way(family, link, y):
    def run(spark, sf_dir):
        rows = lines(spark, sf_dir).selectExpr(f"{y} y", "l_returnflag")
        # Without an intercept a fit starts at 0, from where the inverse Gaussian can run off.
        start = [3.0] * 3 if family == "inverse.gaussian" else None
        return coefs(spark, GLM(family=family, link=link, fit_intercept=False, alpha=0, start_params=start, **TIGHT).fit(rows, "y"), 4)

    return run


for _n, (_fam, _link, _y, _sql) in _WAYS.items():
    QUERIES[f"oneway_{_n}"] = _one_way(_fam, _link, _y)
    ORACLE_SQL[f"oneway_{_n}"] = f"SELECT 'l_returnflag[' || l_returnflag || ']' AS name, round({_sql}, 4) + 0.0 AS coef FROM (SELECT l_returnflag, {_y.replace('1.0D', '1.0').replace('0.0D', '0.0')} AS y FROM lineitem) GROUP BY l_returnflag"


# -- Gaussian closed forms --------------------------------------------------------------------

_SUMS = "WITH s AS (SELECT avg(l_discount) mx, avg(l_quantity) my, covar_pop(l_discount, l_quantity) c, var_pop(l_discount) v, stddev_pop(l_discount) sd FROM lineitem)"
_PAIR = "SELECT 'l_discount' AS name, round(b, 5) + 0.0 AS coef FROM f UNION ALL SELECT 'intercept', round(my - b * mx, 5) + 0.0 FROM f"


def _gauss(**params):
    def run(spark, sf_dir):
        return coefs(spark, GLM(gradient_tol=1e-12, **params).fit(lines(spark, sf_dir), "l_quantity", features=["l_discount"]))

    return run


def _soft(z, t):
    return f"sign({z}) * greatest(abs({z}) - {t}, 0)"


for _n, _params, _b in (
    ("ols_fit", {"alpha": 0}, "c / v"),
    ("ridge_fit", {"alpha": 0.001}, "c / (v + 0.001)"),
    ("lasso_fit", {"alpha": 0.0001, "l1_ratio": 1.0}, f"{_soft('c', 0.0001)} / v"),
    ("enet_fit", {"alpha": 0.0002, "l1_ratio": 0.5}, f"{_soft('c', 0.0001)} / (v + 0.0001)"),
    ("scaled_enet_fit", {"alpha": 0.001, "l1_ratio": 0.5, "scale_predictors": True}, f"{_soft('c / sd', 0.0005)} / 1.0005 / sd"),
    ("bounded_fit", {"alpha": 0, "lower_bounds": [-0.05], "upper_bounds": [0.05]}, "least(greatest(c / v, -0.05), 0.05)"),
    ("inequality_fit", {"alpha": 0, "A_ineq": np.array([[1.0]]), "b_ineq": np.array([-0.25])}, "least(c / v, -0.25)"),
    ("tikhonov_fit", {"alpha": 0.001, "P2": np.array([[3.0]])}, "c / (v + 0.003)"),
    ("p1_fit", {"alpha": 0.0001, "l1_ratio": 1.0, "P1": [0.5]}, f"{_soft('c', 0.00005)} / v"),
):
    QUERIES[_n] = _gauss(**_params)
    ORACLE_SQL[_n] = f"{_SUMS}, f AS (SELECT *, {_b} AS b FROM s) {_PAIR}"


@query("WITH w AS (SELECT l_discount x, l_quantity - 3 * l_tax y, 1 + l_tax w FROM lineitem), s AS (SELECT sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) c, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2 v FROM w), f AS (SELECT *, c / v AS b FROM s) " + _PAIR)
def wls_offset_fit(spark, sf_dir):
    rows = lines(spark, sf_dir).selectExpr("l_quantity y", "l_discount", "1 + l_tax w", "3 * l_tax o")
    return coefs(spark, GLM(alpha=0).fit(rows, "y", "w", "o", features=["l_discount"]))


@query("SELECT 'l_returnflag[' || l_returnflag || ']' AS name, round(sign(s) * greatest(abs(s) - 0.3, 0) / (share + 0.3), 5) + 0.0 AS coef FROM (SELECT l_returnflag, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share, sum(l_quantity) / (SELECT count(*) FROM lineitem) AS s FROM lineitem GROUP BY 1)")
def enet_categorical_fit(spark, sf_dir):
    return coefs(spark, GLM(alpha=0.6, l1_ratio=0.5, fit_intercept=False, gradient_tol=1e-12).fit(lines(spark, sf_dir), "l_quantity", features=["l_returnflag"]))


# -- two-parameter fits by Newton's method in SQL ------------------------------------------------


def _newton(y, g, h, start, table_="lineitem", x="l_discount", offset="0", steps=25):
    """Newton steps as a recursive table: sums of the gradient and curvature of each row."""
    rows = f"(SELECT {x} AS x, {y} AS y, {offset} AS o FROM {table_})"
    sub = lambda e: e.replace("eta", "(k.a + k.b * r.x + r.o)")
    return f"""WITH RECURSIVE n(step, a, b) AS (SELECT 0, ({start})::DOUBLE, 0.0::DOUBLE UNION ALL
      SELECT step + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT k.step, k.a, k.b, sum({sub(g)}) g0, sum(({sub(g)}) * r.x) g1, sum({sub(h)}) h00, sum(({sub(h)}) * r.x) h01, sum(({sub(h)}) * r.x * r.x) h11
        FROM n k, {rows} r WHERE k.step < {steps} GROUP BY 1, 2, 3))
    SELECT 'intercept' AS name, round(a, 4) + 0.0 AS coef FROM n WHERE step = {steps} UNION ALL SELECT '{x}', round(b, 4) + 0.0 FROM n WHERE step = {steps}"""


_BIG = "CASE WHEN l_quantity > 30 THEN 1.0 ELSE 0.0 END"
_TWO = {
    "poisson_fit": ("poisson", "auto", "l_quantity", None, _newton("l_quantity", "r.y - exp(eta)", "exp(eta)", "SELECT ln(avg(l_quantity)) FROM lineitem")),
    "gamma_fit": ("gamma", "auto", "l_quantity", None, _newton("l_quantity", "r.y * exp(-(eta)) - 1", "r.y * exp(-(eta))", "SELECT ln(avg(l_quantity)) FROM lineitem")),
    "tweedie_fit": ("tweedie", "auto", "l_quantity", None, _newton("l_quantity", "r.y * exp(-0.5 * (eta)) - exp(0.5 * (eta))", "0.5 * r.y * exp(-0.5 * (eta)) + 0.5 * exp(0.5 * (eta))", "SELECT ln(avg(l_quantity)) FROM lineitem")),
    "negbin_fit": ("negative.binomial (0.5)", "auto", "l_quantity", None, _newton("l_quantity", "(r.y - exp(eta)) / (1 + 0.5 * exp(eta))", "exp(eta) / (1 + 0.5 * exp(eta))", "SELECT ln(avg(l_quantity)) FROM lineitem", steps=40)),
    "ig_fit": ("inverse.gaussian", "auto", "l_quantity", None, _newton("l_quantity", "r.y * exp(-2 * (eta)) - exp(-(eta))", "exp(-(eta))", "SELECT ln(avg(l_quantity)) FROM lineitem", steps=40)),
    "logit_fit": ("binomial", "auto", _BIG, None, _newton(_BIG, "r.y - 1 / (1 + exp(-(eta)))", "1 / (1 + exp(-(eta))) * (1 - 1 / (1 + exp(-(eta))))", "0")),
    "offset_fit": ("poisson", "auto", "l_quantity", "ln(1 + l_tax)", _newton("l_quantity", "r.y - exp(eta)", "exp(eta)", "SELECT ln(avg(l_quantity)) FROM lineitem", offset="ln(1 + l_tax)")),
}


def _two(family, link, y, offset, **params):
    def run(spark, sf_dir):
        rows = lines(spark, sf_dir).selectExpr(f"CAST({y} AS DOUBLE) y", "l_discount", f"{offset or 0} o")
        return coefs(spark, GLM(family=family, link=link, alpha=0, **TIGHT, **params).fit(rows, "y", offset="o", features=["l_discount"]), 4)

    return run


for _n, (_fam, _link, _y, _o, _sql) in _TWO.items():
    QUERIES[_n], ORACLE_SQL[_n] = _two(_fam, _link, _y, _o), _sql
for _n, _solver in (("poisson_lbfgs_fit", "lbfgs"), ("poisson_cd_fit", "irls-cd"), ("poisson_trust_fit", "trust-constr")):
    QUERIES[_n], ORACLE_SQL[_n] = _two("poisson", "auto", "l_quantity", None, solver=_solver), _TWO["poisson_fit"][4]


@query("WITH r AS (SELECT o_totalprice y, o_orderstatus g, CASE WHEN o_orderstatus = 'P' THEN 2.0 ELSE 1.0 END e FROM orders) SELECT 'g[' || g || ']' AS name, round(ln(sum(y * e ^ -0.5 * e ^ 0.5) / sum(e ^ 0.5 * e ^ 0.5)), 4) + 0.0 AS coef FROM r GROUP BY g")
def weights_offset_equivalence(spark, sf_dir):
    """An exposure as an offset gives the model that rates and weights give (Tweedie 1.5)."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_totalprice y", "o_orderstatus g", "ln(CASE WHEN o_orderstatus = 'P' THEN 2.0D ELSE 1.0D END) o")
    return coefs(spark, GLM(family="tweedie", fit_intercept=False, alpha=0, **TIGHT).fit(rows, "y", offset="o", features=["g"]), 4)


# -- sums behind the fits ---------------------------------------------------------------------------


def _coded(spark, sf_dir, features=("l_discount", "l_tax")):
    rows = lines(spark, sf_dir)
    design = D.from_columns(rows, list(features))
    coded, layout = design.encoded(rows, [F.col("l_quantity").alias("y"), (1 + F.col("l_tax")).alias("w"), F.lit(0.0).alias("o")])
    return design, moments.Coded(coded, layout, np.zeros(sum(n for *_, n in layout)))


_LONG = "SELECT a, b, round(CASE WHEN a = 'x' AND b = 'x' THEN xx WHEN a = 'z' AND b = 'z' THEN zz WHEN a <> b AND a <> '1' AND b <> '1' THEN xz WHEN a = '1' AND b = '1' THEN oo WHEN a = 'x' OR b = 'x' THEN ox ELSE oz END, 3) + 0.0 AS value FROM s, (VALUES ('1'), ('x'), ('z')) p(a), (VALUES ('1'), ('x'), ('z')) q(b)"


def _weighted(d, rows="SELECT l_discount x, l_tax z, l_quantity y, 1 + l_tax w FROM lineitem"):
    return f"WITH r AS ({rows}), s AS (SELECT sum({d}) oo, sum({d} * x) ox, sum({d} * z) oz, sum({d} * x * x) xx, sum({d} * x * z) xz, sum({d} * z * z) zz FROM r) {_LONG}"


def _information(which):
    def run(spark, sf_dir):
        _, coded = _coded(spark, sf_dir)
        family, link, beta = fam.PoissonFamily(), fam.LogLink(), np.array([3.0, 0.5, 1.0])
        if which in ("observed", "gamma"):
            family = fam.GammaFamily()

        layout, centres = coded.layout, coded.centres

        def partial(b):
            rows = moments.batch_rows(b, layout, centres)
            eta = rows.predictor(beta)
            mu = np.exp(eta)
            if which == "meat":
                s = rows.scores(family.score_weight(link, rows.y, eta, mu, rows.w))
                return (s.T @ s).ravel()
            d = {"gram": rows.w, "fisher": family.fisher_weight(link, eta, mu, rows.w), "observed": family.observed_weight(link, rows.y, eta, mu, rows.w)}[which]
            return rows.gram(d).ravel()

        return matrix(spark, ["1", "x", "z"], moments.summed(coded.table, partial, 9).reshape(3, 3), 6 if which == "gram" else 3)

    return run


_E = "exp(3 + 0.5 * x + z)"
for _n, _which, _d in (("gram_dense", "gram", "w"), ("fisher_information", "fisher", f"w * {_E}"), ("observed_information", "observed", f"w * y / {_E}"), ("score_meat", "meat", f"(w * (y - {_E})) ^ 2")):
    QUERIES[_n], ORACLE_SQL[_n] = _information(_which), _weighted(_d)
# These sums are whole millionths, so three digits could tie.
ORACLE_SQL["gram_dense"] = ORACLE_SQL["gram_dense"].replace("END, 3)", "END, 6)")


@query("WITH r AS (SELECT 1 + l_tax w, l_returnflag a, l_linestatus b, l_discount x FROM lineitem) SELECT 'l_returnflag[' || a || ']' AS a, 'l_linestatus[' || b || ']' AS b, round(sum(w), 4) AS value FROM r GROUP BY 1, 2 UNION ALL SELECT 'l_returnflag[' || a || ']', 'l_discount', round(sum(w * x), 4) FROM r GROUP BY 1")
def gram_categorical(spark, sf_dir):
    design, coded = _coded(spark, sf_dir, ("l_returnflag", "l_linestatus", "l_discount"))
    names = design.feature_names()

    layout, centres = coded.layout, coded.centres

    def partial(b):
        rows = moments.batch_rows(b, layout, centres)
        return rows.gram(rows.w).ravel()

    got = moments.summed(coded.table, partial, (len(names) + 1) ** 2).reshape(len(names) + 1, -1)[1:, 1:]
    w = [(names[i], names[j], round(float(got[i, j]), 4)) for i in range(len(names)) for j in range(len(names)) if names[i].startswith("l_returnflag") and not names[j].startswith("l_returnflag")]
    rows = spark.createDataFrame(w, "a string, b string, value double")
    observed = lines(spark, sf_dir).select(F.concat(F.lit("l_returnflag["), "l_returnflag", F.lit("]")).alias("a"), F.concat(F.lit("l_linestatus["), "l_linestatus", F.lit("]")).alias("b")).distinct()
    return rows.join(observed, ["a", "b"], "left_semi").union(rows.where("b = 'l_discount'"))


@query("SELECT 'l_discount' AS name, round(sum(w * x) / sum(w), 6) AS mean, round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2), 6) AS std FROM (SELECT l_discount x, 1 + l_tax w FROM lineitem) UNION ALL SELECT 'l_tax', round(sum(w * x) / sum(w), 6), round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2), 6) FROM (SELECT l_tax x, 1 + l_tax w FROM lineitem)")
def standardize_moments(spark, sf_dir):
    design, coded = _coded(spark, sf_dir)
    m = moments.column_moments(coded)[0]
    return spark.createDataFrame([(n, round(float(a), 6), round(float(b), 6)) for n, a, b in zip(design.feature_names(), m["mean"], m["std"])], "name string, mean double, std double")


# -- inference ----------------------------------------------------------------------------------------

_GROUPS = "WITH g AS (SELECT l_returnflag k, count(*) n, avg(l_quantity) m, sum((l_quantity - 0) ^ 2) q FROM lineitem GROUP BY 1), t AS (SELECT sum(n) nn, count(*) p FROM g), e AS (SELECT k, n, m, q - n * m * m AS ss FROM g)"


def _table(**options):
    def run(spark, sf_dir):
        rows = lines(spark, sf_dir, "l_suppkey")
        m = GLM(fit_intercept=False, alpha=0).fit(rows, "l_quantity", features=["l_returnflag"])
        out = m.coef_table(rows, "l_quantity", **options)
        return out.select("name", *(F.round(c, 6).alias(c) for c in ("coef", "se", "t_value", "ci_lower", "ci_upper")))

    return run


def _table_sql(se):
    z = 1.959963984540054
    return f"{_GROUPS}, s AS (SELECT k, m, {se} AS se FROM e, t) SELECT 'l_returnflag[' || s.k || ']' AS name, round(m, 6) AS coef, round(se, 6) AS se, round(m / se, 6) AS t_value, round(m - {z} * se, 6) AS ci_lower, round(m + {z} * se, 6) AS ci_upper FROM s"


QUERIES["coef_table_classical"] = _table(robust=False)
ORACLE_SQL["coef_table_classical"] = _table_sql("sqrt((SELECT sum(ss) FROM e) / (nn - p) / n * nn / (nn - p))")
QUERIES["coef_table_hc1"] = _table()
ORACLE_SQL["coef_table_hc1"] = _table_sql("sqrt(ss / (n * n) * nn / (nn - p))")
QUERIES["coef_table_cluster"] = _table(clusters="l_suppkey")
ORACLE_SQL["coef_table_cluster"] = """WITH g AS (SELECT l_returnflag k, count(*) n, avg(l_quantity) m FROM lineitem GROUP BY 1), t AS (SELECT count(*)::DOUBLE n, count(DISTINCT l_returnflag) p, count(DISTINCT l_suppkey) c FROM lineitem),
c AS (SELECT l_returnflag k, l_suppkey, sum(l_quantity - m) s FROM lineitem JOIN g ON g.k = l_returnflag GROUP BY 1, 2), v AS (SELECT k, sum(s * s) ss FROM c GROUP BY 1),
s AS (SELECT k, m, sqrt(ss / (g.n * g.n) * t.c / (t.c - 1) * (t.n - 1) / (t.n - t.p)) se FROM g JOIN v USING (k), t)
SELECT 'l_returnflag[' || k || ']' AS name, round(m, 6) AS coef, round(se, 6) AS se, round(m / se, 6) AS t_value, round(m - 1.959963984540054 * se, 6) AS ci_lower, round(m + 1.959963984540054 * se, 6) AS ci_upper FROM s"""


@query(f"""{_GROUPS}, s AS (SELECT k, m, ss / (n * n) * nn / (nn - p) v FROM e, t)
SELECT 'feature' AS kind, round(((SELECT m FROM s WHERE k = 'A') - 25) ^ 2 / (SELECT v FROM s WHERE k = 'A'), 4) AS statistic, 1 AS df UNION ALL
SELECT 'formula', round(((SELECT m FROM s WHERE k = 'A') - (SELECT m FROM s WHERE k = 'N')) ^ 2 / ((SELECT v FROM s WHERE k = 'A') + (SELECT v FROM s WHERE k = 'N')), 4), 1 UNION ALL
SELECT 'term', round((SELECT sum((m - 25) ^ 2 / v) FROM s), 4), 3 UNION ALL
SELECT 'matrix', round(((SELECT m FROM s WHERE k = 'R') * 2 - 51) ^ 2 / (4 * (SELECT v FROM s WHERE k = 'R')), 4), 1""")
def wald_tests(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = GLM(fit_intercept=False, alpha=0).fit(rows, "l_quantity", features=["l_returnflag"], store_covariance_matrix=True)
    tests = {"feature": m.wald_test(features="l_returnflag[A]", r=25), "formula": m.wald_test(formula="l_returnflag[A] = l_returnflag[N]"), "term": m.wald_test(terms="l_returnflag", r=25), "matrix": m.wald_test(R=[[0, 0, 2]], r=[51])}
    return spark.createDataFrame([(k, round(t.test_statistic, 4), t.df) for k, t in tests.items()], "kind string, statistic double, df int")


@query("WITH g AS (SELECT l_returnflag k, avg(l_quantity) m FROM lineitem GROUP BY 1), r AS (SELECT l_quantity y, m FROM lineitem JOIN g ON k = l_returnflag), s AS (SELECT count(*) n, sum(y * ln(m) - m - lgamma(y + 1)) ll FROM r) SELECT round(-2 * ll + 6, 3) AS aic, round(-2 * ll + 6 + 24.0 / (n - 4), 3) AS aicc, round(-2 * ll + 3 * ln(n), 3) AS bic FROM s")
def information_criteria(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = GLM(family="poisson", fit_intercept=False, alpha=0, **TIGHT).fit(rows, "l_quantity", features=["l_returnflag"])
    got = m._criteria(rows, "l_quantity", None, None)
    return spark.createDataFrame([tuple(round(float(got[k]), 3) for k in ("aic", "aicc", "bic"))], "aic double, aicc double, bic double")


@query("WITH g AS (SELECT l_returnflag k, avg(l_quantity) m FROM lineitem GROUP BY 1), r AS (SELECT l_quantity y, m, (SELECT avg(l_quantity) FROM lineitem) a FROM lineitem JOIN g ON k = l_returnflag) SELECT round(1 - sum(2 * (y * ln(y / m) - y + m)) / sum(2 * (y * ln(y / a) - y + a)), 8) + 0.0 AS d2 FROM r")
def score_d2(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = GLM(family="poisson", fit_intercept=False, alpha=0, **TIGHT).fit(rows, "l_quantity", features=["l_returnflag"])
    return spark.createDataFrame([(round(float(m.score(rows, "l_quantity")), 8) + 0.0,)], "d2 double")


@query("WITH g AS (SELECT l_returnflag k, avg(l_quantity) m FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(sum(m * (1 + l_tax)), 2) AS total, round(avg(ln(m)), 5) AS eta FROM lineitem JOIN g ON k = l_returnflag GROUP BY 1")
def predict_mean(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = GLM(family="poisson", fit_intercept=False, alpha=0, **TIGHT).fit(rows, "l_quantity", features=["l_returnflag"])
    out = m.linear_predictor(m.predict(rows, sample_weight=1 + F.col("l_tax")))
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 2).alias("total"), F.round(F.avg("linear_predictor"), 5).alias("eta"))


# -- paths and cross-validation -----------------------------------------------------------------------

_ALPHAS = (0.001, 0.0005, 0.0001)


@query(f"{_SUMS} SELECT i AS alpha_index, round(sign(c) * greatest(abs(c) - a, 0) / v, 5) + 0.0 AS coef FROM s, (VALUES {', '.join(f'({k}, {a})' for k, a in enumerate(_ALPHAS))}) t(i, a)")
def alpha_path_fit(spark, sf_dir):
    m = GLM(alpha_search=True, alphas=list(_ALPHAS), l1_ratio=1.0, gradient_tol=1e-12).fit(lines(spark, sf_dir), "l_quantity", features=["l_discount"])
    return m.export(spark).where("feature = 'l_discount'").select("alpha_index", (F.round("coef", 5) + F.lit(0.0)).alias("coef"))


@query("WITH s AS (SELECT greatest(abs(covar_pop(l_discount, l_quantity)), abs(covar_pop(l_tax, l_quantity))) / 0.5 m FROM lineitem) SELECT i AS alpha_index, round(m * power(0.01, i / 4.0), 9) AS alpha FROM s, range(5) t(i)")
def alpha_grid(spark, sf_dir):
    m = GLM(alpha_search=True, n_alphas=5, min_alpha_ratio=0.01, l1_ratio=0.5).fit(lines(spark, sf_dir), "l_quantity", features=["l_discount", "l_tax"])
    return spark.createDataFrame([(k, round(float(a), 9)) for k, a in enumerate(m._alphas)], "alpha_index long, alpha double")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 i, count(*) OVER () n FROM orders) SELECT CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1")
def kfold_assignment(spark, sf_dir):
    out, _ = fold_column(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")
    return out.groupBy(F.col("_fold").alias("fold")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


_CV_ROWS = "SELECT l_quantity y, l_discount x, CAST(l_orderkey % 4 AS INTEGER) f FROM lineitem"
_CV = f"""WITH r AS ({_CV_ROWS}), k AS (SELECT DISTINCT f FROM r), s AS (SELECT k.f, avg(x) mx, avg(y) my, covar_pop(x, y) c, var_pop(x) v FROM r, k WHERE r.f <> k.f GROUP BY 1),
m AS (SELECT s.f, i, a, c / (v + a) b, my - c / (v + a) * mx a0 FROM s, (VALUES (0, 0.01), (1, 0.001), (2, 0.0)) t(i, a)),
d AS (SELECT m.f AS fold, m.i AS alpha_index, avg(CASE WHEN r.f = m.f THEN (y - a0 - b * x) ^ 2 END) test, avg(CASE WHEN r.f <> m.f THEN (y - a0 - b * x) ^ 2 END) train FROM r, m GROUP BY 1, 2)"""


def _cv(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity y", "l_discount x", "CAST(l_orderkey % 4 AS INTEGER) f")
    return GLMCV(cv="f", alphas=[0.01, 0.001, 0.0], l1_ratio=0.0, gradient_tol=1e-10).fit(rows, "y", features=["x"])


@query(f"{_CV} SELECT fold, alpha_index, round(test, 5) AS test_deviance, round(train, 5) AS train_deviance FROM d")
def cv_deviances(spark, sf_dir):
    return _cv(spark, sf_dir).cv_table(spark).select("fold", "alpha_index", F.round("test_deviance", 5).alias("test_deviance"), F.round("train_deviance", 5).alias("train_deviance"))


@query(f"{_CV}, z AS (SELECT alpha_index i, avg(test) t FROM d GROUP BY 1), w AS (SELECT (list_value(0.01, 0.001, 0.0))[arg_min(i, t) + 1] a FROM z), q AS (SELECT covar_pop(x, y) c, var_pop(x) v FROM r) SELECT round(a, 4)::DOUBLE AS alpha, round(c / (v + a), 4) AS coef FROM w, q")
def cv_select(spark, sf_dir):
    m = _cv(spark, sf_dir)
    return spark.createDataFrame([(round(m.alpha_, 4), round(float(m.coef_[0]), 4))], "alpha double, coef double")


# -- designs and formulas -----------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return joined.select("n_chars", "lang", F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("q"))


_LABELLED = "WITH r AS (SELECT d.n_chars::DOUBLE y, d.lang, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality END q FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"{_LABELLED} SELECT 'q[' || coalesce(q, '(MISSING)') || ']' AS name, round(avg(y), 4) AS coef FROM r GROUP BY 1")
def missing_convert(spark, sf_dir):
    return coefs(spark, GLM(fit_intercept=False, alpha=0, cat_missing_method="convert").fit(_labelled(spark, sf_dir), "n_chars", features=["q"]), 4)


@query(f"{_LABELLED} SELECT 'q[' || q || ']' AS name, round(avg(y), 4) AS coef FROM r WHERE q IS NOT NULL GROUP BY 1")
def missing_zero(spark, sf_dir):
    return coefs(spark, GLM(fit_intercept=False, alpha=0, cat_missing_method="zero").fit(_labelled(spark, sf_dir), "n_chars", features=["q"]), 4)


@query("WITH g AS (SELECT l_returnflag k, avg(l_quantity) m FROM lineitem GROUP BY 1), b AS (SELECT m FROM g ORDER BY k LIMIT 1) SELECT CASE WHEN g.m = b.m THEN 'intercept' ELSE 'l_returnflag[' || k || ']' END AS name, round(CASE WHEN g.m = b.m THEN b.m ELSE g.m - b.m END, 5) + 0.0 AS coef FROM g, b")
def drop_first(spark, sf_dir):
    return coefs(spark, GLM(alpha=0, formula="l_quantity ~ l_returnflag", drop_first=True).fit(lines(spark, sf_dir)))


@query("SELECT 'l_returnflag[' || l_returnflag || ']:l_linestatus[' || l_linestatus || ']' AS name, round(ln(avg(l_quantity)), 4) AS coef FROM lineitem GROUP BY 1")
def interaction_categorical(spark, sf_dir):
    """Combinations that no row has are left out here; the model gives them 0."""
    rows = lines(spark, sf_dir)
    m = GLM(family="poisson", alpha=0, fit_intercept=False, formula="l_quantity ~ l_returnflag:l_linestatus - 1", **TIGHT).fit(rows)
    seen = rows.select(F.concat(F.lit("l_returnflag["), "l_returnflag", F.lit("]:l_linestatus["), "l_linestatus", F.lit("]")).alias("name")).distinct()
    return coefs(spark, m, 4).join(seen, "name", "left_semi")


@query("SELECT 'l_discount:l_linestatus[' || l_linestatus || ']' AS name, round(sum(l_discount * l_quantity) / sum(l_discount * l_discount), 4) AS coef FROM lineitem GROUP BY 1")
def interaction_numeric(spark, sf_dir):
    return coefs(spark, GLM(alpha=0, fit_intercept=False, formula="l_quantity ~ l_discount:l_linestatus - 1").fit(lines(spark, sf_dir)), 4)


@query(f"WITH r AS (SELECT ln(l_quantity) y, exp(l_discount) x FROM lineitem), f AS (SELECT covar_pop(x, y) / var_pop(x) b, avg(x) mx, avg(y) my FROM r) SELECT 'exp(l_discount)' AS name, round(b, 5) AS coef FROM f UNION ALL SELECT 'intercept', round(my - b * mx, 5) FROM f")
def formula_functions(spark, sf_dir):
    m = GLM(alpha=0, formula="{np.log(l_quantity)} ~ {np.exp(l_discount)}").fit(lines(spark, sf_dir))
    return coefs(spark, m).withColumn("name", F.regexp_replace("name", r"^np\.", ""))


@query("SELECT round(avg(l_quantity), 4) AS mean, 6 AS columns")
def spline_fit(spark, sf_dir):
    """A spline with an intercept reproduces the mean of y."""
    rows = lines(spark, sf_dir)
    m = GLM(alpha=0, formula="l_quantity ~ bs(l_discount, df=5)").fit(rows)
    mean = m.predict(rows).agg(F.avg("prediction")).first()[0]
    return spark.createDataFrame([(round(mean, 4), len(m._named()[0]))], "mean double, columns int")


ORACLE_SQL["spline_fit"] = "SELECT round(avg(l_quantity), 4) AS mean, 6 AS columns FROM lineitem"


@query("WITH s AS (SELECT count(*) n, avg(l_tax) m, stddev_pop(l_tax) d FROM lineitem), u AS (SELECT l_quantity y, (l_tax - m) / d u, n FROM lineitem, s), k AS (SELECT avg(u ^ 3) c3, avg(u ^ 4) c4 FROM u) SELECT 'poly(l_tax, 2)[1]' AS name, round(sum(u * y) / sqrt(max(n)), 3) + 0.0 AS coef FROM u UNION ALL SELECT 'poly(l_tax, 2)[2]', round(sum((u * u - c3 * u - 1) * y) / sqrt(max(n) * max(c4 - c3 * c3 - 1)), 3) + 0.0 FROM u, k UNION ALL SELECT 'intercept', round(avg(y), 3) FROM u")
def polynomial_fit(spark, sf_dir):
    return coefs(spark, GLM(alpha=0, formula="l_quantity ~ poly(l_tax, 2)").fit(lines(spark, sf_dir)), 3)


@query("WITH g AS (SELECT l_linenumber k, count(*) n, avg(l_quantity) m FROM lineitem GROUP BY 1), p AS (SELECT a.k lo, b.k hi, (SELECT sum(n * m) / sum(n) FROM g WHERE k BETWEEN a.k AND b.k) v FROM g a, g b WHERE a.k <= b.k) SELECT 'C(l_linenumber)[' || k || ']' AS name, round((SELECT max(low) FROM (SELECT lo, min(v) low FROM p WHERE hi >= g.k AND lo <= g.k GROUP BY lo)), 4) AS coef FROM g")
def monotonic_fit(spark, sf_dir):
    """Increasing level means are the isotonic regression of the group means."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber")
    m = GLM(alpha=0, fit_intercept=False, formula="l_quantity ~ C(l_linenumber) - 1", monotonic_constraints={"l_linenumber": "increasing"}, **TIGHT).fit(rows)
    return coefs(spark, m, 4)


def flagship(spark, sf_dir):
    """How ordered quantity depends on the return flag and the discount."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_discount")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = GLM(family="poisson", alpha=0, drop_first=True, formula="l_quantity ~ C(l_returnflag) + l_discount").fit(rows)
        return m.coef_table(rows)


QUERIES["flagship"] = flagship
