"""Queries over families, links and aggregates: Column expressions against the same formulas in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import families as fam
from ..functions import links as lk

QUERIES, ORACLE_SQL = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: family, y, mu, weight in SQL; v, v', unit deviance and log-likelihood of a row in SQL ("phi" is the group's deviance dispersion, ddof 0).
_Y, _MU = "l_quantity", "(20 + 100 * l_discount)"
_FAMILIES = {
    "normal": (fam.NormalFamily(), _Y, _MU, "1", "0", "(y - m) ^ 2", "-w * (y - m) ^ 2 / (2 * phi) - w * ln(2 * pi() * phi) / 2"),
    "poisson": (fam.PoissonFamily(), _Y, _MU, "m", "1", "2 * (y * ln(y / m) - y + m)", "w * (y * ln(m) - m - lgamma(y + 1))"),
    "gamma": (fam.GammaFamily(), _Y, _MU, "m ^ 2", "2 * m", "2 * (ln(m / y) + y / m - 1)", "w * ((ln(y / m) - y / m) / phi - ln(y) - ln(phi) / phi - lgamma(1 / phi))"),
    "inverse_gaussian": (fam.InverseGaussianFamily(), _Y, _MU, "m ^ 3", "3 * m ^ 2", "(y / m - 1) ^ 2 / y", "-w * ((y / m - 1) ^ 2 / (2 * phi * y) + 1.5 * ln(y)) - w * ln(2 * pi() * phi) / 2"),
    "tweedie15": (fam.TweedieFamily(1.5), _Y, _MU, "m ^ 1.5", "1.5 * m ^ 0.5", "2 * (y ^ 0.5 / -0.25 - y * m ^ -0.5 / -0.5 + m ^ 0.5 / 0.5)", None),
    "binomial": (fam.BinomialFamily(), "(l_discount * 10)", "(0.2 + 5 * l_tax)", "m * (1 - m)", "1 - 2 * m", "-2 * (CASE WHEN y = 0 THEN 0 ELSE y * ln(m) END + CASE WHEN 1 - y = 0 THEN 0 ELSE (1 - y) * ln(1 - m) END)", "w * (CASE WHEN y = 0 THEN 0 ELSE y * ln(m) END + CASE WHEN 1 - y = 0 THEN 0 ELSE (1 - y) * ln(1 - m) END)"),
    "negative_binomial": (fam.NegativeBinomialFamily(0.5), _Y, _MU, "m + 0.5 * m ^ 2", "1 + m", "2 * (y * ln(y / m) - (y + 2) * ln((y + 2) / (m + 2)))", "w * (y * ln(0.5 * m) - (y + 2) * ln(1 + 0.5 * m) + lgamma(y + 2) - lgamma(y + 1))"),
    "hyperbolic_secant": (fam.HyperbolicSecantFamily(), "(l_quantity - 25)", "(10 * l_discount)", "1 + m ^ 2", "2 * m", "2 * y * (atan(y) - atan(m)) + ln((1 + m ^ 2) / (1 + y ^ 2))", None),
}


def _family(name, f, y_sql, mu_sql, likelihood):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", f"{y_sql} y".replace("^", "**"), f"{mu_sql} m", "1 + l_tax w")
        y, m, w = F.col("y"), F.col("m"), F.col("w")
        known = rows.groupBy("l_returnflag").agg(
            F.count("*").alias("n"), F.max((~f.in_y_range(y)).cast("int")).alias("out_of_range"), F.round(F.avg(f.variance(m, 1.0, w)), 6).alias("variance"), F.round(F.avg(f.variance_derivative(m, 1.0, w)), 6).alias("variance_derivative"),
            F.round(F.avg(f.unit_deviance(y, m)), 6).alias("unit_deviance"), F.round(F.avg(f.deviance_derivative(y, m, w)), 6).alias("deviance_derivative"), F.round(f.deviance(y, m, w), 3).alias("deviance"),
            F.round(f.dispersion(y, m, w), 6).alias("pearson"), F.round(f.dispersion(y, m, w, method="deviance"), 6).alias("deviance_dispersion"), f.dispersion(y, m, w, ddof=0, method="deviance").alias("phi"),
        )
        if not likelihood:
            return known.drop("phi")
        phi = known.select("l_returnflag", "phi")
        ll = rows.join(F.broadcast(phi), "l_returnflag").groupBy("l_returnflag").agg(F.round(F.sum(f.unit_log_likelihood(y, m, w, F.col("phi"))), 2).alias("log_likelihood"))
        return known.drop("phi").join(ll, "l_returnflag")

    return query


def _family_sql(f, y, mu, v, dv, dev, ll):
    low = "false" if f.lower == -float("inf") else f"y < {f.lower}" if f.include_lower else f"y <= {f.lower}"
    high = "false" if f.upper == float("inf") else f"y > {f.upper}"
    base = f"WITH r AS (SELECT l_returnflag, {y} AS y, {mu} AS m, 1 + l_tax AS w FROM lineitem)"
    known = f"""SELECT l_returnflag, count(*) AS n, max(CAST({low} OR {high} AS INTEGER)) AS out_of_range, round(avg(({v}) / w), 6) + 0.0 AS variance, round(avg(({dv}) / w), 6) + 0.0 AS variance_derivative,
      round(avg({dev}), 6) AS unit_deviance, round(avg(w * -2 * (y - m) / ({v})), 6) AS deviance_derivative, round(sum(w * ({dev})), 3) AS deviance,
      round(sum(w * (y - m) ^ 2 / ({v})) / (sum(w) - 1), 6) AS pearson, round(sum(w * ({dev})) / (sum(w) - 1), 6) AS deviance_dispersion FROM r GROUP BY 1"""
    if ll is None:
        return f"{base} {known}"
    return f"""{base}, k AS ({known}), p AS (SELECT l_returnflag, sum(w * ({dev})) / sum(w) AS phi FROM r GROUP BY 1),
    l AS (SELECT l_returnflag, round(sum({ll}), 2) AS log_likelihood FROM r JOIN p USING (l_returnflag) GROUP BY 1) SELECT * FROM k JOIN l USING (l_returnflag)"""


for _name, (_f, _y, _mu, _v, _dv, _dev, _ll) in _FAMILIES.items():
    QUERIES[f"family_{_name}"] = _family(_name, _f, _y, _mu, _ll is not None)
    ORACLE_SQL[f"family_{_name}"] = _family_sql(_f, _y, _mu, _v, _dv, _dev, _ll)

#: link, eta in SQL, then h, h', h'', g and g' in SQL of e (eta) and m (its inverse).
_LINKS = {
    "identity": (lk.IdentityLink(), "(l_discount + 0.5)", "e", "1", "0", "m", "1"),
    "log": (lk.LogLink(), "(l_discount * 20)", "exp(e)", "exp(e)", "exp(e)", "ln(m)", "1 / m"),
    "logit": (lk.LogitLink(), "(l_discount * 40 - 2)", "1 / (1 + exp(-e))", "(1 / (1 + exp(-e))) * (1 - 1 / (1 + exp(-e)))", "(1 / (1 + exp(-e))) * (1 - 1 / (1 + exp(-e))) * (1 - 2 / (1 + exp(-e)))", "ln(m / (1 - m))", "1 / (m * (1 - m))"),
    "cloglog": (lk.CloglogLink(), "(l_discount * 20 - 1.5)", "1 - exp(-exp(e))", "exp(e - exp(e))", "exp(e - exp(e)) * (1 - exp(e))", "ln(-ln(1 - m))", "1 / ((m - 1) * ln(1 - m))"),
    "tweedie": (lk.TweedieLink(1.5), "(l_discount + 0.5)", "e ^ -2", "-2 * e ^ -3", "6 * e ^ -4", "m ^ -0.5", "-0.5 * m ^ -1.5"),
}


def _link(g, eta):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", f"{eta} e").withColumn("m", g.inverse(F.col("e")))
        e, m = F.col("e"), F.col("m")
        made = {"inverse": g.inverse(e), "inverse_derivative": g.inverse_derivative(e), "inverse_derivative2": g.inverse_derivative2(e), "link": g.link(m), "derivative": g.derivative(m)}
        return rows.groupBy("l_linestatus").agg(*((F.round(F.avg(c), 6) + F.lit(0.0)).alias(n) for n, c in made.items()))

    return query


for _name, (_g, _eta, *_exprs) in _LINKS.items():
    QUERIES[f"link_{_name}"] = _link(_g, _eta)
    _cols = ", ".join(f"round(avg({x}), 6) + 0.0 AS {n}" for x, n in zip(_exprs, ("inverse", "inverse_derivative", "inverse_derivative2", "link", "derivative")))
    ORACLE_SQL[f"link_{_name}"] = f"WITH r AS (SELECT l_linestatus, {_eta} AS e FROM lineitem), s AS (SELECT *, {_exprs[0]} AS m FROM r) SELECT l_linestatus, {_cols} FROM s GROUP BY 1"
