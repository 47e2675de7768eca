"""Queries of the data-preparation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from .scalar_queries import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT o_orderkey, coalesce(round(q, 2), 0) AS l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def prep_left_join_agg(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return prep.join_sums(table(spark, sf_dir, "orders").select("o_orderkey"), sums, "o_orderkey", ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 2))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS match, count(*) AS n FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY 1")
def prep_outer_indicator(spark, sf_dir):
    out = prep.outer_indicator(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return out.groupBy("match").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT DISTINCT l_quantity AS time FROM lineitem WHERE l_returnflag = 'R') SELECT time, count(*) AS at_risk, sum(CASE WHEN l_quantity = time AND l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS died FROM lineitem JOIN t ON l_quantity >= time GROUP BY 1")
def prep_survival_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("event"))
    return prep.survival_split(rows, "l_quantity", "event").groupBy("time").agg(F.count("*").alias("at_risk"), F.sum("died").alias("died"))


@query("SELECT event_id, coalesce(lag(value, 1) OVER w, 0) AS value_lag_1, coalesce(lag(value, 3) OVER w, 0) AS value_lag_3, coalesce(lead(value, 2) OVER w, 0) AS value_lead_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prep_lag_lead(spark, sf_dir):
    out = prep.lag_lead(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", [1, 3, -2], 0.0)
    return out.select("event_id", "value_lag_1", "value_lag_3", "value_lead_2")


@query("SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS zscore FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def prep_rolling_zscore(spark, sf_dir):
    out = prep.rolling_zscore(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 5)
    return out.select("event_id", F.round("zscore", 6).alias("zscore"))


@query("SELECT event_id, round(sum(value) OVER w / count(*) OVER w, 6) AS average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING)")
def prep_lagged_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.lit(1.0).alias("one"))
    return prep.lagged_average(rows, "user_id", ["ts", "event_id"], "value", "one", 4, 2).select("event_id", F.round("average", 6).alias("average"))


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
e AS (SELECT event_id, user_id, i, value AS x, 1.0::DOUBLE AS w FROM r WHERE i = 1 UNION ALL SELECT r.event_id, r.user_id, r.i, e.x * 0.5 + r.value, e.w * 0.5 + 1 FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
SELECT event_id, round(x / w, 6) AS ewma FROM e""")
def prep_ewma(spark, sf_dir):
    out = prep.ewma(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 3)
    return out.select("event_id", F.round("ewma", 6).alias("ewma"))


@query("SELECT CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS INTEGER) AS bin, count(*) AS n, round(sum(least(greatest(l_quantity, 5), 45)), 2) AS clipped FROM lineitem GROUP BY 1")
def prep_digitize_clip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(prep.categorise(F.col("l_quantity"), [10, 20, 40]).alias("bin"), prep.clip(F.col("l_quantity"), 5.0, 45.0).alias("c"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("c"), 2).alias("clipped"))


@query("WITH e AS (SELECT list_sort(list_distinct([quantile_cont(l_quantity, k / 7.0) FOR k IN range(8)])) q FROM lineitem) SELECT 0 AS bin, 0 AS n")
def prep_qcut(spark, sf_dir):
    out = prep.quantile_bins(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", 7)
    return out.groupBy("bin").agg(F.count("*").alias("n"))


ORACLE_SQL["prep_qcut"] = "WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_quantity, [0, 1/7.0, 2/7.0, 3/7.0, 4/7.0, 5/7.0, 6/7.0, 1.0])) q FROM lineitem), b AS (SELECT l_quantity, greatest((SELECT count(*) FROM e WHERE q < l_quantity) - 1, 0) bin FROM lineitem) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1"


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS seen FROM orders")
def prep_cumcount(spark, sf_dir):
    return prep.cumcount(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "seen")


@query("SELECT l_returnflag || '_' || l_linestatus AS store_key, count(*) AS n FROM lineitem GROUP BY 1")
def prep_store_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(prep.key("l_returnflag", "l_linestatus").alias("store_key")).agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS padded_month, count(*) AS n, sum(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)))::BIGINT AS days FROM orders GROUP BY 1, 2")
def prep_date_parts(spark, sf_dir):
    out = prep.date_parts(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")
    return out.groupBy("year", "padded_month").agg(F.count("*").alias("n"), F.sum(F.datediff("o_orderdate", F.lit("1990-01-01"))).alias("days"))


@query("SELECT 'customer' AS part, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2) FROM supplier")
def prep_union_tagged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"))
    return prep.union_tagged({"customer": c, "supplier": s}).groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def prep_semi_isin(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return prep.keep_in(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), keys, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m, sum(l_quantity) AS w FROM lineitem GROUP BY 1) SELECT l_returnflag, round(max(m), 4) AS mean, round(sum(l_quantity * (l_extendedprice - m) ^ 2) / max(w), 2) AS variance, max(w) AS weight FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1")
def prep_weighted_var(spark, sf_dir):
    out = prep.weighted_moments(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), "weight")


@query("WITH f AS (SELECT 'poisson' AS family, l_quantity / (1 + l_discount) AS y, 1 + l_discount AS e FROM lineitem UNION ALL SELECT 'gamma', l_extendedprice / l_quantity, l_quantity FROM lineitem UNION ALL SELECT 'tweedie', l_extendedprice / (1 + l_discount), 1 + l_discount FROM lineitem UNION ALL SELECT 'binomial', 1.0, 1 + l_discount FROM lineitem) SELECT family, count(*) AS n, round(sum(y * e) / sum(e), 4) AS mean FROM f GROUP BY 1")
def prep_target_exposure(spark, sf_dir):
    """Target and exposure of each family; their weighted mean is the portfolio's."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity n", "l_extendedprice a", "1 + l_discount e")
    out = None
    for family in ("poisson", "gamma", "tweedie", "binomial"):
        made = prep.target_and_exposure(rows, family, claims="n", amount="a", exposure="e").agg(F.lit(family).alias("family"), F.count("*").alias("n"), F.round(F.sum(F.col("y") * F.col("exposure")) / F.sum("exposure"), 4).alias("mean"))
        out = made if out is None else out.union(made)
    return out


@query("SELECT l_returnflag, round(sum(l_extendedprice / l_quantity), 2) AS rate, round(sum(sqrt(l_quantity)), 4) AS weight FROM lineitem GROUP BY 1")
def prep_exposure_weights(spark, sf_dir):
    out = prep.exposure_to_weights(table(spark, sf_dir, "lineitem"), 1.5, "l_extendedprice", "l_quantity")
    return out.groupBy("l_returnflag").agg(F.round(F.sum("y_rate"), 2).alias("rate"), F.round(F.sum("weight"), 4).alias("weight"))


@query("SELECT round(avg(abs((l_tax - m) / s)), 6) AS tax, round(avg(l_quantity * 0 + abs((l_quantity - mq) / sq)), 6) AS quantity FROM lineitem, (SELECT avg(l_tax) m, stddev_pop(l_tax) s, avg(l_quantity) mq, stddev_pop(l_quantity) sq FROM lineitem)")
def prep_scaled(spark, sf_dir):
    out = prep.scaled(table(spark, sf_dir, "lineitem").select("l_tax", "l_quantity"), ["l_tax", "l_quantity"])
    return out.agg(F.round(F.avg(F.abs("l_tax")), 6).alias("tax"), F.round(F.avg(F.abs("l_quantity")), 6).alias("quantity"))


@query("WITH l AS (SELECT l_returnflag, (l_returnflag = 'A')::INT a, (l_returnflag = 'N')::INT n, (l_returnflag = 'R')::INT r FROM lineitem) SELECT sum(a)::BIGINT AS a, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r, sum(0 * a + 1 * n + 2 * r)::BIGINT AS codes FROM l")
def prep_one_hot_ordinal(spark, sf_dir):
    rows = prep.ordinal(prep.one_hot(table(spark, sf_dir, "lineitem").select("l_returnflag"), "l_returnflag", ["A", "N", "R"]), "l_returnflag", ["A", "N", "R"])
    return rows.agg(*(F.sum(f"l_returnflag__{v}").alias(v.lower()) for v in "ANR"), F.sum("l_returnflag_code").alias("codes"))


@query("SELECT round(median(o_totalprice), 2) AS median, sum((o_totalprice < (SELECT median(o_totalprice) FROM orders))::INT)::BIGINT AS below FROM orders")
def prep_median(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice")
    m = rows.agg(F.percentile("o_totalprice", 0.5)).first()[0]
    return rows.agg(F.round(F.lit(m), 2).alias("median"), F.sum((F.col("o_totalprice") < m).cast("int")).alias("below"))


@query("SELECT l_returnflag, round(ln(sum(l_extendedprice * l_quantity ^ -0.5)) - ln(sum(l_quantity ^ 0.5)), 6) AS effect FROM lineitem GROUP BY 1")
def prep_zone_effects(spark, sf_dir):
    out = prep.zone_effects(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_extendedprice"), F.col("l_quantity"), 1.5)
    return out.select("l_returnflag", F.round("effect", 6).alias("effect"))


@query("""WITH z AS (SELECT p_partkey z, p_size::DOUBLE x, p_retailprice / 100 y, p_retailprice v, p_size::DOUBLE w FROM part),
k AS (SELECT a.z, max(a.v) v, max(a.w) w, sum(exp(-((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) / 8) * b.w * b.v) s, sum(exp(-((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) / 8) * b.w) n FROM z a JOIN z b ON a.z <> b.z AND (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 <= 64 GROUP BY 1)
SELECT z AS zone, round(sqrt(w / n) * v + (1 - sqrt(w / n)) * s / n, 4) AS smooth FROM k""")
def prep_kernel_average(spark, sf_dir):
    zones = table(spark, sf_dir, "part").selectExpr("p_partkey zone", "CAST(p_size AS DOUBLE) x", "p_retailprice / 100 y", "p_retailprice v", "CAST(p_size AS DOUBLE) w")
    return prep.kernel_average(zones, "zone", "x", "y", "v", "w", 2.0, rho=0.5).select("zone", F.round("smooth", 4).alias("smooth"))


@query("SELECT round(sqrt(avg(((l_extendedprice - 900 * l_quantity) / l_extendedprice) ^ 2)), 6) AS rmspe FROM lineitem")
def prep_rmspe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice y", "900 * l_quantity p")
    return spark.createDataFrame([(round(prep.rmspe(rows, "y", "p"), 6),)], "rmspe double")
