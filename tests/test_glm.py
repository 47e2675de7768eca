import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators.glm import GeneralizedLinearRegressor as GLM
from fathom.operators.glm_cv import GeneralizedLinearRegressorCV as GLMCV
from fathom.plans import formula as M
from fathom.plans import monotone
from fathom.plans.design import Design, Factor
from fathom.sources import models, synthetic, tables


def rows(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")


A = [(-2, 0), (-1, 0), (1, 1), (2, 1)]
B = [(-1, 0), (1, 0), (1, 1), (2, 1)]
C = [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1)]


# Published coefficients of small penalised models.
@pytest.mark.parametrize(
    "x,y,options,intercept,coef,tol",
    [
        (A, [0, 1, 1, 2], {"family": "poisson"}, -0.12889386979, [0.29019207995, 0.03741173122], 1e-5),
        (A, [0, 1, 1, 2], {"family": "poisson", "solver": "lbfgs"}, -0.12889386979, [0.29019207995, 0.03741173122], 1e-5),
        (A, [0, 1, 1, 2], {"family": "poisson", "scale_predictors": True}, -0.21002571, [0.16472093, 0.27051971], 1e-5),
        (B, [0, 1, 1, 2], {"family": "poisson", "lower_bounds": -0.1, "upper_bounds": 0.1}, -0.13568186971946633, [0.1, 0.1], 1e-6),
        (B, [0, 1, 1, 2], {"family": "poisson", "A_ineq": np.array([[1, 0], [0, 1], [-1, 0], [0, -1]]), "b_ineq": np.full(4, 0.1)}, -0.13568186971946633, [0.1, 0.1], 1e-6),
        (A, [0, 1, 1, 2], {"family": "poisson", "l1_ratio": 0.5}, -0.03550978409, [0.16936423283, 0], 1e-5),
        (C, [0, 0, 1, 0, 1, 1], {"family": "binomial", "link": "cloglog", "l1_ratio": 0.5}, -0.9210348370, [0.1743465641, 0], 1e-3),
        (C, [0.2, 0.5, 0.8, 0.3, 0.9, 0.9], {"family": "inverse.gaussian", "link": "log", "l1_ratio": 0.5}, -1.028655076, [0.123000467, 0], 1e-3),
    ],
)
def test_penalised_constants(spark, x, y, options, intercept, coef, tol):
    m = GLM(alpha=1, gradient_tol=1e-8, **options).fit(rows(spark, x, y), "y")
    assert m.intercept_ == pytest.approx(intercept, rel=tol, abs=tol)
    assert m.coef_ == pytest.approx(coef, rel=tol, abs=tol)


def test_categories_equal_indicators(spark):
    df = synthetic.mixed_data(spark, "poisson", 500, dense=2, categorical=(4,), seed=3)
    m = GLM(family="poisson", alpha=0.01, gradient_tol=1e-8).fit(df, "y", features=["dense0", "dense1", "cat0"])
    wide = df.select("*", *((F.col("cat0") == f"l{k}").cast("double").alias(f"i{k}") for k in range(4)))
    n = GLM(family="poisson", alpha=0.01, gradient_tol=1e-8).fit(wide, "y", features=["dense0", "dense1", "i0", "i1", "i2", "i3"])
    assert m.coef_ == pytest.approx(n.coef_, abs=1e-6)
    assert m.feature_names_[2:] == [f"cat0[l{k}]" for k in range(4)]
    got = m.predict(df).agg(F.sum("prediction")).first()[0]
    assert got == pytest.approx(df.agg(F.sum("y")).first()[0], rel=1e-4)


def test_save_and_load(spark, tmp_path):
    df = synthetic.mixed_data(spark, "gamma", 300, dense=1, categorical=(3,), seed=5)
    m = GLM(family="gamma", alpha=0, formula="y ~ dense0 + cat0", drop_first=True).fit(df)
    models.save(m, spark, f"file://{tmp_path}/m")
    again = models.load(spark, f"file://{tmp_path}/m")
    a, b = m.predict(df).agg(F.sum("prediction")).first()[0], again.predict(df).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b, rel=1e-12)
    text = models.to_json(m)
    assert models.from_json(text.replace('"version": 2', '"version": 1')).coef_ == pytest.approx(m.coef_)
    with pytest.raises(ValueError, match="version 9"):
        models.from_json(text.replace('"version": 2', '"version": 9'))


def test_sources(spark, tmp_path):
    class Sparse:  # what a sparse matrix library gives
        shape, indptr, indices, data = (3, 4), np.array([0, 2, 2, 3]), np.array([0, 3, 1]), np.array([1.0, 2.0, 5.0])

        def tocsr(self):
            return self

    rows = tables.from_arrays(spark, Sparse(), [1, 2, 3], offset=0.5).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 2, 1, 0.5), (0, 0, 0, 0, 2, 0.5), (0, 5, 0, 0, 3, 0.5)]
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "k string, v double")
    tables.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"file://{tmp_path}/c", "k string, v string", casts={"v": "double"}).collect())) == [("a", 1.5), ("b", 2.5)]
    tables.write_parquet(df, f"file://{tmp_path}/p")
    assert tables.read_parquet(spark, f"file://{tmp_path}/p", ["v"]).columns == ["v"]
    assert tables.spread_array(spark.createDataFrame([([1.0, 2.0],)], "x array<double>"), "x", 2).first() == (1.0, 2.0)
    made = synthetic.categorical_dataset(spark, 400, (5, 3), seed=2)
    assert made.count() == 400 and made.select("cat0").distinct().count() == 5
    assert len(synthetic.glm_dataset(spark, 200).columns) == 3


def test_given_splits_and_whole_refit_path(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    df = tables.from_arrays(spark, x, x[:, 0] + rng.normal(size=60)).withColumn("f", (F.abs(F.hash("y")) % 3).cast("int"))
    one = GLMCV(cv="f", alphas=[10, 1, 0.001], l1_ratio=[0.0, 0.5]).fit(df, "y")
    two = GLMCV(cv=[(F.col("f") != k, F.col("f") == k) for k in range(3)], alphas=[10, 1, 0.001], l1_ratio=[0.0, 0.5]).fit(df, "y", features=["_col_0", "_col_1"])
    assert two.deviance_path_ == pytest.approx(one.deviance_path_) and two.train_deviance_path_ == pytest.approx(one.train_deviance_path_)
    assert one.coef_path_.shape == (3, 2) and one.fold_coef_path_.shape == (3, 2, 3, 2)
    for k, a in enumerate([10, 1, 0.001]):
        single = GLM(alpha=a, l1_ratio=one.l1_ratio_).fit(df, "y", features=["_col_0", "_col_1"])
        assert one.coef_path_[k] == pytest.approx(single.coef_, abs=1e-3)
        assert one.predict(df, alpha=a).count() == 60
    assert one.coef_ == pytest.approx(one.coef_path_[list(one._alphas).index(one.alpha_)])
    with pytest.raises(ValueError, match="cv must be"):
        GLMCV(cv=1, order_by="y").fit(df, "y")


def test_moments_of_wide_scales(spark):
    from fathom.operators import prep

    df = spark.createDataFrame([("a", 1e9, 1.0), ("a", 1e9 + 1, 1.0), ("b", -5.0, 2.0), ("c", 1.0, 0.0)], "g string, x double, w double")
    got = {r.g: (r.mean, r.variance, r.weight) for r in prep.weighted_moments(df, "g", "x", "w").collect()}
    assert got == {"a": (1e9 + 0.5, 0.25, 2.0), "b": (-5.0, 0.0, 2.0), "c": (None, None, 0.0)}


def test_ewma_over_many_blocks(spark):
    from fathom.operators import prep

    rng = np.random.default_rng(3)
    v = [None if k % 7 == 0 else float(x) for k, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "g string, k long, v double")
    for span in (1.5, 20.0):
        got = [r.ewma for r in prep.ewma(df, "g", "k", "v", span).orderBy("k").collect()]
        decay, top, low, want = 1 - 2 / (span + 1), 0.0, 0.0, []
        for x in v:
            if x is not None:
                top, low = top * decay + x, low * decay + 1
            want.append(top / low if low else None)
        assert got[0] is None and got[1:] == pytest.approx(want[1:], rel=1e-9, abs=1e-12)


def test_kernel_average_beyond_its_reach(spark):
    from fathom.operators import prep

    zones = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 1.0), (2, 1.0, 0.0, 20.0, 1.0), (3, 30.0, 0.0, 70.0, 2.0)], "z int, x double, y double, v double, w double")
    got = {r.z: r.smooth for r in prep.kernel_average(zones, "z", "x", "y", "v", "w", 1.0).collect()}
    assert got[1] == 20 and got[2] == 10 and 10 < got[3] <= 20
    alone = prep.kernel_average(zones.where("z = 3"), "z", "x", "y", "v", "w", 1.0).first()
    assert alone.smooth is None


def test_distance_penalty():
    from fathom.operators import prep

    p = np.array(prep.distance_penalty([(0, 0), (3, 4), (0, 0)], zeros=1))
    assert p[0].tolist() == [0] * 4 and p.sum(axis=1) == pytest.approx([0] * 4)
    assert p[1, 3] == -1 and p[1, 2] == p[2, 3] == -1 and np.linalg.eigvalsh(p).min() > -1e-12


def test_start_with_offsets(spark):
    """Beside an offset alone, the start is the solution under a log link."""
    rng = np.random.default_rng(5)
    o = rng.normal(size=50)
    df = tables.from_arrays(spark, rng.normal(size=(50, 1)), rng.gamma(2.0, np.exp(o + 0.7)), offset=o)
    for family in ("poisson", "gamma", "tweedie(1.5)"):
        m = GLM(family=family, link="log", alpha=1e6, gradient_tol=1e-9).fit(df, "y", offset="offset", features=["_col_0"])
        coded = m._prepare(df, "y", None, "offset", ["_col_0"], None)
        assert m._guess(m._moments(coded)[0]) == pytest.approx(m.intercept_, abs=1e-5)


def test_trust_region_and_streamed_clusters(spark):
    df = synthetic.mixed_data(spark, "poisson", 400, dense=2, categorical=(3,), seed=8).withColumn("g", F.floor(F.abs(F.col("dense0") * 40)).cast("string"))
    names = ["dense0", "dense1", "cat0"]
    m = GLM(family="poisson", alpha=0.01, solver="trust-constr").fit(df, "y", features=names)
    n = GLM(family="poisson", alpha=0.01, gradient_tol=1e-9).fit(df, "y", features=names)
    assert m.coef_ == pytest.approx(n.coef_, abs=1e-6)
    free = GLM(family="poisson", alpha=0, drop_first=True).fit(df, "y", features=names)
    v = free.covariance_matrix(df, "y", clusters="g")
    data = df.toPandas()
    x = np.column_stack([np.ones(len(data)), data.dense0, data.dense1, data.cat0 == "l1", data.cat0 == "l2"]).astype(float)
    mu = np.exp(x @ np.concatenate([[free.intercept_], free.coef_]))
    s = x * (data.y.to_numpy() - mu)[:, None]
    groups = [s[(data.g == g).to_numpy()].sum(axis=0) for g in data.g.unique()]
    h = np.linalg.inv((x * mu[:, None]).T @ x)
    want = h @ sum(np.outer(g, g) for g in groups) @ h * len(groups) / (len(groups) - 1) * (len(x) - 1) / (len(x) - x.shape[1])
    assert v == pytest.approx(want, rel=1e-5)


def test_names_of_the_caller(spark):
    def doubled(c):
        return 2 * c

    df = rows(spark, [(1, 0), (2, 1), (3, 1)], [2, 4, 6])
    assert GLM(alpha=0, formula="y ~ doubled(a)").fit(df, context=0).coef_ == pytest.approx([1.0])
    with pytest.raises(TypeError, match="context"):
        GLM(alpha=0, formula="y ~ a").fit(df, context="x")
    with pytest.raises(ValueError, match="cyclic"):
        GLM(alpha=0, formula="y ~ cc(a, df=3)").fit(df)


def test_formula_terms():
    assert M.parse("y ~ a * b - a:b + 1") == ("y", [("a",), ("b",)], True)
    assert M.parse("y ~ (a + b + c) ** 2 - a:c")[1] == [("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    assert M.parse("y ~ a:C(b) - 1")[1:] == ([("a", "C(b)")], False)
    with pytest.raises(ValueError):
        M.parse("a + b ~ c")
    with pytest.raises(TypeError):
        M.parse(3)
    a, r = M.constraint("a + b = 2 * c - 1, a", ["a", "b", "c"])
    assert a.tolist() == [[1, 1, -2], [1, 0, 0]] and r.tolist() == [-1, 0]


def test_monotonic_rows(spark):
    level = lambda name, *levels: Factor(name, F.lit(0), levels=list(levels))
    one = level("sp", "10", "2", "1", "3")
    a, b = monotone.rows(Design([("sp", [one], (False,))]), {"sp": "increasing"})
    assert a.tolist() == [[0, -1, 1, 0], [0, 1, 0, -1], [-1, 0, 0, 1]] and not b.any()
    x = Factor("x", F.lit(0), [("x", F.lit(0))])
    both = Design([("x", [x], (False,)), ("g:sp", [level("g", "a", "b"), level("sp", "1", "2")], (False, False))])
    a, _ = monotone.rows(both, {"sp": "decreasing", "x": "increasing"})
    assert sorted(a.tolist()) == [[-1, 0, 0, 0, 0], [0, -1, 1, 0, 0], [0, 0, 0, -1, 1]]
    a, _ = monotone.rows(Design([("sp:x", [level("sp", "b", "a"), x], (False, False))]), {"x": "increasing"})
    assert a.tolist() == [[-1, 0], [0, -1]]
    with pytest.raises(ValueError, match="itself"):
        monotone.rows(Design([("sp:C(sp)", [one, Factor("C(sp)", F.lit(0), levels=["1"], variable="sp")], (False, False))]), {"sp": "increasing"})
    with pytest.raises(ValueError, match="belongs to z"):
        monotone.rows(both, {"z": "increasing"})
    with pytest.raises(ValueError, match="do not apply"):
        monotone.rows(Design([("poly(x, 2)", [Factor("poly(x, 2)", F.lit(0), [("p", F.lit(0))], variable="x", ordered=False)], (False,))]), {"x": "increasing"})


def test_unseen_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "g string, y double")
    with pytest.raises(ValueError, match="missing values"):
        GLM(alpha=0, fit_intercept=False).fit(df, "y")
    m = GLM(alpha=0, fit_intercept=False, cat_missing_method="convert").fit(df, "y")
    assert m.feature_names_ == ["g[a]", "g[b]", "g[(MISSING)]"] and m.coef_ == pytest.approx([1, 2, 3])
    with pytest.raises(Exception, match="unseen categories"):
        m.predict(spark.createDataFrame([("z",)], "g string")).collect()


# The parts of messages that callers match on.
@pytest.mark.parametrize(
    "options,kind,text",
    [
        ({"alpha": -1}, ValueError, "non-negative"), ({"l1_ratio": 2}, ValueError, "l1_ratio"), ({"fit_intercept": 1}, TypeError, "fit_intercept must be bool"), ({"max_iter": 0}, ValueError, "positive integer"),
        ({"gradient_tol": 0}, ValueError, "gradient stopping"), ({"step_size_tol": -1}, ValueError, "step-size stopping"), ({"selection": "x"}, ValueError, "selection must be"), ({"P2": np.diag([-1.0, 1.0])}, ValueError, "positive semi-definite"),
        ({"solver": "closed-form", "alpha": 1, "l1_ratio": 1}, ValueError, "solver=closed-form"), ({"lower_bounds": [1, 1], "upper_bounds": [0, 0]}, ValueError, "bounds"),
    ],
)
def test_argument_errors(spark, options, kind, text):
    with pytest.raises(kind, match=text):
        GLM(**options).fit(rows(spark, A, [0, 1, 1, 2]), "y")


def test_data_errors(spark):
    df = rows(spark, A, [0, 1, 1, 2])
    with pytest.raises(ValueError, match="non-negative"):
        GLM().fit(df, "y", sample_weight=F.lit(-1.0), features=["a"])
    with pytest.raises(ValueError, match="all be zero"):
        GLM().fit(df, "y", sample_weight=0, features=["a"])
    with pytest.raises(ValueError, match="out of the valid range"):
        GLM(family="gamma").fit(df, "y", features=["a"])
    with pytest.raises(ValueError, match="No variation"):
        GLM(family="poisson").fit(df.withColumn("y", F.lit(1.0)), "y", features=["a"])


def test_path_and_lookup(spark):
    df = tables.from_arrays(spark, np.random.default_rng(0).normal(size=(50, 2)), np.arange(50.0))
    m = GLM(alpha_search=True, alphas=[1.0, 0.1], l1_ratio=1).fit(df, "y")
    one = GLM(alpha=0.1, l1_ratio=1).fit(df, "y")
    assert m.coef_path_[1] == pytest.approx(one.coef_, abs=1e-6)
    assert len(m.predict(df, alpha=[1.0, 0.1]).first().prediction) == 2
    with pytest.raises(IndexError):
        m.predict(df, alpha=7.0)
    with pytest.raises(ValueError):
        m.predict(df, alpha=1.0, alpha_index=0)
    with pytest.raises(ValueError, match="alpha_search"):
        one.predict(df, alpha_index=0)


def test_cross_validation_matches_single_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    df = tables.from_arrays(spark, x, rng.poisson(np.exp(0.3 * x[:, 0] + 0.5)).astype(float)).withColumn("k", F.monotonically_increasing_id())
    m = GLMCV(cv=4, order_by="k", family="poisson", alphas=[0.5, 0.01], gradient_tol=1e-8).fit(df, "y", features=["_col_0", "_col_1"])
    table = m.cv_table(spark).toPandas()
    ordered = df.orderBy("k").toPandas()
    train = spark.createDataFrame(ordered.iloc[10:])
    one = GLM(family="poisson", alpha=0.01, gradient_tol=1e-8).fit(train, "y", features=["_col_0", "_col_1"])
    test = ordered.iloc[:10]
    mu = np.exp(one.intercept_ + test[["_col_0", "_col_1"]].to_numpy() @ one.coef_)
    wanted = one.family_instance_.deviance(test.y.to_numpy(), mu) / 10
    got = table[(table.fold == 0) & (table.alpha == 0.01)].test_deviance.iloc[0]
    assert got == pytest.approx(wanted, rel=1e-6)


def test_streaming_score(spark, tmp_path):
    from fathom.streaming.scoring import RunningLeastSquares, score_stream

    df = tables.from_arrays(spark, [[1.0], [2.0], [3.0]], [2.0, 4.0, 6.0])
    m = GLM(alpha=0).fit(df, "y")
    df.write.parquet(f"file://{tmp_path}/in")
    q = score_stream(m, spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.prediction for r in spark.table("scored").collect()) == pytest.approx([2, 4, 6])
    running = RunningLeastSquares(["_col_0"], "y")
    for k in range(2):
        running.update(df, k)
    running.update(df, 1)
    assert running.rows == 6 and running.coefficients() == pytest.approx([0, 2], abs=1e-9)


def test_messages_of_inference(spark):
    df = synthetic.mixed_data(spark, "poisson", 200, dense=2, categorical=(3,), seed=8)
    names = ["dense0", "dense1"]
    m = GLM(family="poisson", alpha=0).fit(df, "y", features=names)
    with pytest.raises(ValueError, match="Exactly one"):
        m.wald_test(df, "y")
    with pytest.raises(ValueError, match="Exactly one"):
        m.wald_test(df, "y", R=np.eye(3), features="dense0")
    with pytest.raises(ValueError, match="Either X and y must be provided"):
        m.covariance_matrix()
    m.covariance_matrix(df, "y", store_covariance_matrix=True)
    with pytest.raises(ValueError, match="Cannot reestimate the covariance matrix with different"):
        m.covariance_matrix(robust=False)
    with pytest.warns(UserWarning, match="A covariance matrix has already been computed."):
        m.covariance_matrix(df, "y", store_covariance_matrix=True)
    ridge = GLM(family="poisson", alpha=0.1).fit(df, "y", features=names)
    with pytest.warns(UserWarning, match="Covariance matrix estimation assumes"):
        ridge.covariance_matrix(df, "y")
    with pytest.warns(UserWarning, match="There is no"):
        ridge.aic(df, "y")
    with pytest.raises(ValueError, match="The formula sets the intercept to False"):
        GLM(alpha=0, formula="y ~ dense0 - 1").fit(df)
    with pytest.raises(ValueError, match="already exists"):
        GLM(alpha=0, cat_missing_method="convert").fit(spark.createDataFrame([("(MISSING)", 1.0), (None, 2.0)], "g string, y double"), "y")
    with pytest.warns(UserWarning, match="failed to converge"):
        GLM(family="poisson", alpha=0, max_iter=1, gradient_tol=1e-12).fit(df, "y", features=names)
    for given in ([[1.0]], np.ones((2, 2))):
        with pytest.raises(ValueError, match="must be 1D array or scalar"):
            GLM(alpha=0).fit(df, "y", sample_weight=given, features=names)
    with pytest.raises(ValueError, match="finite"):
        GLM(alpha=0).fit(df, "y", offset=float("nan"), features=names)
    for bounds in ([1.0, 2.0, 3.0, 4.0], [float("nan"), 0.0]):
        with pytest.raises(ValueError, match="bounds"):
            GLM(alpha=0, lower_bounds=bounds).fit(df, "y", features=names)
    for options in ({"max_inner_iter": 0}, {"hessian_approx": 2}, {"n_alphas": 0}, {"min_alpha_ratio": 3}, {"verbose": -1}):
        with pytest.raises(ValueError):
            GLM(**options).fit(df, "y", features=names)
