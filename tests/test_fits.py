"""Fits over Spark: forms of data agree, components, chains, moments, posterior and prediction identities."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.fit import fit, fit_array, fit_eigen, fit_sparse, fit_ss
from bayesmill.operators import diagnostics as D
from bayesmill.operators import eigen as E
from bayesmill.operators import gram as G
from bayesmill.operators import posterior as P
from bayesmill.operators import predict as R
from bayesmill.plans.spec import SpecError
from bayesmill.sources.quality import DataError, check_observations, profile

RUN = {"iterations": 120, "burnin": 20, "seed": 5}


@pytest.fixture(scope="module")
def data(spark):
    i = np.arange(80)
    x = {"signal": np.linspace(-2, 2, 80), "nuisance": np.where(i % 2, 1.0, -1.0), "noise1": np.sin(i + 1.0), "noise2": np.cos(i + 1.0)}
    y = 1 + 2.5 * x["signal"] + 0.15 * x["nuisance"]
    rows = list(zip(y.tolist(), *(v.tolist() for v in x.values()), strict=True))
    return spark.createDataFrame(rows, "y double, signal double, nuisance double, noise1 double, noise2 double").repartition(3).persist(), np.column_stack(list(x.values())), y


def draws(f):
    return sorted(((r["chain"], r["draw"], *r["theta"], r["residual_var"]) for r in f.draws.collect()))


BLOCKS = {"a": {"model": "Normal", "columns": ["signal", "nuisance"]}, "b": {"model": "SpikeSlab", "columns": ["noise1", "noise2"]}}


def test_array_column_equals_columns(spark, data):
    df, *_ = data
    arr = df.select("y", F.array("signal", "nuisance", "noise1", "noise2").alias("x"))
    kw = {"residual_shape": 3.0, "residual_scale": 1.0, **RUN}
    a = draws(fit(df, "y", BLOCKS, **kw))
    b = draws(fit_array(arr, "y", "x", {"a": {"model": "Normal", "indices": [0, 1]}, "b": {"model": "SpikeSlab", "indices": ["x3", "x4"]}}, **kw))
    assert np.allclose(a, b, atol=1e-9)
    for bad in (arr.withColumn("x", F.when(F.col("y") > 0, F.col("x"))), arr.withColumn("x", F.when(F.col("y") > 0, F.col("x")).otherwise(F.array(F.lit(1.0)))), arr.withColumn("x", F.array(F.lit(float("nan")))), arr.limit(1), arr.withColumn("x", F.array(F.lit(1.0), F.col("y")))):
        with pytest.raises(DataError):
            fit_array(bad, "y", "x", {"model": "Normal"}, residual_var=1.0, **RUN)


def as_indices(blocks):
    return {k: {**{a: b for a, b in v.items() if a != "columns"}, "indices": v["columns"]} for k, v in blocks.items()}


def test_moments_survive_an_offset(data):
    df, x, y = data
    s = G.from_observations(df.withColumn("y", F.col("y") + 1e9), "y", ["signal", "nuisance", "noise1", "noise2"])
    c = x - x.mean(axis=0)
    assert np.allclose(s.gram, c.T @ c) and s.yty == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-6) and s.n == 80


def test_forms_of_data_agree(spark, data):
    df, x, y = data
    names = ["signal", "nuisance", "noise1", "noise2"]
    kw = {"residual_shape": 3.0, "residual_scale": 1.0, **RUN}
    a = draws(fit(df, "y", BLOCKS, **kw))
    raw = {"n": 80, "xty": x.T @ y, "yty": float(y @ y), "x_means": x.mean(axis=0), "y_mean": float(y.mean()), "names": names}
    b = draws(fit_ss(spark, xtx=x.T @ x, blocks=as_indices(BLOCKS), **raw, **kw))
    c = x - x.mean(axis=0)
    u, lam = E.decompose(c.T @ c)
    d = draws(fit_eigen(spark, vectors=u, values=lam, prop_var=1.0, blocks=as_indices(BLOCKS), **raw, **kw))
    i, j = np.triu_indices(4)
    t = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), (x.T @ x)[i, j].tolist(), strict=True)), "i int, j int, v double")
    p = spark.createDataFrame([(k, names[k], float(x[:, k] @ y), float(x[:, k].mean())) for k in range(4)], "idx int, name string, xty double, x_mean double")
    e = draws(fit_sparse(spark, 80, t, p, as_indices(BLOCKS), yty=float(y @ y), y_mean=float(y.mean()), **kw))
    for other in (b, d, e):
        assert np.allclose(a, other, atol=1e-7)


def test_blocks_equal_dense_and_split(spark):
    gs = [np.array([[12.0, 2], [2, 10]]), np.array([[9.0, -1], [-1, 8]])]
    full = np.zeros((4, 4))
    full[:2, :2], full[2:, 2:] = gs
    g = np.array([1, 2, -1, 0.5])
    spec = {"x": {"model": "Normal", "var": 1.0, "indices": [0, 2], "standardize": False}, "y": {"model": "Normal", "var": 0.5, "indices": [1, 3], "standardize": False}}
    kw = {"residual_var": 1.0, "pve": True, "chains": 2, "iterations": 1500, "burnin": 100, "seed": 2}
    a, b = fit_ss(spark, 20, full, g, spec, yty=20.0, **kw), fit_ss(spark, 20, gs, g, spec, yty=20.0, **kw)
    assert (len(a.problems), len(b.problems)) == (1, 2)
    da, db = a.draws.collect(), b.draws.collect()
    assert len(db) == 2800 and {len(r["theta"]) for r in db} == {4}
    means = [np.mean([r["theta"] for r in d], axis=0) for d in (da, db)]
    order = [a.names.index(n) for n in b.names]
    assert b.names == ["x1", "x2", "x3", "x4"] and b.labels == ["x::x1", "y::x2", "x::x3", "y::x4"]
    for r in db[:20]:
        t = np.array(r["theta"])
        total = t @ full @ t / 20
        assert r["pve_total"] == pytest.approx(total / (total + 1), rel=1e-9)
        assert sum(r["pve_allocated"]) == pytest.approx(r["pve_total"], rel=1e-9)
    assert np.allclose(means[0][order], means[1], atol=0.03)
    # means couple the blocks
    c = fit_ss(spark, 20, gs, g, spec, yty=20.0, x_means=[0.1, -0.1, 0.05, -0.05], y_mean=0.02, **kw)
    assert len(c.problems) == 1


def test_chains_and_moments_only(spark, data):
    df, *_ = data
    kw = {"residual_shape": 3.0, "residual_scale": 1.0, "chains": 3, **RUN}
    f = fit(df, "y", BLOCKS, **kw)
    assert [(r["chain"], r["count"]) for r in f.draws.groupBy("chain").count().orderBy("chain").collect()] == [(1, 100), (2, 100), (3, 100)]
    m = fit(df, "y", BLOCKS, store="moments", coefficient_cov=True, **kw)
    want = {r["idx"]: r for r in P.coefficients(f.draws).collect()}
    for r in P.merge_moments(m.moments, ["param", "idx"]).where("param = 'theta'").collect():
        assert r["n"] == 300 and r["mean"] == pytest.approx(want[r["idx"]]["mean"], rel=1e-10)
        assert r["m2"] / 299 == pytest.approx(want[r["idx"]]["var"], rel=1e-9)
    blocks = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "idx int, block int")
    full = {(r["i"], r["j"]): r["cov"] for r in P.covariances(P.long_theta(f.draws), blocks).collect()}
    for r in P.merge_covariances(m.covariances).collect():
        assert r["cov"] == pytest.approx(full[r["i"], r["j"]], rel=1e-8, abs=1e-12)
    with pytest.raises(SpecError):
        _ = m.draws


def test_merge_of_known_moments(spark):
    df = spark.createDataFrame([("a", 2, 1.0, 0.5), ("a", 2, 3.0, 0.5), ("b", 100000, 1.0, 3.0), ("b", 100000, 3.0, 3.0)], "p string, n long, mean double, m2 double")
    got = {r["p"]: (r["n"], r["mean"], r["m2"]) for r in P.merge_moments(df, ["p"]).collect()}
    assert got["a"] == (4, 2.0, 5.0) and got["b"] == (200000, 2.0, 200006.0)


def test_summaries_and_prediction(spark, data):
    df, x, _ = data
    f = fit(df, "y", BLOCKS, residual_shape=3.0, residual_scale=1.0, pve=True, **RUN)
    d = f.draws.orderBy("chain", "draw").collect()
    theta, mu, sd = np.array([r["theta"] for r in d]), np.array([r["intercept"] for r in d]), np.sqrt([r["residual_var"] for r in d])
    s = {r["idx"]: r for r in P.summarize(P.long_theta(f.draws, [0, 3]), ["idx"]).collect()}
    assert set(s) == {0, 3} and s[3]["q97.5"] == pytest.approx(np.quantile(theta[:, 3], 0.975))
    assert f.labels == ["a::signal", "a::nuisance", "b::noise1", "b::noise2"]
    inc = {r["idx"]: r["inclusion"] for r in P.inclusion(f.draws).collect()}
    assert inc[2] == pytest.approx(np.mean([r["inclusion"][2] for r in d]))
    pve = {(r["draw"], r["param"]): r["value"] for r in P.pve_long(f.draws, ["a", "b"]).collect()}
    assert pve[0, "Total"] == pytest.approx(pve[0, "a"] + pve[0, "b"] + pve[0, "Cross-block"])
    new = df.select("noise2", "noise1", "nuisance", "signal", F.lit("kept").alias("k"))
    names = ["signal", "nuisance", "noise1", "noise2"]
    eta = None
    for kind in ("none", "credible", "prediction"):
        out = R.predict(new, f.draws, names, kind, 0.9).collect()
        eta = np.array([[r[n] for n in names] for r in out]) @ theta.T + mu
        assert np.allclose([r["fit"] for r in out], eta.mean(axis=1)) and out[0]["k"] == "kept"
        if kind == "credible":
            assert np.allclose([[r["lower"], r["upper"]] for r in out], np.quantile(eta, [0.05, 0.95], axis=1).T)
        elif kind == "prediction":
            from bayesmill.functions.normal import normal_cdf

            up = np.array([r["upper"] for r in out])
            assert np.allclose(normal_cdf((up[:, None] - eta) / sd).mean(axis=1), 0.95, atol=1e-6)
    for bad in ({"interval": "x"}, {"level": 1.0}):
        with pytest.raises(SpecError):
            R.predict(new, f.draws, names, **bad)
    with pytest.raises(DataError):
        R.predict(new.drop("signal"), f.draws, names)


def test_draws_beyond_the_limit_are_read_from_the_shared_folder(spark, data, monkeypatch):
    df, _, _ = data
    draws = fit(df, "y", BLOCKS, residual_shape=3.0, residual_scale=1.0, **RUN).draws
    new, names = df.select("signal", "nuisance", "noise1", "noise2"), ["signal", "nuisance", "noise1", "noise2"]
    for kind in ("credible", "prediction"):
        monkeypatch.undo()
        small = R.predict(new, draws, names, kind).orderBy(*names).collect()
        monkeypatch.setattr(R, "DRAW_LIMIT", 0)
        monkeypatch.setattr(R, "RUN", 4000)  # a few draws and rows at a time
        assert np.allclose(small, R.predict(new, draws, names, kind).orderBy(*names).collect())


def test_diagnostics(spark):
    rng = np.random.default_rng(1)
    rho, n = 0.7, 4000
    rows = []
    for c in range(3):
        x, e = 0.0, rng.normal(size=n)
        for i in range(n):
            x = rho * x + e[i]
            rows.append(("ar", c, i, float(x)))
    long = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    got = D.assess(long).first()
    assert got["ess"] == pytest.approx(3 * n * (1 - rho) / (1 + rho), rel=0.15)
    assert got["rhat"] == pytest.approx(1, abs=0.02) and all(abs(z) < 4 for z in got["geweke"].values())
    x = np.array([r[3] for r in rows]).reshape(3, n)
    w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    assert got["rhat"] == pytest.approx(math.sqrt(((n - 1) / n * w + b) / w), rel=1e-9)
    assert D.rhat(long.where("chain = 0")).first()["rhat"] is None
    with pytest.raises(SpecError):
        D.check_chains(long.where("draw < 10"))
    with pytest.raises(SpecError):
        D.check_chains(long.where("not (chain = 1 and draw = 3)"))
    with pytest.raises(SpecError):
        D.check_chains(long.limit(0))
    assert D.trace(long).first()["title"] == "Trace of ar"


def test_input_errors(spark, data):
    df, x, y = data
    base = {"residual_var": 1.0, **RUN}
    one = {"model": "Normal", "columns": ["signal"]}
    for bad in (df.withColumn("signal", F.lit(1.0)), df.withColumn("signal", F.when(F.col("signal") > 0, F.col("signal"))), df.withColumn("signal", F.lit(float("nan"))), df.withColumn("signal", F.lit("a")), df.limit(1), df.drop("signal")):
        with pytest.raises(DataError):
            fit(bad, "y", one, **base)
    with pytest.raises(DataError):
        fit(df.withColumn("twin", F.col("signal") * 2), "y", {"model": "Fixed", "columns": ["signal", "twin"]}, **base)
    with pytest.raises(SpecError):
        fit(df, "y", one, residual_var=1.0, other=3, **RUN)
    g = x.T @ x
    ok = {"n": 80, "xtx": g, "xty": x.T @ y, "blocks": {"model": "Normal"}, "residual_var": 1.0}
    lopsided = g.copy()
    lopsided[0, 1] += 1
    for bad in ({"n": 1}, {"xtx": g[:3]}, {"xtx": lopsided}, {"xty": np.ones(3)}, {"yty": -1.0}, {"x_means": x.mean(axis=0)}, {"names": ["a", "a", "b", "c"]}, {"xtx": g * np.nan}):
        with pytest.raises(DataError), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            fit_ss(spark, **{**ok, **bad})
    for bad in ({"blocks": {"model": "Normal", "indices": [0, 1]}}, {"blocks": {"model": "Normal", "indices": [0, 1, 2, 3, 3]}}, {"blocks": {"model": "Normal", "indices": ["q"]}}, {"likelihood": 81}):
        with pytest.raises(SpecError), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            fit_ss(spark, **{**ok, **bad})
    with pytest.raises(DataError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit_ss(spark, **{**{k: v for k, v in ok.items() if k != "residual_var"}, "residual_shape": 2.0, "residual_scale": 1.0})
    assert check_observations(df, "y", ["signal"]) == 80
    assert profile(df.limit(0), ["y"]).first()["n"] == 0


def test_sufficient_statistics_guards():
    good = G.check_sufficient(10, np.diag([1e12]), [1e12], 1e12 - 1)
    assert good.names == ["x1"]
    with pytest.raises(DataError):
        G.check_psd(np.diag([1e12]), np.array([1e12]), 1e12 - 1e8)
    with pytest.raises(DataError):
        G.check_psd(np.array([[1.0, 2], [2, 1]]), np.ones(2), None)
    with pytest.raises(DataError):
        G.check_sufficient(10, np.eye(2) * 10, [1, 1], 3.0, [1.0, 0.0], 0.0)


def test_eigen_checks():
    u, lam = E.decompose(np.diag([8.0, 18, 32]))
    assert lam.tolist() == [32, 18, 8]
    with pytest.warns(UserWarning):
        E.decompose(np.array([[1.0, 2], [2, 1]]))
    for bad in ((u, lam[:2], 1.0), (u, -lam, 1.0), (u, lam, 0.0), (u, lam, 1.5), (u[:2], lam, 1.0)):
        with pytest.raises(DataError):
            E.check_sets(*bad)
    with pytest.raises(DataError):
        E.check_sets(u * 2, lam, 1.0, orthonormal=True)
    with pytest.raises(DataError):
        E.project(u[:, :2], lam[:2], np.array([1.0, 1, 1]), 1.0)
    assert E.overall_share([(1.0, 0.5), (3.0, 1.0)]) == pytest.approx(4 / 5)


def test_fit_methods(spark, data, tmp_path):
    df, *_ = data
    f = fit(df, "y", BLOCKS, residual_shape=3.0, residual_scale=1.0, pve=True, chains=2, verbose=True, **RUN)
    c = f.coef().orderBy("position").collect()
    assert [r["label"] for r in c] == ["(Intercept)", "a::signal", "a::nuisance", "b::noise1", "b::noise2"]
    s = f.summary(probs=(0.1, 0.9))
    assert set(s) == {"scalars", "blocks", "pve", "hyper", "coefficients"} and s["coefficients"].count() == 4
    assert {r["block"]: (r["model"], r["predictors"]) for r in s["blocks"].collect()} == {"a": ("Normal", 2), "b": ("SpikeSlab", 2)}
    assert {r["param"] for r in s["pve"].collect()} == {"a", "b", "Total", "Cross-block"}
    top = f.summary(coefficients="top", max_coefficients=1, rank_by="inclusion_probability")["coefficients"].collect()
    assert len(top) == 1 and top[0]["label"].startswith("b::")
    assert "coefficients" not in f.summary(coefficients="none")
    d = f.assess_convergence().collect()
    assert [r["param"] for r in d] == ["intercept", "residual_var", "a::pve", "a::var", "b::pve", "b::var", "b::pi", "pve_total", "pve_cross_block"]
    assert f.predict(df).count() == 80
    f.write(f"{tmp_path}/fit")
    assert spark.read.parquet(f"{tmp_path}/fit/draws").count() == 200
    plain = fit(df, "y", {"model": "Normal", "var": 1.0, "columns": ["signal"]}, residual_var=1.0, **RUN)
    for bad in ({"coefficients": "x"}, {"rank_by": "inclusion_probability"}, {"probs": (2.0,)}, {"max_coefficients": 0}):
        with pytest.raises(SpecError):
            plain.summary(**bad)
    assert [r["param"] for r in plain.assess_convergence().collect()] == ["intercept"]


def test_named_eigen_blocks():
    a, b = np.eye(2), np.eye(3)
    got = E.check_sets({"x": a, "y": b}, {"y": np.ones(3), "x": np.full(2, 2.0)}, {"y": 0.5, "x": 1.0})
    assert [(len(u), lam[0], s) for u, lam, s in got] == [(2, 2.0, 1.0), (3, 1.0, 0.5)]
    with pytest.raises(DataError):
        E.check_sets({"x": a}, {"z": np.ones(2)}, 1.0)


def test_stream_statistics(spark, data, tmp_path):
    from bayesmill.streaming.gram import collector, statistics

    df, x, y = data
    names = ["signal", "nuisance", "noise1", "noise2"]
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(collector(f"{tmp_path}/stats", "y", names)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    s = statistics(spark, f"{tmp_path}/stats", names)
    c = x - x.mean(axis=0)
    assert s.n == 80 and np.allclose(s.gram, c.T @ c) and np.allclose(s.xty, c.T @ (y - y.mean()))


def test_engine_info():
    from bayesmill.operators.summary import engine_info

    assert set(engine_info()) == {"pyspark", "numpy", "blas"}


def test_moments_say_what_draws_say(spark, data):
    """All quantities of a fit that keeps moments against the draws of the same chains, for rows, cross-products in parts, and new data."""
    df, x, y = data
    blocks = {"a": {"model": "Normal", "columns": ["signal"]}, "b": {"model": "SpikeMultiSlab", "columns": ["noise1", "noise2"]}, "c": {"model": "GlobalLocal", "columns": ["nuisance"]}}
    kw = {"residual_shape": 3.0, "residual_scale": 1.0, "pve": True, "chains": 2, **RUN}
    f, m = fit(df, "y", blocks, **kw), fit(df, "y", blocks, store="moments", **kw)
    close = lambda a, b: [(r[0], *(pytest.approx(v, rel=1e-9, abs=1e-9) for v in r[1:])) for r in a] == b
    rows = lambda t, *c: sorted(tuple(r) for r in t.select(*c).collect())
    assert close(rows(f.coef(), "label", "mean"), rows(m.coef(), "label", "mean"))
    a, b = f.summary(), m.summary()
    for name in ("scalars", "pve", "hyper"):
        assert close(rows(a[name], "param", "mean", "sd"), rows(b[name], "param", "mean", "sd")), name
    assert close(rows(a["coefficients"], "label", "mean", "sd"), rows(b["coefficients"], "label", "mean", "sd"))
    assert close(rows(a["blocks"], "block", "predictors", "pve_mean"), rows(b["blocks"], "block", "predictors", "pve_mean"))
    inc = {r["label"]: (r["inclusion"], r["components"], r["local_var_mean"]) for r in b["coefficients"].collect()}
    assert inc["b::noise1"][1]["component_0"] == pytest.approx(1 - inc["b::noise1"][0]) and sum(inc["b::noise1"][1].values()) == pytest.approx(1)
    local = np.mean([r["local_var"][3] for r in f.draws.collect()])
    assert inc["c::nuisance"][2] == pytest.approx(local) and inc["a::signal"] == (None, None, None)
    assert close(rows(f.predict(df), "signal", "fit"), rows(m.predict(df), "signal", "fit"))
    with pytest.raises(SpecError):
        m.predict(df, "credible")
    with pytest.raises(SpecError):
        f.moments
    top = m.summary(coefficients="top", max_coefficients=1, rank_by="inclusion_probability")["coefficients"].collect()
    assert len(top) == 1 and top[0]["inclusion"] is not None


def test_moments_of_parts_are_those_of_the_whole(spark):
    g = [np.array([[12.0, 2], [2, 10]]), np.array([[9.0, -1], [-1, 8]])]
    blocks = {"a": {"model": "Normal", "var": 1.0, "indices": [0, 2]}, "b": {"model": "Normal", "var": 0.5, "indices": [1, 3]}}
    kw = {"yty": 20.0, "x_means": np.zeros(4), "y_mean": 0.02, "residual_var": 1.0, "pve": True, "chains": 2, **RUN}
    f, m = fit_ss(spark, 20, g, [1, 2, -1, 0.5], blocks, **kw), fit_ss(spark, 20, g, [1, 2, -1, 0.5], blocks, store="moments", **kw)
    assert len(m.problems) == 2
    for name in ("scalars", "pve", "hyper"):
        a, b = ({r["param"]: (r["mean"], r["sd"]) for r in x.summary()[name].collect()} for x in (f, m))
        assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)


def test_fixed_predictors_of_sparse_and_eigen_fits_are_checked(spark):
    x = np.random.default_rng(0).normal(size=(30, 3))
    x[:, 2] = x[:, 0]
    g = x.T @ x
    t = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(3) for j in range(i, 3)], "i int, j int, v double")
    p = spark.createDataFrame([(i, f"x{i + 1}", 1.0) for i in range(3)], "idx int, name string, xty double")
    for model, ok in (("Fixed", False), ("Normal", True)):
        block = {"model": model, "standardize": False}
        if ok:
            assert fit_sparse(spark, 30, t, p, block, residual_var=1.0, **RUN).problems
        else:
            with pytest.raises(DataError):
                fit_sparse(spark, 30, t, p, block, residual_var=1.0, **RUN)
    u, lam = E.decompose(g)
    u, lam = u[:, lam > 1e-8], lam[lam > 1e-8]
    with pytest.raises(DataError):
        fit_eigen(spark, 30, u, lam, 1.0, u @ np.ones(len(lam)), {"model": "Fixed", "standardize": False}, residual_var=1.0, **RUN)


def test_storage_is_kept(spark):
    g = [np.diag([9.0] * 30) + np.diag([1.0] * 29, 1) + np.diag([1.0] * 29, -1), np.eye(2) * 5 + 1]
    kw = {"residual_var": 1.0, **RUN}
    xty = np.sin(np.arange(32.0))
    a = fit_ss(spark, 50, g, xty, {"model": "Normal", "var": 1.0, "standardize": False}, storage="speed", **kw)
    b = fit_ss(spark, 50, g, xty, {"model": "Normal", "var": 1.0, "standardize": False}, storage="memory", **kw)
    assert a.info["storage"] == ["sparse", "dense"] and b.info["storage"] == ["lower", "dense"]
    assert np.allclose(draws(a), draws(b), atol=1e-9)
