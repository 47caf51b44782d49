"""LD objects, harmonisation, conversion, and fits of marginal effects."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.fit import fit_ss
from bayesmill.fit_gwas import fit_gwas
from bayesmill.operators import gwas as W
from bayesmill.operators import ld as L
from bayesmill.operators import posterior as P
from bayesmill.plans.spec import SpecError
from bayesmill.sources.quality import DataError, check_gwas

R1 = np.array([[1, 0.2, 0], [0.2, 1, 0.1], [0, 0.1, 1]])
R2 = np.array([[1, -0.3, 0], [-0.3, 1, 0.15], [0, 0.15, 1]])
ALLELES = [("A", "C"), ("A", "G"), ("C", "T"), ("A", "C"), ("C", "A"), ("A", "G")]
BETA, SE = (0.1, -0.2, 0.05, 0.3, 0.0, -0.1), 0.08
VARIANTS = "CHR string, ID string, POS long, A1 string, A0 string, parent string, pos_in_ld int"


def variants(spark, parents=(("c1", 3), ("c2", 3))):
    rows, k = [], 0
    for name, n in parents:
        for i in range(n):
            a = ALLELES[k % 6]
            rows.append((name[-1], f"rs{k + 1}", 100 + k, *a, name, i))
            k += 1
    return spark.createDataFrame(rows, VARIANTS)


def effects(spark, change=None, n=100):
    rows = []
    for k in range(6):
        row = {"CHR": "1" if k < 3 else "2", "ID": f"rs{k + 1}", "POS": 100 + k, "A1": ALLELES[k][0], "A0": ALLELES[k][1], "N": n, "BETA": BETA[k], "SE": SE}
        rows.append(row | (change or {}).get(k, {}))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "CHR string, ID string, POS long, A1 string, A0 string, N long, BETA double, SE double")


@pytest.fixture(scope="module")
def ld(spark):
    return L.from_matrices(spark, {"c1": R1, "c2": R2}, variants(spark))


def fitted(g, ld, **kw):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return fit_gwas(g, ld, kw.pop("model", {"model": "Normal", "var": 0.02}), **({"residual_var": 1.0, "iterations": 80, "burnin": 20, "seed": 4} | kw))


def means(f):
    return np.array([r["mean"] for r in P.coefficients(f.draws).orderBy("idx").collect()])


def test_build_and_detect(spark, ld):
    blocks = {r["name"]: r for r in ld.blocks.collect()}
    assert sorted(blocks) == ["c1", "c2"] and all(np.allclose(L.dense(blocks[k]), m) for k, m in (("c1", R1), ("c2", R2)))
    hidden = np.zeros((5, 5))
    hidden[:3, :3], hidden[3:, 3:] = R1, R2[:2, :2]
    one = L.from_matrices(spark, {"p": hidden}, variants(spark, [("p", 5)]))
    t = one.block_table().orderBy("start").collect()
    assert [(r["block"], r["predictors"], r["start"], r["end"]) for r in t] == [("p.1", 3, 1, 3), ("p.2", 2, 4, 5)]
    clash = np.eye(4)
    names = L.from_matrices(spark, {"a": np.array([[1, 0], [0, 1.0]]), "a.1": clash[:2, :2]}, variants(spark, [("a", 2), ("a.1", 2)]))
    got = [r["name"] for r in names.blocks.collect()]
    assert len(set(got)) == 4 and "a.1" not in got


def test_compression_round_trip():
    rng = np.random.default_rng(0)
    for p in (1, 2, 7, 20):
        for fill in (0.05, 0.4, 1):
            low = np.tril(rng.uniform(-0.5, 0.5, (p, p)) * (rng.random((p, p)) < fill), -1)
            b = L.compress(low)
            assert np.allclose(L.dense(b), low + low.T + np.eye(p))
            i, j = np.nonzero(low)
            turn = rng.permutation(len(i))
            again = L.compress_cells(p, i[turn], j[turn], low[i, j][turn])
            assert again["type"] == b["type"] and np.array_equal(again["data"], b["data"]) and np.array_equal(again["indptr"], b["indptr"])
            L.check_block({"name": "x", **b})
    for bad in ({"indptr": [0, 1]}, {"data": [2.0]}, {"type": 3}):
        with pytest.raises(DataError):
            L.check_block({"name": "x", "size": 2, "type": 0, "data": [0.5], "indptr": [0, 1, 1], "row_index": None} | bad)


def test_write_and_read(spark, ld, tmp_path):
    L.regularize(ld, "shrink", 0.1).write(f"{tmp_path}/ld")
    back = L.LD.read(spark, f"{tmp_path}/ld")
    b = {r["name"]: L.dense(r) for r in back.blocks.collect()}
    assert np.allclose(b["c1"], 0.9 * R1 + 0.1 * np.eye(3)) and back.report.count() == 2
    assert L.report_map(back).count() == 2
    for some_ld in (back, L.regularize(ld, "shrink", 0.1)):
        part = L.subset(some_ld, some_ld.variants.where("ID not in ('rs2', 'rs6')").select("ID"))
        got = {(r["fitted_block"], r["source_block"], r["fitted_predictors"], r["block"]) for r in L.report_map(part).collect()}
        assert {(b, n) for _, b, n, _ in got} == {("c1", 1), ("c2", 2)} and all(b == s for _, s, _, b in got) and len(got) == 3
        again = L.report_map(L.subset(part, part.variants.where("ID <> 'rs1'").select("ID"))).collect()
        assert sorted(r["source_block"] for r in again) == ["c1", "c2"]
    old = back.report.drop("source_block", "floor_shrink")
    assert L.check_report(old).first()["floor_shrink"] == 0
    with pytest.raises(DataError):
        L.check_report(old.drop("method"))


def test_diagnose_and_repair(spark):
    bad = np.array([[1, 0.9, 0.9], [0.9, 1, -0.9], [0.9, -0.9, 1]])
    near = np.array([[1, 0.999], [0.999, 1]])
    x = L.from_matrices(spark, {"bad": bad, "near": near}, variants(spark, [("bad", 3), ("near", 2)]))
    d = {r["block"]: r for r in L.diagnose(x).collect()}
    assert d["bad"]["status"] == "indefinite" and d["bad"]["minimum_eigenvalue"] == pytest.approx(np.linalg.eigvalsh(bad)[0]) and d["near"]["positive_definite"]
    s = d["bad"]["minimum_shrink"]
    assert np.linalg.eigvalsh((1 - s) * bad + s * np.eye(3))[0] > -1e-7
    assert {r["status"] for r in L.diagnose(x, max_block_size=1).collect()} == {"not_assessed"}
    fixed = L.regularize(x, eigen_floor=1e-3)
    r = {q["block"]: q for q in fixed.report.collect()}
    assert (r["bad"]["method"], r["near"]["method"]) == ("eigen", "eigen") and r["bad"]["minimum_eigenvalue_after"] >= 1e-3 - 1e-9
    assert np.allclose(np.diag(L.dense(next(b for b in fixed.blocks.collect() if b["name"] == "bad"))), 1)
    assert L.regularize(x, eigen_floor=1e-5).report.where("block = 'near'").first()["method"] == "none"
    with pytest.raises(DataError):
        L.regularize(x, "eigen", max_block_size=2)
    for kw in ({"method": "x"}, {"shrink": 1.5}, {"eigen_floor": 0}, {"max_block_size": 0}):
        with pytest.raises(SpecError):
            L.regularize(x, **kw)


def test_ld_input_errors(spark):
    v = variants(spark)
    e = spark.createDataFrame([("c1", 1, 0, 0.2)], "parent string, i int, j int, v double")
    for bad in (e.withColumn("v", F.lit(1.1)), e.withColumn("v", F.lit(float("nan"))), e.withColumn("i", F.lit(0)), e.union(e.select("parent", "j", "i", F.lit(0.5)))):
        with pytest.raises(DataError):
            L.build(v, bad)
    for bad in (v.drop("POS"), v.withColumn("POS", F.lit(0)), v.withColumn("ID", F.lit("x")), v.withColumn("A1", F.col("A0")), v.where("pos_in_ld <> 1")):
        with pytest.raises(DataError):
            L.build(bad, e)


def test_gwas_equals_cross_products(spark, ld):
    g = effects(spark)
    f = fitted(g, ld)
    n, z = 100, np.array(BETA) / SE
    xty = np.sqrt(n - 1) * np.sqrt((n - 1) / (z**2 + n - 2)) * z
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        s = fit_ss(spark, n, [(n - 1) * R1, (n - 1) * R2], xty, {"model": "Normal", "var": 0.02}, yty=n - 1.0, likelihood=n - 1, residual_var=1.0, iterations=80, burnin=20, seed=4)
    assert f.info["parts"] == len(s.problems) == 2
    a, b = (np.array([r["theta"] for r in x.draws.orderBy("draw").collect()]) for x in (f, s))
    assert np.allclose(a, b, atol=1e-10)


def test_orientation_only_turns_signs(spark, ld):
    base = fitted(effects(spark), ld)
    flip = {k: {"A1": ALLELES[k][1].lower(), "A0": ALLELES[k][0], "BETA": -BETA[k]} for k in (0, 3)}
    turned = fitted(effects(spark, flip), ld)
    sign = np.array([-1, 1, 1, -1, 1, 1])
    assert np.allclose(means(base), sign * means(turned), atol=1e-12)
    comp = str.maketrans("ACGT", "TGCA")
    strand = fitted(effects(spark, {k: {"A1": ALLELES[k][0].translate(comp), "A0": ALLELES[k][1].translate(comp)} for k in range(6)}), ld)
    assert np.allclose(means(base), means(strand), atol=1e-12)


def test_exclusions(spark, ld):
    change = {0: {"POS": 5}, 1: {"A1": "A", "A0": "T"}, 2: {"A1": "AC", "A0": "T"}, 3: {"ID": "other"}}
    rows = W.harmonize(check_gwas(effects(spark, change)), ld.variants)
    assert {r["ID"]: r["status"] for r in rows.collect()} == {"rs1": "location_mismatch", "rs2": "ambiguous", "rs3": "allele_mismatch", "rs4": "ld_only", "other": "gwas_only", "rs5": "retained+1", "rs6": "retained+1"}
    assert {r["status"]: r["entries"] for r in W.excluded_entries(rows).collect()} == {"location_mismatch": 2, "ambiguous": 2, "allele_mismatch": 2, "ld_only": 1, "gwas_only": 1}
    with pytest.warns(UserWarning):
        f = fit_gwas(effects(spark, change), ld, {"a": {"model": "Normal", "var": 1.0, "indices": [f"rs{i}" for i in range(1, 7)]}}, residual_var=1.0, iterations=20, burnin=5)
    assert f.names == ["rs5", "rs6"] and len(f.draws.first()["theta"]) == 2
    with pytest.raises(SpecError):
        fitted(effects(spark, change), ld, model={"a": {"model": "Normal", "indices": [0, 1, 2]}})
    with pytest.raises(SpecError):
        fitted(effects(spark, change), ld, model={"a": {"model": "Normal", "indices": ["rs1"]}, "b": {"model": "Normal", "indices": ["rs5", "rs6"]}})
    with pytest.raises(DataError):
        fitted(effects(spark, {k: {"POS": 1} for k in range(6)}), ld)
    with pytest.raises(DataError):
        fitted(effects(spark, {0: {"N": 99}}), ld)


def test_subset_splits_blocks(spark, ld):
    s = L.subset(ld, spark.createDataFrame([("rs1",), ("rs3",), ("rs4",), ("rs5",)], "ID string"))
    assert sorted((r["parent"], r["predictors"]) for r in s.block_table().collect()) == [("c1", 1), ("c1", 1), ("c2", 2)]
    assert s.correlations().select("v").first()["v"] == -0.3


def test_shrink_equals_explicit(spark, ld):
    a = means(fitted(effects(spark), ld, ld_shrink=0.2))
    b = means(fitted(effects(spark), L.regularize(ld, "shrink", 0.2)))
    assert np.allclose(a, b, atol=1e-10)


def test_scales_priors_and_checks(spark, ld):
    f = fitted(effects(spark), ld, model={"a": {"model": "SpikeSlab", "indices": ["rs1", "rs4", "rs5"]}, "b": {"model": "GlobalLocal", "indices": ["rs2", "rs3", "rs6"]}}, residual_var=None, residual_shape=3.0, residual_scale=1.0, pve=True, psd=True, chains=2)
    assert f.info["parts"] == 1 and f.draws.count() == 120
    assert fitted(effects(spark), ld, reference_response_var=2.0).info["scale_kind"] == "original"
    for kw in ({"scale": "x"}, {"ld_shrink": 1.5}, {"scale": "original"}):
        with pytest.raises(SpecError):
            fitted(effects(spark), ld, **kw)


@pytest.mark.parametrize("bad", [{"N": 2}, {"SE": 0.0}, {"BETA": float("nan")}, {"A1": ""}, {"POS": 0}, {"ID": "rs2"}, {"A1": "C"}])
def test_bad_effects(spark, bad):
    with pytest.raises(DataError):
        check_gwas(effects(spark, {0: bad}))


def test_conversion_recovers_cross_products(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    x -= x.mean(axis=0)
    y = x @ [0.5, 0, -1, 0, 0.2] + rng.normal(size=80)
    y -= y.mean()
    d, g = (x**2).sum(axis=0), x.T @ y
    beta = g / d
    se = np.sqrt((y @ y - beta * g) / 78 / d)
    r = (x.T @ x) / np.sqrt(np.outer(d, d))
    rows = spark.createDataFrame([(i, float(beta[i]), float(se[i])) for i in range(5)], "idx int, beta double, se double")
    i, j = np.triu_indices(5)
    cor = spark.createDataFrame([("a", int(a), int(b), float(r[a, b])) for a, b in zip(i, j, strict=True)], "block string, i int, j int, v double")
    t, p = W.convert(rows, cor, 80, scale="original", response_var=float(y @ y / 79))
    got = {(q["i"], q["j"]): q["v"] for q in t.collect()}
    assert all(got[a, b] == pytest.approx((x.T @ x)[a, b], abs=1e-9) for a, b in zip(i, j, strict=True))
    assert np.allclose([q["xty"] for q in p.orderBy("idx").collect()], g, atol=1e-9)


def test_conversion_from_a_list_of_matrices(spark):
    rows = spark.createDataFrame([(i, 0.1 * (i + 1), 0.05) for i in range(6)], "idx int, beta double, se double")
    t, p = W.convert_matrices(rows, [R1, R2], 100)
    assert {r["block"] for r in t.collect()} == {"block1", "block2"} and p.count() == 6
    got = {(r["i"], r["j"]): r["v"] for r in t.collect()}
    assert got[0, 1] == pytest.approx(99 * R1[0, 1]) and got[3, 4] == pytest.approx(99 * R2[0, 1]) and (2, 3) not in got
    named, _ = W.convert_matrices(rows, {"a": R1, "b": R2}, 100)
    assert {r["block"] for r in named.collect()} == {"a", "b"}
    for bad in ([R1], [R1, R2[:2]], [R1, R2 + np.triu(R2)]):
        with pytest.raises(DataError):
            W.convert_matrices(rows, bad, 100)
