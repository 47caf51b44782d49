"""Accept and reject lists of model specifications and controls; calibration formulas."""

import math

import pytest

from bayesmill.plans import planner
from bayesmill.plans.spec import Controls, SpecError, calibrate, likelihood_df, parse_blocks, residual_prior, unique_names


def one(**kw):
    return parse_blocks({"columns": ["a", "b"], **kw}, "columns")[0]


def test_defaults():
    b = one(model="Normal")
    assert (b.name, b.shape, b.scale, b.var, b.standardize) == ("ETA1", 2.0, 1.0, None, True)
    assert one(model="SpikeSlab").pi == (1.0, 1.0)
    assert one(model="SpikeMultiSlab").gamma == (0.0, 0.01, 0.1, 1.0) and one(model="SpikeMultiSlab").alpha == (1.0,) * 4
    g = one(model="GlobalLocal")
    assert (g.local_shape, g.global_scale) == ((1.0, 0.5), 1.0)


def test_names_and_named_pairs():
    blocks = parse_blocks({"x": {"model": "Fixed", "columns": "a"}, "": {"model": "Fixed", "columns": ["b"]}}, "columns")
    assert [b.name for b in blocks] == ["x", "ETA2"] and blocks[0].predictors == ("a",)
    assert one(model="SpikeSlab", pi={"b": 9, "a": 1}).pi == (1.0, 9.0)
    assert unique_names(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]


BAD = [
    {}, {"model": "Other"}, {"model": "Normal", "foo": 1}, {"model": "Normal", "var": 0}, {"model": "Normal", "var": -1.0}, {"model": "Normal", "var": math.inf}, {"model": "Normal", "var": True},
    {"model": "Normal", "var": 1, "var_shape": 2}, {"model": "Normal", "var": 1, "var_scale": 2}, {"model": "Normal", "var": 1, "expected_pve": 0.2}, {"model": "Normal", "var_scale": 1, "expected_pve": 0.2},
    {"model": "Normal", "var_shape": 1, "expected_pve": 0.2}, {"model": "Normal", "expected_pve": 0}, {"model": "Normal", "expected_pve": 1}, {"model": "Normal", "pi": (1, 1)}, {"model": "Fixed", "var": 1},
    {"model": "SpikeSlab", "pi": (1,)}, {"model": "SpikeSlab", "pi": (1, 0)}, {"model": "SpikeSlab", "pi": {"a": 1, "c": 2}}, {"model": "SpikeSlab", "pi": "ab"},
    {"model": "SpikeMultiSlab", "gamma": (0.1, 1)}, {"model": "SpikeMultiSlab", "gamma": (0, 1, 1)}, {"model": "SpikeMultiSlab", "gamma": (0,)}, {"model": "SpikeMultiSlab", "alpha": (1, 1)}, {"model": "SpikeMultiSlab", "alpha": (1, 1, 1, 0)},
    {"model": "GlobalLocal", "local_shape": (1, -1)}, {"model": "GlobalLocal", "global_var": 1, "global_scale": 1}, {"model": "GlobalLocal", "global_scale": 1, "expected_nonzero": 1}, {"model": "GlobalLocal", "expected_nonzero": 1},
    {"model": "GlobalLocal", "expected_nonzero": 1, "expected_pve": 0.1, "reference_residual_var": 1}, {"model": "GlobalLocal", "expected_pve": 0.1}, {"model": "GlobalLocal", "reference_residual_var": 1}, {"model": "GlobalLocal", "var": 1},
    {"model": "Normal", "standardize": 1}, {"model": "Normal", "indices": [0]},
]


@pytest.mark.parametrize("bad", BAD, ids=str)
def test_rejected(bad):
    with pytest.raises(SpecError):
        one(**bad)


@pytest.mark.parametrize("bad", [[], {}, 3, "Normal", [1], {"a": {"model": "Normal"}}, {"a": {"model": "Normal", "columns": []}}])
def test_rejected_models(bad):
    with pytest.raises(SpecError):
        parse_blocks(bad, "columns")


def test_controls():
    assert list(Controls(iterations=10, burnin=3, thin=3).kept()) == [4, 7, 10]
    for bad in ({"iterations": 10, "burnin": 9}, {"iterations": 0}, {"burnin": -1}, {"thin": 0}, {"chains": 0}, {"iterations": 2**31}, {"store": "x"}, {"pve": 1}, {"pve_type": "x"}, {"seed": 1.5}, {"thin": True}, {"iterations": math.nan}):
        with pytest.raises(SpecError):
            Controls(**bad)
    assert likelihood_df(None, 10, True) == 9 and likelihood_df(None, 10, False) == 10 and likelihood_df(5, 10, True) == 5
    with pytest.raises(SpecError):
        likelihood_df(11, 10, True)


def test_calibration():
    spread, sizes, v = {"b": 5.0}, {"b": 6}, 8.0
    cal = lambda **kw: calibrate([one(**kw)].__class__([_named(one(**kw))]), spread, sizes, v, 40)[0]
    assert cal(model="Normal", var_shape=3, expected_pve=0.25).scale == pytest.approx(2 * 0.25 * 8 / 5, rel=1e-14)
    assert cal(model="SpikeSlab", var_shape=3, expected_pve=0.25, pi=(1, 4)).scale == pytest.approx(2 * 2 / (0.2 * 5), rel=1e-14)
    assert cal(model="SpikeMultiSlab", var_shape=3, expected_pve=0.25, alpha=(1, 1, 1, 2)).scale == pytest.approx(2 * 2 / (5 * (0.01 + 0.1 + 2) / 5), rel=1e-14)
    assert cal(model="GlobalLocal", expected_nonzero=2, expected_pve=0.25).global_scale == pytest.approx(2 / 4 * math.sqrt(6 / 40), rel=1e-14)
    assert cal(model="GlobalLocal", expected_nonzero=2, reference_residual_var=3).global_scale == pytest.approx(0.5 * math.sqrt(3 / 40), rel=1e-14)
    with pytest.raises(SpecError):
        cal(model="GlobalLocal", expected_nonzero=6, reference_residual_var=3)
    with pytest.raises(SpecError):
        calibrate([_named(one(model="Normal", expected_pve=0.6), "a"), _named(one(model="Normal", expected_pve=0.5), "c")], {"a": 1, "c": 1}, {"a": 1, "c": 1}, v, 40)
    with pytest.raises(SpecError):
        calibrate([_named(one(model="Normal", expected_pve=0.6))], spread, sizes, None, 40)


def _named(b, name="b"):
    from dataclasses import replace

    return replace(b, name=name)


def test_residual_prior():
    b = [one(model="Normal", expected_pve=0.3)]
    assert residual_prior(b, var=2).var == 2
    assert residual_prior(b, shape=3, response_var=10.0).scale == pytest.approx(2 * 0.7 * 10)
    for kw in ({}, {"var": 1, "shape": 2}, {"var": 0}, {"shape": 1, "response_var": 1.0}, {"scale": 1}):
        with pytest.raises(SpecError):
            residual_prior(b, **kw)
    with pytest.raises(SpecError):
        residual_prior([one(model="Normal")], shape=3)


def test_components():
    free, tied = one(model="Normal", var=1.0), one(model="Normal")
    assert planner.components([0, 0, 1], ["g", "h", "h"], [free, free], False).tolist() == [0, 1, 1]
    assert planner.components([0, 0, 1], ["g", "h", "k"], [tied, free], False).tolist() == [0, 0, 1]
    assert planner.components([0, 0, 1], ["g", "h", "k"], [free, free], True).tolist() == [0, 0, 0]
    assert planner.components([0, 0, 1], ["g", "h", "k"], [free, free], False, splittable=False).tolist() == [0, 0, 0]


def test_storage_plan():
    s, fits = planner.plan_storage([(100, 10_000), (100, 300)], "speed")
    assert [x.kind for x in s] == ["dense", "sparse"] and fits
    s, fits = planner.plan_storage([(100, 10_000), (100, 5000)], "auto", limit=100_000)
    assert "lower" in [x.kind for x in s]
    assert not planner.plan_storage([(100, 10_000)], "auto", limit=10)[1]
    assert planner.compression(5, 4, 4) == (0, 56) and planner.compression(5, 10, 2) == (1, 48)
