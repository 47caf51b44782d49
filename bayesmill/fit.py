"""Fits: from each form of data to posterior draws as a DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gram as G
from .plans import planner, tasks
from .plans.backends import Blocks, Dense, LowRank, Sparse
from .plans.kernel import Problem
from .plans.spec import Block, Controls, Residual, SpecError, calibrate, flag, likelihood_df, parse_blocks, residual_prior
from .sources.quality import DataError, check_array, check_observations


@dataclass
class Fit:
    """A fitted model.  ``predictors``: (name, block, coefficient label) in order; ``draws`` is computed once and kept."""

    spark: SparkSession
    blocks: list[Block]
    names: list[str]
    block_of: list[int]
    residual: Residual
    controls: Controls
    n: int
    df: int
    problems: list[Problem]
    y_mean: float | None
    info: dict[str, Any] = field(default_factory=dict)
    noise: Any = None
    made: DataFrame | None = None  # draws that other code has made

    @property
    def labels(self) -> list[str]:
        return [f"{self.blocks[b].name}::{n}" if len(self.blocks) > 1 else n for n, b in zip(self.names, self.block_of, strict=True)]

    @cached_property
    def draws(self) -> DataFrame:
        """One row for each chain and kept draw; a lost part is drawn again from the same seeds."""
        if self.controls.store != "draws":
            raise SpecError("this fit keeps moments only")
        parts = len(self.problems) if self.made is None else self.info["parts"]
        return tasks.recombine(self._raw(), parts, self.y_mean, self.n, self.df).persist()

    def _raw(self) -> DataFrame:
        return self.made if self.made is not None else tasks.run(self.spark, self.problems, self.controls, self.noise)

    @cached_property
    def _running(self) -> DataFrame:
        """One run of the chains gives moments and covariances."""
        if self.controls.store != "moments":
            raise SpecError("this fit keeps draws")
        return self._raw().persist()

    @cached_property
    def moments(self) -> DataFrame:
        """(chain, param, idx, n, mean, m2), idx -1 but for predictors' own."""
        return tasks.moments(self._running, [b.name for b in self.blocks], self.y_mean, self.n, self.df, self.controls.pve_type if self.controls.pve else None).persist()

    @cached_property
    def covariances(self) -> DataFrame:
        return tasks.covariances(self._running).persist()

    @cached_property
    def predictors(self) -> DataFrame:
        rows = [(i, n, self.blocks[b].name, lab) for i, (n, b, lab) in enumerate(zip(self.names, self.block_of, self.labels, strict=True))]
        return self.spark.createDataFrame(rows, "idx int, name string, block string, label string")

    def coef(self) -> DataFrame:
        return _summary().coef(self)

    def summary(self, **kw) -> dict[str, DataFrame]:
        return _summary().summary(self, **kw)

    def predict(self, newdata: DataFrame, interval: str = "none", level: float = 0.95) -> DataFrame:
        return _summary().predict_fit(self, newdata, interval, level)

    def assess_convergence(self) -> DataFrame:
        return _summary().assess_convergence(self)

    def write(self, path: str) -> None:
        _summary().write(self, path)


def _summary():
    from .operators import summary

    return summary


def _controls(kw: dict) -> Controls:
    return Controls(**{k: kw.pop(k) for k in list(kw) if k in Controls.__dataclass_fields__})


def _residual_args(kw: dict) -> tuple[dict, float | None]:
    out = {k: kw.pop(f"residual_{k}", None) for k in ("var", "shape", "scale")}
    ref = kw.pop("reference_response_var", None)
    if kw:
        raise SpecError(f"unknown arguments {sorted(kw)}")
    return out, ref


def _working(diag: np.ndarray, n: int, standardize: np.ndarray) -> np.ndarray:
    return np.where(standardize, np.sqrt(np.maximum(diag, 0) / (n - 1)), 1.0)


def _prepare(blocks: list[Block], block_of: np.ndarray, diag: np.ndarray, n: int, divisor: int, response_var: float | None, residual: dict, ref: float | None):
    """Calibrated blocks and the residual's prior, from the working diagonal."""
    spread = {b.name: float(diag[block_of == i].sum() / divisor) for i, b in enumerate(blocks)}
    sizes = {b.name: int((block_of == i).sum()) for i, b in enumerate(blocks)}
    var = ref if ref is not None else response_var
    blocks = calibrate(blocks, spread, sizes, var, n)
    return blocks, residual_prior(blocks, **residual, response_var=var)


def _dense_problems(stats_gram, xty, yty, blocks, block_of, scale, x_means, residual, df, gram_block) -> list[Problem]:
    """Dense problems, one for each component."""
    part = planner.components(block_of.tolist(), gram_block, blocks, residual.var is None)
    out = []
    for c in range(int(part.max(initial=-1)) + 1):
        idx = np.flatnonzero(part == c)
        own = sorted(set(block_of[idx].tolist()))
        local = np.array([own.index(b) for b in block_of[idx].tolist()])
        be = Dense(stats_gram[np.ix_(idx, idx)], xty[idx], yty)
        out.append(Problem(be, [blocks[b] for b in own], local, residual, df, idx, scale[idx], own, len(blocks), (x_means / scale)[idx], c == 0))
    return out


def fit(df: DataFrame, y: str, blocks: Mapping | Sequence, noise=None, **kw) -> Fit:
    """Fit rows of observations: ``y`` on the columns that the blocks name."""
    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    parsed = parse_blocks(blocks, "columns")
    names = [c for b in parsed for c in b.predictors]
    block_of = np.array([i for i, b in enumerate(parsed) for _ in b.predictors])
    check_observations(df, y, names)
    s = G.from_observations(df, y, names)
    return _fit_centred(df.sparkSession, s, parsed, block_of, np.arange(len(names)), s.n - 1, s.n - 1, controls, residual, ref, noise)


def fit_array(df: DataFrame, y: str, x: str, blocks: Mapping | Sequence, noise=None, **kw) -> Fit:
    """Fit rows whose predictors are one array column; blocks name them by place from 0, or as x1, x2 ..."""
    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    parsed = parse_blocks(blocks, "indices")
    check_array(df, y, x)
    s = G.from_observations(df, y, x)
    if bad := [s.names[j] for j in np.flatnonzero(np.diag(s.gram) <= 100 * G.EPS * np.maximum(1, s.n * s.x_means**2))]:
        raise DataError(f"predictors {bad} are constant")
    order, block_of = _indices(parsed, s.names)
    return _fit_centred(df.sparkSession, s, parsed, block_of, order, s.n - 1, s.n - 1, controls, residual, ref, noise)


def _fit_centred(spark, s: G.SuffStats, parsed, block_of, order, df, divisor, controls, residual, ref, noise=None, gram_block=None, info=None) -> Fit:
    names = [s.names[j] for j in order]
    gram, xty, means = s.gram[np.ix_(order, order)], s.xty[order], s.x_means[order]
    scale = _working(np.diag(gram), s.n, np.array([parsed[b].standardize for b in block_of]))
    gram, xty = gram / np.outer(scale, scale), xty / scale
    fixed = np.array([not parsed[b].penalized for b in block_of], bool)
    G.check_fixed_rank(gram[np.ix_(fixed, fixed)])
    ready, prior = _prepare(parsed, block_of, np.diag(gram), s.n, divisor, s.response_var(), residual, ref)
    if prior.var is None and s.yty is None:
        raise DataError("yty is needed to learn the residual variance")
    gram_block = gram_block if gram_block is not None else [0] * len(order)
    problems = _dense_problems(gram, xty, s.yty if s.yty is not None else 0.0, ready, block_of, scale, means, prior, df, gram_block)
    return Fit(spark, ready, names, block_of.tolist(), prior, controls, s.n, df, problems, s.y_mean, {"scale": scale, **(info or {})}, noise)


def _indices(parsed: list[Block], names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(order, block of each in that order): the blocks' indices must partition the predictors."""
    place = {n: i for i, n in enumerate(names)}
    order, block_of = [], []
    for b, blk in enumerate(parsed):
        for x in blk.predictors or range(len(names)):
            if isinstance(x, str):
                if x not in place:
                    raise SpecError(f"block {blk.name}: no predictor {x!r}")
                x = place[x]
            elif isinstance(x, bool) or x != int(x) or not 0 <= x < len(names):
                raise SpecError(f"block {blk.name}: indices are numbers from 0 or names")
            order.append(int(x))
            block_of.append(b)
    if sorted(order) != list(range(len(names))):
        raise SpecError("the blocks' indices must hold each predictor once")
    return np.array(order, np.int64), np.array(block_of, np.int64)


def fit_ss(spark: SparkSession, n: int, xtx, xty, blocks: Mapping | Sequence, yty: float | None = None, x_means=None, y_mean: float | None = None, names: Sequence[str] | None = None, likelihood: int | None = None, psd: bool = False, storage: str = "auto", storage_limit: int = 1 << 30, noise=None, **kw) -> Fit:
    """Fit cross-products: one matrix, or a list or mapping of diagonal blocks whose order is the predictors'.

    With means they are centred first; blocks that means couple are one dense
    component.  Others are kept in tasks as ``storage`` says (see
    :func:`~bayesmill.plans.planner.plan_storage`): dense, sparse, or one triangle.
    """
    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    flag(psd, "psd")
    listed = list(xtx.values()) if isinstance(xtx, Mapping) else xtx if isinstance(xtx, list) and len(xtx) and np.ndim(xtx[0]) == 2 else [xtx]
    listed = [G.check_gram(b) for b in listed]
    parsed = parse_blocks(blocks, "indices")
    intercept = x_means is not None
    if not intercept and any(b.standardize for b in parsed):
        warnings.warn("standardizing cross-products without means treats them as centred; there is no intercept", stacklevel=2)
    kept, fits = planner.plan_storage([(len(b), int(np.count_nonzero(b))) for b in listed], storage, storage_limit)
    if not fits:
        warnings.warn("cross-products take more memory than the limit", stacklevel=2)
    how = [k.kind for k in kept]
    if (len(listed) > 1 or how != ["dense"]) and not (intercept and np.any(np.asarray(x_means) != 0)):
        return _fit_blocks(spark, n, listed, how, xty, yty, x_means, y_mean, names, parsed, likelihood, psd, controls, residual, ref, noise)
    sizes = [len(b) for b in listed]
    whole = np.zeros((sum(sizes), sum(sizes)))
    for b, at in zip(listed, np.cumsum([0, *sizes[:-1]]), strict=True):
        whole[at : at + len(b), at : at + len(b)] = b
    s = G.check_sufficient(n, whole, xty, yty, x_means, y_mean, names)
    order, block_of = _indices(parsed, s.names)
    df = likelihood_df(likelihood, s.n, s.intercept)
    if psd:
        G.check_psd(s.gram, s.xty, s.yty)
    return _fit_centred(spark, s, parsed, block_of, order, df, df, controls, residual, ref, noise, info={"intercept": s.intercept})


def _fit_blocks(spark, n, listed, how, xty, yty, x_means, y_mean, names, parsed, likelihood, psd, controls, residual, ref, noise) -> Fit:
    """Diagonal blocks that no means couple: they stay blocks, and predictors keep the blocks' order."""
    at = np.concatenate([[0], np.cumsum([len(b) for b in listed])])
    xty = np.asarray(xty, float).reshape(-1)
    if len(xty) != at[-1]:
        raise DataError("xty must be finite, one for each predictor")
    names = list(names) if names is not None else [f"x{i + 1}" for i in range(len(xty))]
    cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    checked = [G.check_sufficient(n, b, xty[a:z], yty, None if x_means is None else np.zeros(z - a), y_mean, names[a:z]) for b, (a, z) in zip(listed, cut, strict=True)]
    if len(set(names)) != len(names):
        raise DataError("names must be given and differ")
    if psd:
        for s in checked:
            G.check_psd(s.gram, s.xty, None)
    y2, intercept = checked[0].yty, x_means is not None
    df = likelihood_df(likelihood, n, intercept)
    order, of = _indices(parsed, names)
    block_of = np.empty(len(names), np.int64)
    block_of[order] = of
    diag = np.concatenate([np.diag(s.gram) for s in checked])
    scale = _working(diag, n, np.array([parsed[b].standardize for b in block_of]))
    grams = [s.gram / np.outer(scale[a:z], scale[a:z]) for s, (a, z) in zip(checked, cut, strict=True)]
    for g, (a, z) in zip(grams, cut, strict=True):
        flat = [i for i in range(z - a) if not parsed[block_of[a + i]].penalized]
        G.check_fixed_rank(g[np.ix_(flat, flat)])
    ready, prior = _prepare(parsed, block_of, diag / scale**2, n, df, None if y2 is None else y2 / (n - 1), residual, ref)
    if prior.var is None and y2 is None:
        raise DataError("yty is needed to learn the residual variance")
    part = planner.components(block_of.tolist(), np.repeat(np.arange(len(grams)), np.diff(at)).tolist(), ready, prior.var is None)
    problems = []
    for c in range(int(part.max(initial=-1)) + 1):
        idx = np.flatnonzero(part == c)
        own = sorted(set(block_of[idx].tolist()))
        mine = [b for b, a in enumerate(at[:-1]) if part[a] == c]
        be = Blocks([grams[b] for b in mine], (xty / scale)[idx], y2 or 0.0, [how[b] for b in mine])
        problems.append(Problem(be, [ready[b] for b in own], np.array([own.index(b) for b in block_of[idx].tolist()]), prior, df, idx, scale[idx], own, len(ready), np.zeros(len(idx)), c == 0))
    return Fit(spark, ready, names, block_of.tolist(), prior, controls, n, df, problems, y_mean, {"scale": scale, "intercept": intercept, "storage": how}, noise)


def fit_sparse(spark: SparkSession, n: int, triplets: DataFrame, predictors: DataFrame, blocks: Mapping | Sequence, yty: float | None = None, y_mean: float | None = None, likelihood: int | None = None, noise=None, **kw) -> Fit:
    """Fit sparse cross-products given as tables: ``triplets(i, j, v)`` of one triangle, ``predictors(idx, name, xty[, x_mean])``.

    Means are centred out by an implicit rank-one term, so the matrix stays sparse.
    """
    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    rows = predictors.orderBy("idx").collect()
    p = len(rows)
    if [r["idx"] for r in rows] != list(range(p)):
        raise DataError("predictors are numbered from 0 without gaps")
    names, xty = [r["name"] for r in rows], np.array([r["xty"] for r in rows], float)
    means = np.array([r["x_mean"] for r in rows], float) if "x_mean" in predictors.columns else np.zeros(p)
    t = triplets.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("v").cast("double")).toArrow()
    i, j, v = (t.column(k).to_numpy() for k in range(3))
    parsed = parse_blocks(blocks, "indices")
    order, block_of = _indices(parsed, names)
    at = np.empty(p, np.int64)
    at[order] = np.arange(p)
    intercept = y_mean is not None
    df = likelihood_df(likelihood, n, intercept)
    diag = np.zeros(p)
    np.add.at(diag, i[i == j], v[i == j])
    diag = (diag - n * means**2)[order]
    scale = _working(diag, n, np.array([parsed[b].standardize for b in block_of]))
    xty = (xty - n * means * (y_mean or 0.0))[order] / scale
    y2 = None if yty is None else max(yty - n * (y_mean or 0.0) ** 2, 0.0)
    ready, prior = _prepare(parsed, block_of, diag / scale**2, n, df, None if y2 is None else y2 / (n - 1), residual, ref)
    if prior.var is None and y2 is None:
        raise DataError("yty is needed to learn the residual variance")
    r, c = np.concatenate([at[i], at[j[i != j]]]), np.concatenate([at[j], at[i[i != j]]])
    w = np.concatenate([v, v[i != j]]) / (scale[r] * scale[c])
    by = np.argsort(c, kind="stable")
    cut = np.searchsorted(c[by], np.arange(p + 1))
    cols = [(r[by[a:b]], w[by[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    be = Sparse(cols, xty, y2 or 0.0, np.sqrt(n) * means[order] / scale)
    if bad := [names[order[k]] for k in np.flatnonzero(be.diag <= 100 * G.EPS * np.maximum(1.0, n * (means[order] / scale) ** 2))]:
        raise DataError(f"predictors {bad} are constant")
    flat = np.flatnonzero([not ready[b].penalized for b in block_of])
    G.check_fixed_rank(be.part(flat))
    problem = Problem(be, ready, block_of, prior, df, np.arange(p), scale, list(range(len(ready))), len(ready), means[order] / scale)
    return Fit(spark, ready, [names[k] for k in order], block_of.tolist(), prior, controls, n, df, [problem], y_mean, {"intercept": intercept}, noise)


def fit_eigen(spark: SparkSession, n: int, vectors, values, prop_var, xty, blocks: Mapping | Sequence, yty: float | None = None, x_means=None, y_mean: float | None = None, names: Sequence[str] | None = None, likelihood: int | None = None, check: bool = False, noise=None, **kw) -> Fit:
    """Fit eigenpairs of centred cross-products, one set or a list of sets for diagonal blocks."""
    from .operators import eigen as E

    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    sets = E.check_sets(vectors, values, prop_var, check)
    p = sum(u.shape[0] for u, _, _ in sets)
    xty = np.asarray(xty, float).reshape(-1)
    if xty.shape != (p,) or not np.isfinite(xty).all():
        raise DataError("xty must be finite, one for each predictor")
    if (x_means is None) != (y_mean is None):
        raise DataError("x_means and y_mean come together")
    names = list(names) if names is not None else [f"x{i + 1}" for i in range(p)]
    means = np.zeros(p) if x_means is None else np.asarray(x_means, float)
    intercept = x_means is not None
    g = xty - n * means * (y_mean or 0.0)
    y2 = None if yty is None else max(yty - n * (y_mean or 0.0) ** 2, 0.0)
    at = np.concatenate([[0], np.cumsum([u.shape[0] for u, _, _ in sets])])
    projected = [E.project(u, lam, g[a:b], prop) for (u, lam, prop), a, b in zip(sets, at[:-1], at[1:], strict=True)]
    diag = np.concatenate([x.diag for x in projected])
    if bad := [names[k] for k in np.flatnonzero(diag <= 100 * G.EPS * max(1.0, diag.max(initial=0)))]:
        raise DataError(f"predictors {bad} are constant")
    parsed = parse_blocks(blocks, "indices")
    order, block_of = _indices(parsed, names)
    df = likelihood_df(likelihood, n, intercept)
    place = np.empty(p, np.int64)
    place[order] = block_of
    scale = _working(diag, n, np.array([parsed[b].standardize for b in place]))
    ready, prior = _prepare(parsed, place, diag / scale**2, n, df, None if y2 is None else y2 / (n - 1), residual, ref)
    if prior.var is None and y2 is None:
        raise DataError("yty is needed to learn the residual variance")
    explained = sum(float(x.target @ x.target) for x in projected)
    offset = 0.0
    if y2 is not None:
        offset = y2 - explained
        if offset < -G.ROOT_EPS * max(1.0, y2):
            raise DataError("yty is less than the eigenpairs explain")
        offset = max(offset, 0.0)
    factors = [E.factor(u, lam, scale[a:b]) for (u, lam, _), a, b in zip(sets, at[:-1], at[1:], strict=True)]
    for q, a in zip(factors, at[:-1], strict=True):
        flat = q[:, [k for k in range(q.shape[1]) if not ready[place[a + k]].penalized]]
        G.check_fixed_rank(flat.T @ flat)
    part = planner.components(place.tolist(), np.repeat(np.arange(len(sets)), np.diff(at)).tolist(), ready, prior.var is None)
    problems = []
    for c in range(int(part.max(initial=-1)) + 1):
        idx = np.flatnonzero(part == c)
        own = sorted(set(place[idx].tolist()))
        mine = [k for k in range(len(sets)) if part[at[k]] == c]
        be = LowRank([factors[k] for k in mine], [projected[k].target for k in mine], offset)
        problems.append(Problem(be, [ready[b] for b in own], np.array([own.index(b) for b in place[idx].tolist()]), prior, df, idx, scale[idx], own, len(ready), (means / scale)[idx], c == 0))
    info = {"prop_var": E.overall_share([(float((u**2 @ lam).sum()), prop) for u, lam, prop in sets])}
    return Fit(spark, ready, names, place.tolist(), prior, controls, n, df, problems, y_mean, info, noise)


__all__ = ["Fit", "fit", "fit_array", "fit_eigen", "fit_sparse", "fit_ss"]
