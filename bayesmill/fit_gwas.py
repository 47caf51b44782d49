"""Fits of marginal effects with an LD object, whose blocks stay in Spark."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import Fit, _controls, _prepare, _residual_args, _working
from .operators import gram as G
from .operators import gwas as W
from .operators import ld as L
from .plans import planner, tasks
from .plans.backends import Correlation
from .plans.kernel import Problem
from .plans.spec import SpecError, number, parse_blocks, whole
from .sources.quality import DataError, check_gwas


def fit_gwas(gwas: DataFrame, ld: L.LD, blocks: Mapping | Sequence, scale: str = "auto", residual_df_gwas: int | None = None, ld_shrink: float = 0.0, psd: bool = False, noise=None, **kw) -> Fit:
    """Harmonise, restrict the LD object to what matched, and fit.

    Effects are oriented to the LD object's first allele for the fit, and
    coefficients are turned back to the effects' own.
    """
    controls = _controls(kw)
    residual, ref = _residual_args(kw)
    number(ld_shrink, "ld_shrink", least=0)
    number(1 - ld_shrink, "ld_shrink", least=0)
    if scale not in ("auto", *W.SCALES):
        raise SpecError("scale must be auto, standardized or original")
    if residual_df_gwas is not None:
        whole(residual_df_gwas, "residual_df_gwas", 1)
    g = check_gwas(gwas)
    rows = W.harmonize(g, ld.variants).persist()
    counts = {r["status"]: r["n"] for r in W.status_counts(rows).collect()}
    kept = W.retained(rows)
    n = W.common_n(kept)
    lost = {k: v for k, v in counts.items() if k not in W.KEPT}
    if lost:
        warnings.warn(f"left out: {', '.join(f'{v} {k}' for k, v in sorted(lost.items()))}", stacklevel=2)
    fitted = ld if not lost or set(lost) == {"gwas_only"} else L.subset(ld, kept.select("ID"))
    scale = ("original" if ref is not None else "standardized") if scale == "auto" else scale
    at = kept.select("ID", "beta", F.col("g_SE").alias("se"), "orientation").join(fitted.variants.select("ID", "block", "block_rank", "place"), "ID")
    at = W.working(at, n, scale=scale, residual_df=residual_df_gwas, response_var=ref).orderBy("block_rank", "place").toPandas()
    ids = at["ID"].tolist()
    parsed = parse_blocks(_without_lost(parse_blocks(blocks, "indices"), blocks, ids, bool(lost), kept), "indices")
    place = {x: i for i, x in enumerate(ids)}
    block_of = np.full(len(ids), -1)
    for b, blk in enumerate(parsed):
        for x in blk.predictors or ids:
            i = place.get(x) if isinstance(x, str) else int(x)
            if i is None or not 0 <= i < len(ids) or block_of[i] >= 0:
                raise SpecError("the blocks' indices must hold each predictor once")
            block_of[i] = b
    if (block_of < 0).any():
        raise SpecError("the blocks' indices must hold each predictor once")
    diag, xty, yty = at["diag"].to_numpy(), at["xty"].to_numpy(), float(at["yty"].iloc[0])
    sd = _working(diag, n, np.array([parsed[b].standardize for b in block_of]))
    ready, prior = _prepare(parsed, block_of, diag / sd**2, n, n - 1, yty / (n - 1), residual, ref)
    df = n - 1
    part = planner.components(block_of.tolist(), at["block"].tolist(), ready, prior.var is None)
    fixed = [i for i in range(len(ids)) if not ready[block_of[i]].penalized]
    if fixed or psd:
        _check_rank(fitted, at, ready, block_of, diag, xty, yty, sd, ld_shrink, fixed, psd)
    s, sign = np.sqrt(diag) / sd, at["orientation"].to_numpy()
    shape = pd.DataFrame({"block": at["block"], "part": part}).drop_duplicates()
    table = fitted.spark.createDataFrame(shape.assign(part=shape["part"].astype("int32")), "block string, part int")
    shipped = fitted.spark.sparkContext.broadcast({"block": at["block"].to_numpy(), "part": part, "s": s, "g": xty / sd, "y2": yty, "scale": sd * sign, "block_of": block_of, "blocks": ready, "prior": prior, "df": df, "shrink": ld_shrink, "controls": controls})
    chains = fitted.spark.range(1, controls.chains + 1).select(F.col("id").cast("int").alias("chain"))
    ranked = fitted.blocks.join(table, F.col("name") == F.col("block")).join(fitted.variants.groupBy("block").agg(F.min("block_rank").alias("rank")), "block")

    running = controls.store == "moments"

    def sample(batches):
        d, rows = shipped.value, []
        for b in batches:
            for r in b.to_pylist():
                cols = L.columns(r)
                rows.append((r["rank"], r["chain"], r["part"], int(r["size"]), cols))
        rows.sort(key=lambda r: r[0])
        number_, c = rows[0][1:3]
        idx = np.flatnonzero(d["part"] == c)
        own = sorted(set(d["block_of"][idx].tolist()))
        be = Correlation([r[3:] for r in rows], d["s"][idx], d["g"][idx], d["y2"], d["shrink"])
        problem = Problem(be, [d["blocks"][b] for b in own], np.array([own.index(b) for b in d["block_of"][idx].tolist()]), d["prior"], d["df"], idx, d["scale"][idx], own, len(d["blocks"]), np.zeros(len(idx)), c == 0)
        yield from (tasks.running_rows if running else tasks.draw_rows)(problem, d["controls"], number_, c, noise)

    # few rows: a chain's number beside each block of LD
    made = ranked.join(F.broadcast(chains)).groupBy("chain", "part").applyInArrow(_batches(sample), tasks.RUNNING if running else tasks.DRAWS)
    info = {"parts": int(part.max(initial=0)) + 1, "scale": sd, "orientation": sign, "harmonization": counts, "residual_df_gwas": n - 2 if residual_df_gwas is None else residual_df_gwas, "ld": fitted, "scale_kind": scale}
    return Fit(fitted.spark, ready, ids, block_of.tolist(), prior, controls, n, df, [], None, info, made=made)


def _batches(run):
    """``run`` as a function of a group's batches that yields batches."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    go.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return go


def _without_lost(parsed, blocks, ids: list[str], lost: bool, kept: DataFrame):
    """The model without the ids that harmonisation left out; places cannot be used once any is."""
    have, out, gone = set(ids), {}, 0
    given = {"ETA1": blocks} if isinstance(blocks, Mapping) and "model" in blocks else dict(blocks) if isinstance(blocks, Mapping) else dict(enumerate(blocks))
    for blk, spec in zip(parsed, given.values(), strict=True):
        if not blk.predictors:
            return blocks
        if any(not isinstance(x, str) for x in blk.predictors):
            if lost:
                raise SpecError("variants were left out: blocks must name ids, not places")
            out[blk.name] = spec
            continue
        stay = [x for x in blk.predictors if x in have]
        gone += len(blk.predictors) - len(stay)
        if not stay:
            raise SpecError(f"no variant of block {blk.name} is left")
        out[blk.name] = {**spec, "indices": stay}
    if gone:
        warnings.warn(f"{gone} ids of the model were left out", stacklevel=3)
    return out


def _check_rank(ld: L.LD, at, ready, block_of, diag, xty, yty, sd, shrink, fixed, psd) -> None:
    """Rank of flat-prior predictors and, if asked, of everything: each block in a task of its own."""
    by = {b: (x.index.to_numpy(), (np.sqrt(diag) / sd)[x.index], (xty / sd)[x.index]) for b, x in at.groupby("block", sort=False)}
    flat = set(fixed)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            idx, s, g = by[r["name"]]
            m = L.dense(r) * (1 - shrink) + shrink * np.eye(int(r["size"]))
            gram, why = m * np.outer(s, s), ""
            try:
                if psd:
                    G.check_psd(gram, g, None)
                pick = [k for k, i in enumerate(idx) if i in flat]
                G.check_fixed_rank(gram[np.ix_(pick, pick)])
            except DataError as e:
                why = str(e)
            out.append((r["name"], why))
        return pd.DataFrame(out, columns=["block", "why"])

    bad = ld.blocks.mapInPandas(lambda it: (test(x) for x in it), "block string, why string").where("why <> ''").first()
    if bad:
        raise DataError(f"block {bad['block']}: {bad['why']}")
