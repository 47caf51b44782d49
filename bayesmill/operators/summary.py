"""What a fit says: coefficients, summaries, parameters for diagnostics, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError, whole
from . import diagnostics, posterior, predict

if TYPE_CHECKING:
    from ..fit import Fit

AUTO_LIMIT = 20


def merged(fit: Fit) -> DataFrame:
    """(param, idx, mean, sd) over all chains of a fit that keeps moments."""
    m = posterior.merge_moments(fit.moments, ["param", "idx"])
    return m.select("param", "idx", "mean", F.sqrt(posterior.variance("n", "m2")).alias("sd"))


def _own(m: DataFrame, param: str, name: str | None = None) -> DataFrame:
    """(idx, mean, sd) of one quantity of predictors, or its mean by ``name``."""
    out = m.where(F.col("param") == param)
    return out.select("idx", "mean", "sd") if name is None else out.select("idx", F.col("mean").alias(name))


def coef(fit: Fit) -> DataFrame:
    """(position, label, mean): the intercept first if there is one, then coefficients in order."""
    kept = fit.controls.store == "draws"
    m = None if kept else merged(fit)
    means = posterior.coefficients(fit.draws) if kept else _own(m, "theta")
    each = means.join(fit.predictors, "idx").select((F.col("idx") + 1).alias("position"), "label", "mean")
    if fit.y_mean is None:
        return each
    first = fit.draws.agg(F.avg("intercept").alias("mean")) if kept else m.where("param = 'intercept'").select("mean")
    return first.select(F.lit(0).alias("position"), F.lit("(Intercept)").alias("label"), "mean").unionByName(each)


def _from_moments(fit: Fit, show: str, top: int, rank_by: str) -> dict[str, DataFrame]:
    """The tables of :func:`summary` without quantiles, which moments do not give."""
    m, out = merged(fit).persist(), {}
    inc = _own(m, "inclusion", "inclusion")
    out["scalars"] = m.where("param in ('residual_var', 'intercept')").select(F.when(F.col("param") == "intercept", "(Intercept)").otherwise(F.col("param")).alias("param"), "mean", "sd")
    models = fit.spark.createDataFrame([(b.name, b.model, b.standardize) for b in fit.blocks], "block string, model string, standardized boolean")
    out["blocks"] = models.join(posterior.block_summary(fit.predictors, inc), "block")
    named = {**{f"pve::{b.name}": b.name for b in fit.blocks}, "pve_total": "Total", "pve_cross_block": "Cross-block"}
    if fit.controls.pve:
        pve = m.where(F.col("param").isin(list(named))).replace(named, subset=["param"]).select("param", "mean", "sd")
        out["pve"] = pve
        out["blocks"] = out["blocks"].join(pve.select(F.col("param").alias("block"), F.col("mean").alias("pve_mean"), F.col("sd").alias("pve_sd")), "block", "left")
    out["hyper"] = m.where((F.col("idx") == -1) & ~F.col("param").isin(["residual_var", "intercept", *named])).select("param", "mean", "sd")
    local = _own(m, "local_var").withColumnsRenamed({"mean": "local_var_mean", "sd": "local_var_sd"})
    parts = m.where("param like 'component_%'").groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("param", "mean"))).alias("components"))
    if show in ("all", "top"):
        table = _own(m, "theta").join(inc, "idx", "left")
        table = posterior.top(table, top, rank_by) if show == "top" else table
        out["coefficients"] = table.join(local, "idx", "left").join(parts, "idx", "left").join(fit.predictors, "idx")
    return out


def summary(fit: Fit, probs: Sequence[float] = (0.025, 0.5, 0.975), coefficients: str = "auto", max_coefficients: int = 20, rank_by: str = "absolute_mean") -> dict[str, DataFrame]:
    """Tables: scalars (intercept, residual variance), blocks, hyper-parameters, variance shares, coefficients.

    A fit that keeps moments gives means and standard deviations without quantiles.
    ``coefficients``: none, all, top (the first ``max_coefficients``), or auto: all of at most 20, else none.
    """
    probs = posterior.check_probs(probs)
    if coefficients not in ("auto", "none", "top", "all") or rank_by not in ("absolute_mean", "inclusion_probability"):
        raise SpecError("coefficients must be auto, none, top or all, ranked by absolute_mean or inclusion_probability")
    whole(max_coefficients, "max_coefficients", 1)
    spikes = any(b.model in ("SpikeSlab", "SpikeMultiSlab") for b in fit.blocks)
    if rank_by == "inclusion_probability" and not spikes:
        raise SpecError("no block has inclusion probabilities to rank by")
    show = "all" if coefficients == "auto" and len(fit.names) <= AUTO_LIMIT else coefficients
    if fit.controls.store == "moments":
        return _from_moments(fit, show, max_coefficients, rank_by)
    d, out = fit.draws, {}
    inc = posterior.inclusion(d).withColumn("idx", F.col("idx").cast("int"))
    scalars = [("residual_var", F.col("residual_var"))] + ([("(Intercept)", F.col("intercept"))] if fit.y_mean is not None else [])
    long = d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("param"), c.alias("value")) for n, c in scalars])).alias("r")).select("r.*")
    out["scalars"] = posterior.summarize(long, ["param"], probs)
    models = fit.spark.createDataFrame([(b.name, b.model, b.standardize) for b in fit.blocks], "block string, model string, standardized boolean")
    out["blocks"] = models.join(posterior.block_summary(fit.predictors, inc), "block")
    if fit.controls.pve:
        pve = posterior.pve_long(d, [b.name for b in fit.blocks], fit.controls.pve_type)
        out["pve"] = posterior.summarize(pve, ["param"], probs)
        out["blocks"] = out["blocks"].join(pve.groupBy(F.col("param").alias("block")).agg(F.avg("value").alias("pve_mean"), F.stddev_samp("value").alias("pve_sd")), "block", "left")
    out["hyper"] = posterior.summarize(posterior.hyper_long(d).where("param <> 'residual_var'"), ["param"], probs)
    if show in ("all", "top"):
        table = posterior.coefficients(d).join(inc, "idx", "left")
        ids = None
        if show == "top":
            table = posterior.top(table, max_coefficients, rank_by)
            ids = [r["idx"] for r in table.select("idx").collect()]  # at most max_coefficients
        q = posterior.summarize(posterior.long_theta(d, ids), ["idx"], probs)
        out["coefficients"] = q.join(inc, "idx", "left").join(fit.predictors, "idx")
    return out


def parameters(fit: Fit) -> DataFrame:
    """(position, param, chain, draw, value) of all that is sampled and not a predictor's own.

    In this order: intercept, residual variance, then by block its variance share
    and hyper-parameters, then the whole model's shares.  Fixed ones are left out.
    """
    cols = []
    if fit.y_mean is not None:
        cols.append(("intercept", F.col("intercept")))
    if fit.residual.var is None:
        cols.append(("residual_var", F.col("residual_var")))
    for i, b in enumerate(fit.blocks):
        if fit.controls.pve and len(fit.blocks) > 1:
            cols.append((f"{b.name}::pve", F.col(f"pve_{fit.controls.pve_type}")[i]))
        names = []
        if b.model in ("Normal", "SpikeSlab", "SpikeMultiSlab") and b.var is None:
            names.append("var")
        if b.model == "GlobalLocal" and b.global_var is None:
            names.append("global_var")
        if b.model == "SpikeSlab":
            names.append("pi")
        elif b.model == "SpikeMultiSlab":
            names += [f"pi[{k}]" for k in range(len(b.gamma))]
        cols += [(f"{b.name}::{n}", F.col("hyper")[f"{b.name}::{n}"]) for n in names]
    if fit.controls.pve:
        cols.append(("pve_total", F.col("pve_total")))
        if len(fit.blocks) > 1:
            cols.append(("pve_cross_block", F.col("pve_total") - F.aggregate("pve_standalone", F.lit(0.0), lambda a, x: a + x)))
    if not cols:
        raise SpecError("nothing but coefficients is sampled")
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("param"), c.alias("value")) for k, (n, c) in enumerate(cols)])
    return fit.draws.select("chain", "draw", F.explode(rows).alias("r")).select("r.position", "r.param", "chain", "draw", "r.value")


def assess_convergence(fit: Fit) -> DataFrame:
    """R-hat, effective size and Geweke z of every parameter, in the parameters' order."""
    p = parameters(fit)
    order = p.select("position", "param").distinct()
    return diagnostics.assess(p.drop("position")).join(order, "param").orderBy("position").drop("position")


def predict_fit(fit: Fit, newdata: DataFrame, interval: str = "none", level: float = 0.95) -> DataFrame:
    if fit.controls.store == "moments":
        if interval != "none":
            raise SpecError("intervals need draws; this fit keeps moments only")
        return predict.point(newdata, *means(fit), fit.names)
    return predict.predict(newdata, fit.draws, fit.names, interval, level)


def means(fit: Fit) -> tuple[float, list[float]]:
    """The intercept's and the coefficients' posterior means: a number for each predictor of the model."""
    rows = {r["position"]: r["mean"] for r in coef(fit).select("position", "mean").collect()}
    return rows.get(0, 0.0), [rows[k + 1] for k in range(len(fit.names))]


def write(fit: Fit, path: str) -> None:
    """Draws, or moments and covariances, and predictors as Parquet."""
    if fit.controls.store == "moments":
        fit.moments.write.parquet(f"{path}/moments")
        fit.covariances.write.parquet(f"{path}/covariances")
    else:
        fit.draws.write.parquet(f"{path}/draws")
    fit.predictors.write.parquet(f"{path}/predictors")


def engine_info() -> dict[str, str]:
    """Versions of what the engine computes with."""
    import numpy
    import pyspark

    blas = numpy.show_config(mode="dicts").get("Build Dependencies", {}).get("blas", {})
    return {"pyspark": pyspark.__version__, "numpy": numpy.__version__, "blas": str(blas.get("name", "unknown"))}
