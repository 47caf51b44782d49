"""Posterior draws to summaries, in Catalyst.

Every function takes draws as a DataFrame (see ``bayesmill.plans.tasks``) or
parts of it, so draws may also come from a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import SpecError, number


def quantile_names(probs: Sequence[float]) -> list[str]:
    return [f"q{100 * p:g}" for p in probs]


def check_probs(probs: Sequence[float]) -> list[float]:
    out = [number(p, "a probability", least=0) for p in probs]
    if not out or any(p > 1 for p in out) or len(set(out)) != len(out):
        raise SpecError("probabilities lie between 0 and 1 and differ")
    return out


def long_theta(draws: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    """(chain, draw, idx, value), of the coefficients asked for; others leave before anything is aggregated."""
    out = draws.select("chain", "draw", F.posexplode("theta").alias("idx", "value"))
    return out if only is None else out.where(F.col("idx").isin(list(only)))


def summarize(long: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Mean, standard deviation and exact quantiles (linear between order statistics) of ``value``."""
    probs = check_probs(probs)
    q = F.percentile("value", F.array(*[F.lit(p) for p in probs]))
    out = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("_q"))
    return out.select(*keys, "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(quantile_names(probs))])


def coefficients(draws: DataFrame) -> DataFrame:
    """(idx, mean, var) of each coefficient."""
    return long_theta(draws).groupBy("idx").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def covariances(long: DataFrame, block_of: DataFrame) -> DataFrame:
    """Sample covariances within blocks: ``long(chain, draw, idx, value)``, ``block_of(idx, block)`` -> (block, i, j, cov), i <= j."""
    x = long.join(F.broadcast(block_of), "idx")
    a = x.select("chain", "draw", "block", F.col("idx").alias("i"), F.col("value").alias("x"))
    b = x.select("chain", "draw", "block", F.col("idx").alias("j"), F.col("value").alias("y"))
    both = a.join(b, ["chain", "draw", "block"]).where("i <= j")
    return both.groupBy("block", "i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chains' (n, mean, m2) to those of all their draws; exact for equal and unequal n."""
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    join = parts.join(total, list(keys))
    d = F.col("mean") - F.col("_mean")
    return join.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"))


def merge_covariances(parts: DataFrame, keys: Sequence[str] = ("block", "i", "j")) -> DataFrame:
    """Chains' (n, mean_i, mean_j, c2) to a covariance."""
    w = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), w("mean_i").alias("_i"), w("mean_j").alias("_j"))
    both = parts.join(total, list(keys))
    c2 = F.sum(F.col("c2") + F.col("n") * (F.col("mean_i") - F.col("_i")) * (F.col("mean_j") - F.col("_j")))
    return both.groupBy(*keys).agg((c2 / (F.first("_n") - 1)).alias("cov"))


def variance(n: Column | str, m2: Column | str) -> Column:
    n, m2 = (F.col(c) if isinstance(c, str) else c for c in (n, m2))
    return F.greatest(F.lit(0.0), m2 / (n - 1))


def inclusion(draws: DataFrame) -> DataFrame:
    """(idx, inclusion) of predictors with a spike."""
    return draws.select(F.posexplode("inclusion").alias("idx", "x")).where("x is not null").groupBy("idx").agg(F.avg(F.col("x").cast("double")).alias("inclusion"))


def component_shares(long: DataFrame, components: int, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """Share of draws in each mixture component, and inclusion (any but the spike); ``long(..., component)`` from 0."""
    share = [F.avg(F.when(F.col("component") == k, 1.0).otherwise(0.0)).alias(f"component_{k}") for k in range(components)]
    return long.groupBy(*keys).agg(*share).withColumn("inclusion", 1 - F.col("component_0"))


def top(summary: DataFrame, k: int, by: str = "absolute_mean") -> DataFrame:
    """The first ``k`` coefficients by |mean| or inclusion; missing last, ties in their order.  The limit is the report's."""
    if by == "inclusion_probability" and "inclusion" not in summary.columns:
        raise SpecError("no block has inclusion probabilities to rank by")
    score = F.abs("mean") if by == "absolute_mean" else F.col("inclusion")
    return summary.orderBy(score.desc_nulls_last(), F.col("idx").asc()).limit(k)


def block_summary(predictors: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Per block: predictors, expected number included and mean inclusion (null without a spike)."""
    return predictors.join(coefficients, "idx", "left").groupBy("block").agg(F.count("*").alias("predictors"), F.sum("inclusion").alias("expected_included"), F.avg("inclusion").alias("mean_inclusion"))


def hyper_long(draws: DataFrame) -> DataFrame:
    """(chain, draw, param, value) of hyper-parameters and the residual variance."""
    each = draws.select("chain", "draw", F.explode("hyper").alias("param", "value"))
    return each.unionByName(draws.select("chain", "draw", F.lit("residual_var").alias("param"), F.col("residual_var").alias("value")))


def pve_long(draws: DataFrame, blocks: Sequence[str], kind: str = "standalone") -> DataFrame:
    """(chain, draw, param, value): each block's share of variance, Total, and Cross-block (total less the standalone shares)."""
    names = F.array(*[F.lit(b) for b in blocks])
    each = draws.select("chain", "draw", F.explode(F.arrays_zip(names.alias("param"), F.col(f"pve_{kind}").alias("value"))).alias("r")).select("chain", "draw", "r.param", "r.value")
    own = F.aggregate("pve_standalone", F.lit(0.0), lambda a, x: a + x)
    rest = draws.select("chain", "draw", F.explode(F.array(F.struct(F.lit("Total").alias("param"), F.col("pve_total").alias("value")), F.struct(F.lit("Cross-block").alias("param"), (F.col("pve_total") - own).alias("value")))).alias("r")).select("chain", "draw", "r.param", "r.value")
    return each.unionByName(rest)


def quadratic(draws: DataFrame, triplets: DataFrame, predictors: DataFrame) -> DataFrame:
    """Per draw and block b, t_b'G t (along) and t_b'G t_b (own), from ``draws(draw, idx, value)`` and triplets with i <= j.

    ``predictors(idx, block)``.  The work is in proportion to draws times stored entries.
    """
    both = triplets.select("i", "j", "v").unionAll(triplets.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    a = predictors.select(F.col("idx").alias("i"), F.col("block").alias("bi"))
    b = predictors.select(F.col("idx").alias("j"), F.col("block").alias("bj"))
    g = both.join(a, "i").join(b, "j")
    x = draws.select("draw", F.col("idx").alias("i"), F.col("value").alias("x"))
    y = draws.select(F.col("draw").alias("draw2"), F.col("idx").alias("j"), F.col("value").alias("y"))
    t = g.join(x, "i").join(y.withColumnRenamed("draw2", "draw"), ["j", "draw"]).withColumn("w", F.col("v") * F.col("x") * F.col("y"))
    return t.groupBy("draw", F.col("bi").alias("block")).agg(F.sum("w").alias("along"), F.sum(F.when(F.col("bi") == F.col("bj"), F.col("w")).otherwise(0.0)).alias("own"))


def thin(rows: DataFrame, burnin: int, every: int, order: str = "draw", keys: Sequence[str] = ("chain",)) -> DataFrame:
    """Kept draws of stored ones: those after ``burnin``, then each ``every``-th, renumbered from 0."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kept = rows.withColumn("_n", n).where((F.col("_n") > burnin) & ((F.col("_n") - burnin - 1) % every == 0))
    return kept.withColumn("kept", ((F.col("_n") - burnin - 1) / every).cast("int")).drop("_n")
