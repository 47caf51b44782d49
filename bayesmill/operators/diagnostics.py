"""Convergence diagnostics: R-hat in Catalyst; Geweke and effective sample size from an autoregressive spectrum."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError

LEAST = 20


def rhat(long: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Potential scale reduction without splitting; null for one chain or if nothing varies.

    ``long(param, chain, value)`` with equally many draws of each chain.
    """
    per = long.groupBy(*keys, "chain").agg(F.avg("value").alias("mu"), F.var_samp("value").alias("w"), F.count("*").alias("m"))
    both = per.groupBy(*keys).agg(F.avg("w").alias("w"), F.var_samp("mu").alias("b"), F.first("m").alias("m"), F.count("*").alias("chains"))
    value = F.sqrt(((F.col("m") - 1) / F.col("m") * F.col("w") + F.col("b")) / F.col("w"))
    return both.select(*keys, F.when((F.col("chains") > 1) & (F.col("w") > 0), value).alias("rhat"))


def check_chains(long: DataFrame, keys: Sequence[str] = ("param",)) -> int:
    """Equally long chains of at least 20 draws; returns the length."""
    n = long.groupBy(*keys, "chain").agg(F.count("*").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if n["a"] is None:
        raise SpecError("nothing to assess")
    if n["a"] != n["b"]:
        raise SpecError("chains differ in length")
    if n["a"] < LEAST:
        raise SpecError(f"{LEAST} draws a chain are needed")
    return n["a"]


def spectrum0(x: np.ndarray) -> float:
    """Spectral density at zero of an autoregression by Yule-Walker, its order by AIC."""
    x = np.asarray(x, float)
    n = len(x)
    c = x - x.mean()
    if n < 3 or float(c @ c) <= 1e-300 or np.ptp(x) == 0:
        return 0.0
    most = min(n - 1, int(10 * math.log10(n)))
    acov = np.array([float(c[: n - k] @ c[k:]) / n for k in range(most + 1)])
    var, phi = acov[0], np.zeros(0)
    best = (n * math.log(var), var, phi, 0)
    for k in range(1, most + 1):  # Levinson's recursion
        r = (acov[k] - float(phi @ acov[k - 1 : 0 : -1][: len(phi)])) / var
        phi = np.append(phi - r * phi[::-1], r)
        var *= 1 - r * r
        if var <= 0:
            break
        aic = n * math.log(var) + 2 * k
        if aic < best[0]:
            best = (aic, var, phi.copy(), k)
    _, var, phi, k = best
    return var * n / (n - (k + 1)) / (1 - phi.sum()) ** 2


def effective_size(x: np.ndarray) -> float:
    s = spectrum0(x)
    return len(x) * float(np.var(x, ddof=1)) / s if s > 0 else 0.0


def geweke_z(x: np.ndarray, first: float = 0.1, last: float = 0.5) -> float:
    """Difference of the means of a chain's beginning and end over its standard error."""
    a, b = x[: max(2, int(math.ceil(first * len(x))))], x[len(x) - int(last * len(x)) :]
    v = spectrum0(a) / len(a) + spectrum0(b) / len(b)
    return float((a.mean() - b.mean()) / math.sqrt(v)) if v > 0 else float("nan")


def per_chain(long: DataFrame, order: str = "draw", keys: Sequence[str] = ("param",)) -> DataFrame:
    """Geweke z and effective size of each parameter's chains, a task for each."""
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*keys, "chain").schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)["value"].to_numpy()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in (*keys, "chain")}, "geweke": [geweke_z(x)], "ess": [effective_size(x)]})

    return long.select(*keys, "chain", order, "value").groupBy(*keys, "chain").applyInPandas(one, fields + ", geweke double, ess double")


def assess(long: DataFrame) -> DataFrame:
    """Per parameter: R-hat, effective size over all chains, and Geweke z by chain (a map); ``long(param, chain, draw, value)``."""
    check_chains(long)
    each = per_chain(long).groupBy("param").agg(F.sum("ess").alias("ess"), F.map_from_entries(F.collect_list(F.struct("chain", "geweke"))).alias("geweke"))
    return rhat(long).join(each, "param")


def trace(long: DataFrame) -> DataFrame:
    """What a trace plot shows: (param, title, chain, draw, value)."""
    return long.select("param", F.concat(F.lit("Trace of "), "param").alias("title"), "chain", "draw", "value")
