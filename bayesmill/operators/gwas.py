"""Marginal effects and LD: harmonisation, working statistics, conversion.

Harmonisation is one full outer join by id; every row gets exactly one status.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from ..sources.quality import DataError
from .gram import ROOT_EPS
from .ld import DIAGONAL_SLACK, check_correlations

KEPT = ("retained+1", "retained-1")
SCALES = ("standardized", "original")


def complement(allele: Column) -> Column:
    """The other strand's allele for a single A, C, G or T; null for anything else."""
    return F.when(allele.isin("A", "C", "G", "T"), F.translate(allele, "ACGT", "TGCA"))


def palindromic(a1: Column, a0: Column) -> Column:
    return F.concat(a1, a0).isin("AT", "TA", "CG", "GC")


def harmonize(gwas: DataFrame, variants: DataFrame) -> DataFrame:
    """Every id of either table with its status; alleles are in upper case on both sides.

    In this order: gwas_only, ld_only, location_mismatch, ambiguous (alleles that
    are their own complement), allele_mismatch, retained+1 (direct or on the
    other strand), retained-1 (reversed, on either strand).
    """
    g = gwas.select(F.col("ID"), *[F.col(c).alias(f"g_{c}") for c in gwas.columns if c != "ID"], F.lit(True).alias("_g"))
    v = variants.select(F.col("ID"), *[F.col(c).alias(f"v_{c}") for c in variants.columns if c != "ID"], F.lit(True).alias("_v"))
    a1, a0, b1, b0 = (F.col(c) for c in ("g_A1", "g_A0", "v_A1", "v_A0"))
    no = F.lit(False)
    same = F.coalesce((a1 == b1) & (a0 == b0), no) | F.coalesce((complement(a1) == b1) & (complement(a0) == b0), no)
    swapped = F.coalesce((a1 == b0) & (a0 == b1), no) | F.coalesce((complement(a1) == b0) & (complement(a0) == b1), no)
    status = (
        F.when(F.col("_v").isNull(), "gwas_only").when(F.col("_g").isNull(), "ld_only")
        .when((F.col("g_CHR") != F.col("v_CHR")) | (F.col("g_POS") != F.col("v_POS")), "location_mismatch")
        .when(palindromic(a1, a0) | palindromic(b1, b0), "ambiguous")
        .when(~(same | swapped), "allele_mismatch").when(same, KEPT[0]).otherwise(KEPT[1])
    )
    return g.join(v, "ID", "full_outer").withColumn("status", status).drop("_g", "_v")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def excluded_entries(rows: DataFrame) -> DataFrame:
    """Table entries left out, by reason: an unmatched id is one, a rejected pair two."""
    out = rows.where(~F.col("status").isin(*KEPT)).groupBy("status").agg(F.count("*").alias("n"))
    return out.select("status", (F.col("n") * F.when(F.col("status").isin("gwas_only", "ld_only"), 1).otherwise(2)).alias("entries"))


def retained(rows: DataFrame) -> DataFrame:
    """Matched rows with their orientation; the effect is that of the LD table's first allele."""
    sign = F.when(F.col("status") == KEPT[0], 1.0).otherwise(-1.0)
    return rows.where(F.col("status").isin(*KEPT)).withColumn("orientation", sign).withColumn("beta", F.col("g_BETA") * sign)


def working(rows: DataFrame, n: int, beta: str = "beta", se: str = "se", scale: str = "standardized", residual_df: int | None = None, response_var: float | None = None) -> DataFrame:
    """Add what marginal effects say of cross-products: s (root of the diagonal), xty; and yty, a constant.

    Standardized: G = (n-1) R and y'y = n-1.  Original: the diagonal is the
    response variance times (n-1) / (z^2 + df) / se^2.
    """
    if scale not in SCALES:
        raise SpecError("scale must be standardized or original")
    if scale == "original" and response_var is None:
        raise SpecError("the original scale needs response_var")
    df = n - 2 if residual_df is None else residual_df
    z = F.col(beta) / F.col(se)
    a = F.lit(float(n - 1)) / (z * z + F.lit(float(df)))
    if scale == "standardized":
        return rows.withColumns({"diag": F.lit(float(n - 1)), "xty": F.sqrt(F.lit(float(n - 1))) * F.sqrt(a) * z, "yty": F.lit(float(n - 1))})
    d = F.lit(float(response_var)) * a / (F.col(se) * F.col(se))
    return rows.withColumns({"diag": d, "xty": d * F.col(beta), "yty": F.lit(float(n - 1) * response_var)})


def convert(rows: DataFrame, correlations: DataFrame, n: int, **kw) -> tuple[DataFrame, DataFrame]:
    """Cross-product triplets and predictors from effects ``rows(idx, beta, se)`` and ``correlations(block, i, j, v)`` of one triangle with diagonal."""
    check_correlations(correlations, 1 + DIAGONAL_SLACK)
    p = working(rows, n, **kw)
    correlations = correlations.withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v").cast("double")))
    side = lambda k: p.select(F.col("idx").alias(k), F.sqrt("diag").alias(f"_{k}"))
    g = correlations.join(side("i"), "i").join(side("j"), "j").withColumn("v", F.col("v") * F.col("_i") * F.col("_j")).drop("_i", "_j")
    return g, p


def convert_matrices(rows: DataFrame, matrices: Mapping[str, np.ndarray] | Sequence[np.ndarray], n: int, **kw) -> tuple[DataFrame, DataFrame]:
    """As :func:`convert`, from LD matrices whose order is that of ``rows(idx, ...)``; those of a list are named block1, block2 ..."""
    named = dict(matrices) if isinstance(matrices, Mapping) else {f"block{k + 1}": m for k, m in enumerate(matrices)}
    cells, at = [], 0
    for name, m in named.items():
        m = np.asarray(m, float)
        if m.ndim != 2 or m.shape[0] != m.shape[1] or not len(m):
            raise DataError(f"LD matrix {name} must be square")
        if not np.isfinite(m).all() or abs(m - m.T).max() > ROOT_EPS:
            raise DataError(f"LD matrix {name} must be finite and symmetric")
        i, j = np.nonzero(np.triu(m, 1) + np.eye(len(m)))
        cells.append(pa.table({"block": [name] * len(i), "i": i + at, "j": j + at, "v": m[i, j]}))
        at += len(m)
    count = rows.count()
    if at != count:
        raise DataError(f"the LD matrices hold {at} variants and the effects {count}")
    return convert(rows, rows.sparkSession.createDataFrame(pa.concat_tables(cells)), n, **kw)


def common_n(rows: DataFrame) -> int:
    r = rows.agg(F.min("g_N").alias("a"), F.max("g_N").alias("b"), F.count("*").alias("k")).first()
    if not r["k"]:
        raise DataError("no variant of the effects is in the LD object with the same place and alleles")
    if r["a"] != r["b"]:
        raise DataError("all variants need the same N")
    return int(r["a"])
