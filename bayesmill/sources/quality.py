"""Input checks: one aggregation for each input, and what follows from it.

Nulls, NaN and infinities are refused at the boundary, so nothing downstream
need look for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


class DataError(ValueError):
    """Input data that cannot be used."""


def infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: rows, nulls, NaN, infinities, least, greatest, mean, and whether it is constant; one pass."""
    aggs = []
    for k, name in enumerate(columns):
        c = F.col(name).cast("double")
        aggs += [
            F.count_if(c.isNull()).alias(f"nulls_{k}"), F.count_if(F.isnan(c)).alias(f"nans_{k}"), F.count_if(infinite(c)).alias(f"infs_{k}"),
            F.min(c).alias(f"least_{k}"), F.max(c).alias(f"most_{k}"), F.avg(c).alias(f"mean_{k}"),
        ]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = [
        F.struct(F.lit(name).alias("column"), F.col("n"), *[F.col(f"{x}_{k}").alias(x) for x in ("nulls", "nans", "infs", "least", "most", "mean")], (F.col(f"least_{k}") == F.col(f"most_{k}")).alias("constant"))
        for k, name in enumerate(columns)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """They exist, once, and are numbers."""
    if missing := [c for c in columns if c not in df.columns]:
        raise DataError(f"missing columns {missing}")
    if len(set(columns)) != len(columns):
        raise DataError("a predictor is named twice")
    if bad := [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]:
        raise DataError(f"columns {bad} are not numbers")


def check_observations(df: DataFrame, y: str, x: Sequence[str]) -> int:
    """Finite values, two rows or more, no constant predictor; returns the number of rows."""
    check_columns(df, [y, *x])
    rows = profile(df, [y, *x]).collect()
    n = rows[0]["n"]
    if n < 2:
        raise DataError("two observations are needed at least")
    if bad := [r["column"] for r in rows if r["nulls"] or r["nans"] or r["infs"]]:
        raise DataError(f"columns {bad} hold values that are missing or not finite")
    if bad := [r["column"] for r in rows if r["constant"] and r["column"] != y]:
        raise DataError(f"predictors {bad} are constant")
    return n


def check_array(df: DataFrame, y: str, x: str) -> int:
    """A response and an array column of one length, all finite, in one aggregation; returns the number of rows."""
    check_columns(df, [y])
    v, a = F.col(y).cast("double"), F.col(x).cast("array<double>")
    bad = v.isNull() | F.isnan(v) | infinite(v) | a.isNull() | F.exists(a, lambda e: e.isNull() | F.isnan(e) | infinite(e))
    r = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.min(F.size(a)).alias("least"), F.max(F.size(a)).alias("most")).first()
    if r["n"] < 2:
        raise DataError("two observations are needed at least")
    if r["bad"] or r["least"] != r["most"] or r["least"] < 1:
        raise DataError(f"{x} must hold arrays of one length without missing or infinite values")
    return r["n"]


def duplicated(df: DataFrame, id: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return df.groupBy(id).agg(F.count("*").alias("n")).where("n > 1")


def some(df: DataFrame, column: str, n: int = 10) -> str:
    """The first few values, for a message."""
    found = [str(r[0]) for r in df.select(column).orderBy(column).limit(n + 1).collect()]
    return ", ".join(found[:n]) + (", ..." if len(found) > n else "")


def check_variants(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A variant table: ids once, positions from 1, alleles given and different; alleles in upper case."""
    need = ("CHR", "ID", "POS", "A1", "A0", *extra)
    if missing := [c for c in need if c not in df.columns]:
        raise DataError(f"missing columns {missing}")
    if bad := [c for c in ("CHR", "ID", "A1", "A0") if not isinstance(df.schema[c].dataType, StringType)]:
        raise DataError(f"columns {bad} are not text")
    check_columns(df, ["POS", *extra])
    out = df.withColumns({"A1": F.upper("A1"), "A0": F.upper("A0")})
    wrong = {
        "text that is missing or empty": F.count_if(F.greatest(*[F.coalesce(F.trim(c) == "", F.lit(True)) for c in ("CHR", "ID", "A1", "A0")])),
        "positions that are not whole numbers from 1": F.count_if(~F.coalesce((F.col("POS") >= 1) & (F.col("POS") == F.floor("POS")), F.lit(False))),
        "equal alleles": F.count_if(F.col("A1") == F.col("A0")),
    }
    found = out.agg(*[v.alias(k) for k, v in wrong.items()]).first().asDict()
    if bad := [k for k, v in found.items() if v]:
        raise DataError(f"variants have {'; '.join(bad)}")
    twice = duplicated(out, "ID")
    if not twice.isEmpty():
        raise DataError(f"ids occur more than once: {some(twice, 'ID')}")
    return out


def check_gwas(df: DataFrame) -> DataFrame:
    """A table of marginal effects: a variant table with N from 3, finite BETA and positive SE."""
    out = check_variants(df, ("N", "BETA", "SE"))
    c = {k: F.col(k).cast("double") for k in ("N", "BETA", "SE")}
    ok = (c["N"] >= 3) & (c["N"] == F.floor(c["N"])) & ~F.isnan(c["BETA"]) & ~infinite(c["BETA"]) & (c["SE"] > 0) & ~F.isnan(c["SE"]) & ~infinite(c["SE"])
    if out.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("n")).first()["n"]:
        raise DataError("N must be whole from 3, BETA finite and SE positive")
    return out
