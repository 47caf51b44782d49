"""Named queries over the driver's tables, and SQL that gives the same rows.

Floating results are rounded, as engines add in different orders.  Tables that
both sides derive are written once as SQL that both understand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fit import fit, fit_array, fit_eigen, fit_sparse, fit_ss
from .fit_gwas import fit_gwas
from .operators import diagnostics as D
from .operators import eigen as E
from .operators import gram as G
from .operators import gwas as W
from .operators import ld as L
from .operators import posterior as P
from .operators import predict as R
from .plans.spec import calibrate, parse_blocks, residual_prior
from .sources import quality as Q

Y, X = "l_extendedprice", ("l_quantity", "l_discount", "l_tax")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Derived tables, in SQL of both engines.  All rows are used: variants that only one side knows have ids of their own, and events
#: are dealt to four chains in turn.
DERIVED = {
    "variants": """
SELECT concat(CASE WHEN p_partkey % 13 = 0 THEN 'ld' ELSE 'rs' END, CAST(p_partkey AS string)) AS ID, CAST(p_size % 22 + 1 AS string) AS CHR, CAST(p_partkey + 1 AS bigint) AS POS,
       substr('ACGT', CAST(p_partkey % 4 + 1 AS int), 1) AS A1, substr('ACGT', CAST((p_partkey + 1 + p_partkey % 3) % 4 + 1 AS int), 1) AS A0, p_partkey AS k
FROM {part}""",
    "gwas": """
SELECT concat(CASE WHEN p.p_partkey % 7 = 0 THEN 'gw' ELSE 'rs' END, CAST(p.p_partkey AS string)) AS ID, CAST(p_size % 22 + 1 AS string) AS CHR,
       CAST(p.p_partkey + 1 + CASE WHEN p.p_partkey % 11 = 0 THEN 1000000 ELSE 0 END AS bigint) AS POS,
       CASE WHEN p.p_partkey % 17 = 0 THEN 'AC' WHEN p.p_partkey % 5 = 0 THEN substr('ACGT', CAST((p.p_partkey + 1 + p.p_partkey % 3) % 4 + 1 AS int), 1)
            WHEN p.p_partkey % 19 = 0 THEN substr('TGCA', CAST(p.p_partkey % 4 + 1 AS int), 1) ELSE substr('ACGT', CAST(p.p_partkey % 4 + 1 AS int), 1) END AS A1,
       CASE WHEN p.p_partkey % 17 = 0 THEN 'G' WHEN p.p_partkey % 5 = 0 THEN substr('ACGT', CAST(p.p_partkey % 4 + 1 AS int), 1)
            WHEN p.p_partkey % 19 = 0 THEN substr('TGCA', CAST((p.p_partkey + 1 + p.p_partkey % 3) % 4 + 1 AS int), 1) ELSE substr('ACGT', CAST((p.p_partkey + 1 + p.p_partkey % 3) % 4 + 1 AS int), 1) END AS A0,
       1000 AS N, BETA, SE, p.p_partkey AS k
FROM {part} p JOIN (SELECT l_partkey, avg(l_discount) - 0.05 AS BETA, 0.01 + avg(l_tax) AS SE FROM {lineitem} GROUP BY l_partkey) b ON b.l_partkey = p.p_partkey""",
    "draws": """
SELECT event_id % 4 AS chain, CAST(floor(event_id / 4) AS bigint) + 1 AS draw, CAST(value AS double) AS value, user_id % 3 AS kind FROM {events} e""",
    "edges": """
SELECT a.CHR AS parent, a.pos AS i, b.pos AS j, power(0.8, abs(a.k - b.k)) AS v
FROM (SELECT CHR, k, row_number() OVER (PARTITION BY CHR ORDER BY k) - 1 AS pos, floor(k / 340) AS grp FROM {variants} v1) a
JOIN (SELECT CHR, k, row_number() OVER (PARTITION BY CHR ORDER BY k) - 1 AS pos, floor(k / 340) AS grp FROM {variants} v2) b
ON a.CHR = b.CHR AND a.grp = b.grp AND a.pos > b.pos AND a.pos - b.pos <= 3""",
    "places": "SELECT CHR AS parent, ID, k, CAST(row_number() OVER (PARTITION BY CHR ORDER BY k) - 1 AS int) AS pos_in_ld FROM {variants} v",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NEEDS = {"variants": ["part"], "gwas": ["part", "lineitem"], "draws": ["events"], "edges": ["variants"], "places": ["variants"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in DERIVED:
        return spark.sql(DERIVED[name], **{n: table(spark, sf, n) for n in _NEEDS[name]})
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(text: str) -> str:
    """``text`` with the derived tables it names defined before it."""
    used: list[str] = []

    def need(name):
        for n in _NEEDS[name]:
            if n in DERIVED:
                need(n)
        if name not in used:
            used.append(name)

    for name in DERIVED:
        if f"{{{name}}}" in text:
            need(name)
    names = {n: n for n in [*_TABLES, *DERIVED]}
    ctes = ", ".join(f"{n} AS ({DERIVED[n].format(**names)})" for n in used)
    text = text.format(**names).strip()
    if not ctes:
        return text
    return f"WITH RECURSIVE {ctes}, {text[len('WITH '):].removeprefix('RECURSIVE ')}" if text.startswith("WITH ") else f"WITH {ctes} {text}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})


# -- inputs -----------------------------------------------------------------

_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE isnan(CAST({c} AS double))) AS nans, count(*) FILTER (WHERE isinf(CAST({c} AS double))) AS infs, "
    f"round(CAST(min({c}) AS double), 4) AS least, round(CAST(max({c}) AS double), 4) AS most, round(avg(CAST({c} AS double)), 4) AS mean, min({c}) = max({c}) AS constant FROM (SELECT *, 1.0 AS one FROM lineitem) t"
    for c in (Y, *X, "one")
)


@query(_PROFILE)
def dq_profile(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    return rounded(Q.profile(df, [Y, *X, "one"]), least=4, most=4, mean=4)


@query(f'SELECT "column" FROM ({_PROFILE}) p WHERE constant')
def constant_predictors(spark, sf):
    return dq_profile(spark, sf).where("constant").select("column")


@query("SELECT ID, count(*) AS n FROM (SELECT ID FROM {variants} UNION ALL SELECT ID FROM {gwas}) t GROUP BY ID HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    both = table(spark, sf, "variants").select("ID").unionAll(table(spark, sf, "gwas").select("ID"))
    return Q.duplicated(both, "ID")


# -- cross-products ---------------------------------------------------------

_COLS = (*X, Y)
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_RAW = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(CAST({_COLS[i]} AS double) * {_COLS[j]}) AS v FROM lineitem" for i, j in _PAIRS)
_CENTRED = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp(CAST({_COLS[i]} AS double), CAST({_COLS[j]} AS double)) * (count(*) - 1) AS v FROM lineitem" for i, j in _PAIRS)


def _sig(c="v", digits=8):
    """Rounded to significant digits."""
    x = F.col(c)
    return F.when(x == 0, 0.0).otherwise(F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x)))), digits))


def _sig_sql(x="v", digits=8):
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / power(10.0, floor(log10(abs({x})))), {digits}) END"


def _exponent(c="v"):
    return F.when(F.col(c) == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c))).cast("int"))


def _exp_sql(x="v"):
    return f"CASE WHEN {x} = 0 THEN 0 ELSE CAST(floor(log10(abs({x}))) AS int) END"


@query(f"SELECT i, j, {_sig_sql()} AS v, {_exp_sql()} AS e FROM ({_RAW}) t")
def gram_raw(spark, sf):
    return G.raw_triplets(table(spark, sf, "lineitem"), _COLS).select("i", "j", _sig().alias("v"), _exponent().alias("e"))


@query(f"SELECT i, j, {_sig_sql(digits=6)} AS v, {_exp_sql()} AS e FROM ({_CENTRED}) t")
def gram_centered(spark, sf):
    return G.centred_triplets(table(spark, sf, "lineitem"), _COLS).select("i", "j", _sig(digits=6).alias("v"), _exponent().alias("e"))


@query(f"SELECT i, j, {_sig_sql(digits=6)} AS v, {_exp_sql()} AS e FROM ({_CENTRED}) t")
def gram_one_scan(spark, sf):
    n, m, s = G.moments(table(spark, sf, "lineitem"), _COLS)
    df = spark.createDataFrame([(i, j, float(s[i, j])) for i, j in _PAIRS], "i int, j int, v double")
    return df.select("i", "j", _sig(digits=6).alias("v"), _exponent().alias("e"))


@query("""WITH e AS (SELECT row_number() OVER () AS r, embedding FROM embeddings),
u AS (SELECT r, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS x FROM e),
m AS (SELECT k, avg(CAST(x AS double)) AS m FROM u GROUP BY k), c AS (SELECT r, u.k, CAST(x AS double) - m AS x FROM u JOIN m ON u.k = m.k)
SELECT CAST(a.k AS int) AS i, CAST(b.k AS int) AS j, round(sum(a.x * b.x), 5) AS v FROM c a JOIN c b ON a.r = b.r AND a.k <= b.k GROUP BY a.k, b.k""")
def gram_wide(spark, sf):
    return rounded(G.wide_triplets(table(spark, sf, "embeddings"), "embedding"), v=5)


def _predictors(spark, sf) -> tuple[DataFrame, int, float]:
    df = table(spark, sf, "lineitem")
    one = df.agg(F.count("*").alias("n"), F.avg(F.col(Y).cast("double")).alias("y"), *[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(X)], *[F.sum(F.col(c).cast("double") * F.col(Y).cast("double")).alias(f"g{k}") for k, c in enumerate(X)]).first()
    rows = [(k, c, one[f"g{k}"], one[f"m{k}"]) for k, c in enumerate(X)]
    return spark.createDataFrame(rows, "idx int, name string, xty double, x_mean double"), one["n"], one["y"]


@query("SELECT idx, name, round(xty - n * m * y, 2) AS xty FROM (" + " UNION ALL ".join(f"SELECT {k} AS idx, '{c}' AS name, sum(CAST({c} AS double) * {Y}) AS xty, avg(CAST({c} AS double)) AS m, avg(CAST({Y} AS double)) AS y, count(*) AS n FROM lineitem" for k, c in enumerate(X)) + ") t")
def xty_centered(spark, sf):
    p, n, y = _predictors(spark, sf)
    return G.centre_xty(p, n, y).select("idx", "name", F.round("xty", 2).alias("xty"))


@query("SELECT i, j, round(v - n * mi * mj, 1) AS v FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(CAST({X[i]} AS double) * {X[j]}) AS v, avg(CAST({X[i]} AS double)) AS mi, avg(CAST({X[j]} AS double)) AS mj, count(*) AS n FROM lineitem" for i in range(3) for j in range(i, 3)) + ") t")
def gram_centered_triplets(spark, sf):
    p, n, _ = _predictors(spark, sf)
    return G.centre(G.raw_triplets(table(spark, sf, "lineitem"), X), p, n).select("i", "j", F.round("v", 1).alias("v"))


_SCALES = " UNION ALL ".join(f"SELECT {k} AS idx, stddev_samp(CAST({c} AS double)) AS scale FROM lineitem" for k, c in enumerate(X))


def _scales(spark, sf):
    c = G.centred_triplets(table(spark, sf, "lineitem"), X)
    n = table(spark, sf, "lineitem").count()
    return c.where("i = j").select(F.col("i").alias("idx"), G.predictor_scale(F.col("v"), n).alias("scale")), c


@query(f"SELECT idx, round(scale, 8) AS scale FROM ({_SCALES}) t")
def predictor_scales(spark, sf):
    return rounded(_scales(spark, sf)[0], scale=8)


@query("SELECT i, j, round(v / si / sj, 4) AS v FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp(CAST({X[i]} AS double), CAST({X[j]} AS double)) * (count(*) - 1) AS v, stddev_samp(CAST({X[i]} AS double)) AS si, stddev_samp(CAST({X[j]} AS double)) AS sj FROM lineitem" for i in range(3) for j in range(i, 3)) + ") t")
def gram_standardized(spark, sf):
    s, c = _scales(spark, sf)
    return G.scale_triplets(c, s).select("i", "j", F.round("v", 4).alias("v"))


@query(f"SELECT round(var_samp(CAST({Y} AS double)), 0) AS response_var FROM lineitem")
def response_var(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.var_samp(F.col(Y).cast("double")), 0).alias("response_var"))


@query("SELECT CAST(p_size % 22 AS int) AS gram_block, p_brand AS prior_block, count(*) AS predictors FROM part GROUP BY 1, 2")
def gram_blocks_groupby(spark, sf):
    return table(spark, sf, "part").groupBy((F.col("p_size") % 22).cast("int").alias("gram_block"), F.col("p_brand").alias("prior_block")).agg(F.count("*").alias("predictors"))


@query("SELECT CAST(3 AS int) AS idx UNION ALL SELECT CAST(4 AS int)")
def constant_gram(spark, sf):
    """Three columns that vary and two that do not, one of them far from zero."""
    df = table(spark, sf, "lineitem").select(*X, F.lit(1e6).alias("far"), F.lit(0.1).alias("near"))
    names = [*X, "far", "near"]
    means = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    p = spark.createDataFrame([(i, float(means[c])) for i, c in enumerate(names)], "idx int, x_mean double")
    return G.constant_predictors(G.raw_triplets(df, names), p, means["n"])


@query("SELECT 'all' AS block, 0.0 AS difference")
def gram_symmetry(spark, sf):
    c = G.centred_triplets(table(spark, sf, "lineitem"), X)
    full = c.unionByName(c.where("i <> j").select("block", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return G.asymmetry(full).where("difference <= allowed").select("block", F.round("difference", 6).alias("difference"))


# -- calibration ------------------------------------------------------------

def _calibrated(spark, sf, **block):
    """A block on all predictors, standardized, with its scale worked out."""
    s = G.from_observations(table(spark, sf, "lineitem"), Y, X)
    b = parse_blocks({"b": {"columns": list(X), **block}}, "columns")
    return calibrate(b, {"b": 3.0}, {"b": 3}, s.response_var(), s.n)[0], s


_VY = f"(SELECT var_samp(CAST({Y} AS double)) AS vy, count(*) AS n FROM lineitem) t"


@query(f"SELECT round((3 - 1) * 0.3 * vy / 3, 0) AS scale FROM {_VY}")
def pve_scale_normal(spark, sf):
    b, _ = _calibrated(spark, sf, model="Normal", var_shape=3.0, expected_pve=0.3)
    return spark.createDataFrame([(float(b.scale),)], "scale double").select(F.round("scale", 0).alias("scale"))


@query(f"SELECT round((3 - 1) * 0.3 * vy / (3 * 0.25), 0) AS scale FROM {_VY}")
def pve_scale_spikeslab(spark, sf):
    b, _ = _calibrated(spark, sf, model="SpikeSlab", var_shape=3.0, expected_pve=0.3, pi=(1.0, 3.0))
    return spark.createDataFrame([(float(b.scale),)], "scale double").select(F.round("scale", 0).alias("scale"))


@query(f"SELECT round((3 - 1) * 0.3 * vy / (3 * (0 * 5 + 0.01 * 3 + 0.1 * 1 + 1.0 * 1) / 10.0), 0) AS scale FROM {_VY}")
def pve_scale_multislab(spark, sf):
    b, _ = _calibrated(spark, sf, model="SpikeMultiSlab", var_shape=3.0, expected_pve=0.3, alpha=(5.0, 3.0, 1.0, 1.0))
    return spark.createDataFrame([(float(b.scale),)], "scale double").select(F.round("scale", 0).alias("scale"))


@query(f"SELECT round(1.0 / (3 - 1) * sqrt((1 - 0.3) * vy / n), 6) AS scale FROM {_VY}")
def global_scale(spark, sf):
    b, _ = _calibrated(spark, sf, model="GlobalLocal", expected_nonzero=1.0, expected_pve=0.3)
    return spark.createDataFrame([(float(b.global_scale),)], "scale double").select(F.round("scale", 6).alias("scale"))


@query(f"SELECT round((3 - 1) * (1 - 0.3) * vy, 0) AS scale FROM {_VY}")
def residual_scale(spark, sf):
    b, s = _calibrated(spark, sf, model="Normal", var_shape=3.0, expected_pve=0.3)
    prior = residual_prior([b], shape=3.0, response_var=s.response_var())
    return spark.createDataFrame([(float(prior.scale),)], "scale double").select(F.round("scale", 0).alias("scale"))


# -- effects and harmonisation ----------------------------------------------

@query("SELECT l_linenumber, count(*) AS n, round(regr_slope(CAST(l_extendedprice AS double), CAST(l_quantity AS double)), 5) AS beta, round(sqrt((regr_syy(CAST(l_extendedprice AS double), CAST(l_quantity AS double)) - regr_sxy(CAST(l_extendedprice AS double), CAST(l_quantity AS double)) * regr_slope(CAST(l_extendedprice AS double), CAST(l_quantity AS double))) / (count(*) - 2) / regr_sxx(CAST(l_extendedprice AS double), CAST(l_quantity AS double))), 5) AS se FROM lineitem GROUP BY l_linenumber")
def marginal_gwas(spark, sf):
    y, x = F.col(Y).cast("double"), F.col("l_quantity").cast("double")
    g = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    beta = F.col("c") / F.col("vx")
    se = F.sqrt((F.col("vy") - F.col("c") * beta) * (F.col("n") - 1) / (F.col("n") - 2) / (F.col("vx") * (F.col("n") - 1)))
    return g.select("l_linenumber", "n", F.round(beta, 5).alias("beta"), F.round(se, 5).alias("se"))


_Z = "(BETA / SE)"
_WORK = "SELECT ID, BETA, SE, 999.0 / (BETA * BETA / (SE * SE) + 998.0) AS a FROM {gwas} g"


@query(f"SELECT ID, 999.0 AS diag, round(sqrt(999.0) * sqrt(a) * {_Z}, 6) AS xty, 999.0 AS yty FROM ({_WORK}) t")
def gwas_working_std(spark, sf):
    return W.working(table(spark, sf, "gwas"), 1000, beta="BETA", se="SE").select("ID", "diag", F.round("xty", 6).alias("xty"), "yty")


@query(f"SELECT ID, round(2.5 * a / (SE * SE), 3) AS diag, round(2.5 * a / (SE * SE) * BETA, 4) AS xty, 2497.5 AS yty FROM ({_WORK}) t")
def gwas_working_orig(spark, sf):
    w = W.working(table(spark, sf, "gwas"), 1000, beta="BETA", se="SE", scale="original", response_var=2.5)
    return w.select("ID", F.round("diag", 3).alias("diag"), F.round("xty", 4).alias("xty"), "yty")


_HARMONIZED = """SELECT ID, beta, CASE WHEN vid IS NULL THEN 'gwas_only' WHEN gid IS NULL THEN 'ld_only' WHEN NOT loc THEN 'location_mismatch' WHEN pal THEN 'ambiguous'
  WHEN NOT (same OR swapped) THEN 'allele_mismatch' WHEN same THEN 'retained+1' ELSE 'retained-1' END AS status FROM (
  SELECT coalesce(g.ID, v.ID) AS ID, g.ID AS gid, v.ID AS vid, g.BETA AS beta, g.CHR = v.CHR AND g.POS = v.POS AS loc, concat(g.A1, g.A0) IN ('AT', 'TA', 'CG', 'GC') OR concat(v.A1, v.A0) IN ('AT', 'TA', 'CG', 'GC') AS pal,
    coalesce(g.A1 = v.A1 AND g.A0 = v.A0, false) OR coalesce(length(g.A1) = 1 AND length(g.A0) = 1 AND translate(g.A1, 'ACGT', 'TGCA') = v.A1 AND translate(g.A0, 'ACGT', 'TGCA') = v.A0, false) AS same,
    coalesce(g.A1 = v.A0 AND g.A0 = v.A1, false) OR coalesce(length(g.A1) = 1 AND length(g.A0) = 1 AND translate(g.A1, 'ACGT', 'TGCA') = v.A0 AND translate(g.A0, 'ACGT', 'TGCA') = v.A1, false) AS swapped
  FROM {gwas} g FULL OUTER JOIN {variants} v ON g.ID = v.ID) h"""


def _harmonized(spark, sf):
    return W.harmonize(table(spark, sf, "gwas"), table(spark, sf, "variants"))


@query(f"SELECT ID, status FROM ({_HARMONIZED}) t")
def harmonize_status(spark, sf):
    return _harmonized(spark, sf).select("ID", "status")


@query(f"SELECT status, count(*) AS n FROM ({_HARMONIZED}) t GROUP BY status")
def harmonize_counts(spark, sf):
    return W.status_counts(_harmonized(spark, sf))


@query(f"SELECT status, count(*) * CASE WHEN status IN ('gwas_only', 'ld_only') THEN 1 ELSE 2 END AS entries FROM ({_HARMONIZED}) t WHERE status NOT LIKE 'retained%' GROUP BY status")
def harmonize_excluded(spark, sf):
    return W.excluded_entries(_harmonized(spark, sf))


@query(f"SELECT ID, CASE WHEN status = 'retained+1' THEN 1.0 ELSE -1.0 END AS orientation, round(beta * CASE WHEN status = 'retained+1' THEN 1.0 ELSE -1.0 END, 8) AS beta FROM ({_HARMONIZED}) t WHERE status LIKE 'retained%'")
def orientation(spark, sf):
    return W.retained(_harmonized(spark, sf)).select("ID", "orientation", F.round("beta", 8).alias("beta"))


@query("SELECT (SELECT count(*) FROM {gwas} g WHERE ID NOT IN (SELECT ID FROM {variants} v)) AS gwas_only, (SELECT count(*) FROM {variants} v WHERE ID NOT IN (SELECT ID FROM {gwas} g)) AS ld_only")
def unmatched(spark, sf):
    return _harmonized(spark, sf).agg(F.count_if(F.col("status") == "gwas_only").alias("gwas_only"), F.count_if(F.col("status") == "ld_only").alias("ld_only"))


@query("SELECT v.ID FROM {variants} v WHERE EXISTS (SELECT 1 FROM {gwas} g WHERE g.ID = v.ID)")
def eta_index_semi(spark, sf):
    return table(spark, sf, "variants").select("ID").join(table(spark, sf, "gwas").select("ID"), "ID", "left_semi")


# -- linkage disequilibrium -------------------------------------------------

_ISLANDS = """moves AS (SELECT parent, k, sum(d) AS d FROM (SELECT parent, j AS k, 1 AS d FROM {edges} e1 UNION ALL SELECT parent, i AS k, -1 AS d FROM {edges} e2) t GROUP BY parent, k),
runs AS (SELECT p.parent, p.ID, p.pos_in_ld, sum(coalesce(d, 0)) OVER (PARTITION BY p.parent ORDER BY p.pos_in_ld) AS open FROM {places} p LEFT JOIN moves m ON m.parent = p.parent AND m.k = p.pos_in_ld),
islands AS (SELECT parent, ID, pos_in_ld, CAST(coalesce(sum(CASE WHEN open = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY parent ORDER BY pos_in_ld ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS island FROM runs)"""


def _edges(spark, sf):
    return table(spark, sf, "edges").select("parent", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v")


def _islands(spark, sf):
    return L.contiguous_blocks(table(spark, sf, "places"), _edges(spark, sf))


@query(f"WITH {_ISLANDS} SELECT ID, parent, island FROM islands")
def ld_blocks(spark, sf):
    return _islands(spark, sf).select("ID", "parent", "island")


@query(f"WITH {_ISLANDS}, s AS (SELECT parent, island, count(*) AS predictors FROM islands GROUP BY parent, island) SELECT parent, island, predictors, CAST(sum(predictors) OVER (PARTITION BY parent ORDER BY island) - predictors AS bigint) AS first_place FROM s")
def ld_block_table(spark, sf):
    s = _islands(spark, sf).groupBy("parent", "island").agg(F.count("*").alias("predictors"))
    w = Window.partitionBy("parent").orderBy("island").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("first_place", F.sum("predictors").over(w) - F.col("predictors"))


def _local(spark, sf):
    at = _islands(spark, sf)
    name = F.concat_ws(".", "parent", F.col("island").cast("string"))
    sizes = at.groupBy(name.alias("block")).agg(F.count("*").alias("size"))
    e = _edges(spark, sf).join(at.select("parent", F.col("pos_in_ld").alias("i"), name.alias("block")), ["parent", "i"])
    return e, sizes


@query(f"""WITH {_ISLANDS}, s AS (SELECT concat(parent, '.', CAST(island AS string)) AS block, parent, island, count(*) AS size FROM islands GROUP BY parent, island),
c AS (SELECT x.parent, x.island, e.j, max(e.i) - e.j AS span, count(*) AS n FROM {{edges}} e JOIN islands x ON x.parent = e.parent AND x.pos_in_ld = e.i GROUP BY x.parent, x.island, e.j),
b AS (SELECT parent, island, sum(span) AS span, sum(n) AS n FROM c GROUP BY parent, island)
SELECT block, size, CAST(8 * coalesce(span, 0) + 4 * (size + 1) AS bigint) AS interval_bytes, CAST(12 * coalesce(n, 0) + 4 * (size + 1) AS bigint) AS indexed_bytes,
  CASE WHEN 8 * coalesce(span, 0) <= 12 * coalesce(n, 0) THEN 0 ELSE 1 END AS type FROM s LEFT JOIN b ON s.parent = b.parent AND s.island = b.island""")
def ld_storage_choice(spark, sf):
    e, sizes = _local(spark, sf)
    return L.storage(e.select("block", "i", "j"), sizes)


@query("SELECT parent, i, j, round(0.9 * v, 8) AS v FROM {edges} e")
def ld_shrink(spark, sf):
    shrink = 0.1
    return _edges(spark, sf).select("parent", "i", "j", F.round(F.when(F.col("i") == F.col("j"), 1.0).otherwise((1 - shrink) * F.col("v")), 8).alias("v"))


@query("""WITH p AS (SELECT parent, ID, pos_in_ld AS old, row_number() OVER (PARTITION BY parent ORDER BY pos_in_ld) - 1 AS k FROM {places} q WHERE EXISTS (SELECT 1 FROM {gwas} g WHERE g.ID = q.ID))
SELECT e.parent, CAST(a.k AS int) AS i, CAST(b.k AS int) AS j, round(e.v, 8) AS v FROM {edges} e JOIN p a ON a.parent = e.parent AND a.old = e.i JOIN p b ON b.parent = e.parent AND b.old = e.j""")
def ld_subset(spark, sf):
    ld = _ld(spark, sf)
    s = L.subset(ld, table(spark, sf, "gwas").select("ID"))
    at = s.variants.select("block", "place", "parent", "pos_in_ld")
    c = s.correlations().join(at.select("block", F.col("place").alias("i"), "parent", F.col("pos_in_ld").alias("pi")), ["block", "i"]).join(at.select("block", F.col("place").alias("j"), F.col("pos_in_ld").alias("pj")), ["block", "j"])
    return c.select("parent", F.col("pi").alias("i"), F.col("pj").alias("j"), F.round("v", 8).alias("v"))


def _ld(spark, sf) -> L.LD:
    v = table(spark, sf, "variants").join(table(spark, sf, "places").select("ID", "parent", "pos_in_ld"), "ID").drop("k")
    return L.build(v, _edges(spark, sf))


@query(f"""WITH {_ISLANDS}, s AS (SELECT parent, island, count(*) AS size FROM islands GROUP BY parent, island),
e AS (SELECT x.parent, x.island, count(*) AS n FROM {{edges}} e JOIN islands x ON x.parent = e.parent AND x.pos_in_ld = e.i GROUP BY x.parent, x.island)
SELECT s.parent, s.size AS predictors, CAST(coalesce(n, 0) AS bigint) AS correlations FROM s LEFT JOIN e ON e.parent = s.parent AND e.island = s.island""")
def ld_object(spark, sf):
    ld = _ld(spark, sf)
    n = ld.correlations().groupBy("block").agg(F.count("*").alias("n"))
    return ld.block_table().join(n, "block", "left").select("parent", "predictors", F.coalesce("n", F.lit(0)).alias("correlations"))


# Objects of two variants a supplier, whose eigenvalues are 1 - |r| and 1 + |r|
_OF_TWO = "(SELECT 'b' || CAST(s_suppkey AS string) AS block, (s_nationkey - 12.5) / 12.5 AS r FROM supplier)"


def _pairs(spark, sf):
    t = table(spark, sf, "supplier").select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("parent"), "s_suppkey", ((F.col("s_nationkey") - 12.5) / 12.5).alias("v"))
    side = lambda k: t.select(F.lit("1").alias("CHR"), F.concat("parent", F.lit(f"_{k}")).alias("ID"), (F.col("s_suppkey") * 2 + k + 1).cast("long").alias("POS"), F.lit("A").alias("A1"), F.lit("C").alias("A0"), "parent", F.lit(k).alias("pos_in_ld"))
    return L.build(side(0).unionByName(side(1)), t.select("parent", F.lit(1).alias("i"), F.lit(0).alias("j"), "v"))


@query(f"""SELECT block, CAST(2 AS int) AS predictors, CASE WHEN abs(r) = 1 THEN 'positive_semidefinite' ELSE 'positive_definite' END AS status, round(1 - abs(r), 8) AS minimum_eigenvalue, round(1 + abs(r), 8) AS maximum_eigenvalue,
abs(r) < 1 AS positive_definite FROM {_OF_TWO} p""")
def ld_diagnose_pairs(spark, sf):
    d = L.diagnose(_pairs(spark, sf))
    return d.select("block", "predictors", "status", F.abs(F.round("minimum_eigenvalue", 8)).alias("minimum_eigenvalue"), F.round("maximum_eigenvalue", 8).alias("maximum_eigenvalue"), "positive_definite")


@query(f"SELECT block, round(0.9 * r, 8) AS v, round(1 - abs(r), 8) AS low, round(1 - 0.9 * abs(r), 8) AS high FROM {_OF_TWO} p")
def ld_regularize_pairs(spark, sf):
    out = L.regularize(_pairs(spark, sf), "shrink", 0.1)
    c = out.correlations().select("block", F.round("v", 8).alias("v"))
    return c.join(out.report.select("block", F.abs(F.round("minimum_eigenvalue_before", 8)).alias("low"), F.round("minimum_eigenvalue_after", 8).alias("high")), "block")


@query(f"SELECT block, CAST(2 AS int) AS p, round(1 + abs(r), 8) AS largest, round(1 - abs(r), 8) AS smallest FROM {_OF_TWO} p")
def eigen_pairs(spark, sf):
    ld = _pairs(spark, sf)
    diagonal = ld.variants.select("block", F.col("place").alias("i"), F.col("place").alias("j"), F.lit(1.0).alias("v"))
    e = E.decompose_blocks(ld.correlations().unionByName(diagonal))
    return e.select("block", "p", F.round(F.array_max("values"), 8).alias("largest"), F.abs(F.round(F.array_min("values"), 8)).alias("smallest"))


@query("""SELECT n || '.' || CAST(k AS string) AS fitted_block, n || '.' || CAST(k AS string) AS source_block, CAST(3 - k AS int) AS fitted_predictors, round(1 - 0.9 * abs(r), 8) AS after
FROM (SELECT 'n' || CAST(n_nationkey AS string) AS n, (n_nationkey + 1) / 30.0 AS r FROM nation) x CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) y""")
def ld_report_map(spark, sf):
    """A parent of two blocks for each nation, repaired, and then without the last variant."""
    t = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent"), "n_nationkey", ((F.col("n_nationkey") + 1) / 30.0).alias("v"))
    v = t.select(F.lit("1").alias("CHR"), "parent", "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos_in_ld"))
    v = v.select("CHR", F.concat("parent", F.lit("_"), F.col("pos_in_ld").cast("string")).alias("ID"), (F.col("n_nationkey") * 4 + F.col("pos_in_ld") + 1).cast("long").alias("POS"), F.lit("A").alias("A1"), F.lit("C").alias("A0"), "parent", "pos_in_ld")
    e = t.select("parent", F.explode(F.array(F.lit(0), F.lit(2))).alias("j"), "v").select("parent", (F.col("j") + 1).alias("i"), "j", "v")
    ld = L.regularize(L.build(v, e), "shrink", 0.1)
    m = L.report_map(L.subset(ld, ld.variants.where("pos_in_ld < 3").select("ID")))
    return m.select("fitted_block", "source_block", "fitted_predictors", F.round("minimum_eigenvalue_after", 8).alias("after"))


@query()
def ld_diagnose(spark, sf):
    return rounded(L.diagnose(_ld(spark, sf)), minimum_eigenvalue=8, maximum_eigenvalue=8)


@query()
def ld_regularize(spark, sf):
    return rounded(L.regularize(_ld(spark, sf), "shrink", 0.1).report, minimum_eigenvalue_before=8, minimum_eigenvalue_after=8)


@query(f"""WITH {_ISLANDS}, s AS (SELECT concat(parent, '.', CAST(island AS string)) AS block, parent, count(*) AS size FROM islands GROUP BY parent, island)
SELECT block, size FROM s WHERE size <= 14 AND 40.0 * size * size / 1048576 <= 0.006""")
def ld_eligible(spark, sf):
    return L.eligible(_local(spark, sf)[1], 14, 0.006)


@query(f"""WITH {_ISLANDS}, p AS (SELECT concat(x.parent, '.', CAST(x.island AS string)) AS block, x.parent, x.pos_in_ld, CAST(row_number() OVER (PARTITION BY x.parent, x.island ORDER BY x.pos_in_ld) - 1 AS int) AS j FROM islands x),
n AS (SELECT parent, j, count(*) AS n FROM {{edges}} e GROUP BY parent, j)
SELECT block, p.j, CAST(coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY block ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM p LEFT JOIN n ON n.parent = p.parent AND n.j = p.pos_in_ld""")
def ld_pointers(spark, sf):
    at = _islands(spark, sf).withColumn("block", F.concat_ws(".", "parent", F.col("island").cast("string")))
    at = at.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("pos_in_ld")) - 1)
    side = lambda k: at.select("parent", F.col("pos_in_ld").alias(k), F.col("place").alias(f"p{k}"))
    e = _edges(spark, sf).join(at.select("parent", F.col("pos_in_ld").alias("i"), "block", F.col("place").alias("pi")), ["parent", "i"]).join(side("j"), ["parent", "j"])
    return L.pointers(e.select("block", F.col("pi").alias("i"), F.col("pj").alias("j")), at.groupBy("block").agg(F.count("*").alias("size")))


@query()
def eigen_blocks(spark, sf):
    ld = _ld(spark, sf)
    diagonal = ld.variants.select("block", F.col("place").alias("i"), F.col("place").alias("j"), F.lit(1.0).alias("v"))
    e = E.decompose_blocks(ld.correlations().select("block", "i", "j", "v").unionByName(diagonal))
    return e.select("block", "p", "q", F.round(F.array_max("values"), 8).alias("largest"), F.round(F.array_min("values"), 8).alias("smallest"))


# -- columns, alleles, sets -------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((CAST({c} AS double) - m{k}) / s{k}, 8) AS {c}" for k, c in enumerate(X)) + " FROM lineitem CROSS JOIN (SELECT " + ", ".join(f"avg(CAST({c} AS double)) AS m{k}, stddev_samp(CAST({c} AS double)) AS s{k}" for k, c in enumerate(X)) + " FROM lineitem) t")
def standardized_columns(spark, sf):
    out = G.working_columns(table(spark, sf, "lineitem"), X)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 8).alias(c) for c in X])


@query("SELECT ID, A1, A0 FROM {variants} v WHERE concat(A1, A0) IN ('AT', 'TA', 'CG', 'GC')")
def ambiguous_alleles(spark, sf):
    return table(spark, sf, "variants").where(W.palindromic(F.col("A1"), F.col("A0"))).select("ID", "A1", "A0")


@query("SELECT ID, CASE WHEN length(A1) = 1 THEN translate(A1, 'ACGT', 'TGCA') END AS other FROM {gwas} g")
def complement_alleles(spark, sf):
    return table(spark, sf, "gwas").select("ID", W.complement(F.col("A1")).alias("other"))


@query("SELECT ID, 'gwas' AS side FROM {gwas} g UNION ALL SELECT ID, 'ld' AS side FROM {variants} v")
def union_tables(spark, sf):
    return table(spark, sf, "gwas").select("ID", F.lit("gwas").alias("side")).unionByName(table(spark, sf, "variants").select("ID", F.lit("ld").alias("side")))


@query("SELECT (SELECT count(*) FROM (SELECT ID FROM {gwas} g EXCEPT SELECT ID FROM {variants} v) a) + (SELECT count(*) FROM (SELECT ID FROM {variants} v EXCEPT SELECT ID FROM {gwas} g) b) = 0 AS same_names, true AS same_as_itself")
def set_equality(spark, sf):
    g, v = (table(spark, sf, t).select("ID") for t in ("gwas", "variants"))
    return spark.createDataFrame([(G.same_names(g, v), G.same_names(g, g))], "same_names boolean, same_as_itself boolean")


@query(f"SELECT ID, round(beta * s / 2.0, 8) AS mean, round(1.0 / 4.0, 8) AS var FROM (SELECT ID, beta, CASE WHEN status = 'retained+1' THEN 1.0 ELSE -1.0 END AS s FROM ({_HARMONIZED}) t WHERE status LIKE 'retained%') u")
def back_transform(spark, sf):
    """Coefficients of a working scale of 2 turned back to the effects' own allele: signs change means, not variances."""
    kept = W.retained(_harmonized(spark, sf))
    scale = 2.0
    return kept.select("ID", F.round(F.col("g_BETA") * F.col("orientation") / scale, 8).alias("mean"), F.round(F.lit(1.0) / F.lit(scale**2), 8).alias("var"))


@query("""WITH g AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx, BETA, SE FROM {gwas} q), w AS (SELECT idx, sqrt(2.5 * 999.0 / (BETA * BETA / (SE * SE) + 998.0) / (SE * SE)) AS d FROM g)
SELECT CAST(a.idx AS int) AS i, CAST(b.idx AS int) AS j, round(CASE WHEN a.idx = b.idx THEN 1.0 ELSE 0.5 END * a.d * b.d, 3) AS v FROM w a JOIN w b ON b.idx = a.idx OR b.idx = a.idx + 1""")
def gwas_convert(spark, sf):
    rows = table(spark, sf, "gwas").withColumn("idx", (F.row_number().over(Window.orderBy("k")) - 1).cast("int"))
    own = rows.select(F.lit("a").alias("block"), F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("v"))
    top = rows.agg(F.max("idx")).first()[0]
    next_ = rows.where(F.col("idx") < top).select(F.lit("a").alias("block"), F.col("idx").alias("i"), (F.col("idx") + 1).alias("j"), F.lit(0.5).alias("v"))
    g, _ = W.convert(rows, own.unionByName(next_), 1000, beta="BETA", se="SE", scale="original", response_var=2.5)
    return g.select("i", "j", F.round("v", 3).alias("v"))


# -- draws ------------------------------------------------------------------

def _long(spark, sf):
    return table(spark, sf, "draws").withColumn("param", F.lit("value"))


@query("SELECT chain, draw, CAST((draw - 51) // 7 AS int) AS kept FROM {draws} d WHERE draw > 50 AND (draw - 51) % 7 = 0")
def thin_burnin(spark, sf):
    return P.thin(table(spark, sf, "draws"), 50, 7).select("chain", "draw", "kept")


@query("SELECT chain, count(*) AS n, round(avg(value), 9) AS mean, round(var_samp(value), 7) AS var FROM {draws} d GROUP BY chain")
def welford_vs_var(spark, sf):
    import pandas as pd

    from .plans.kernel import Online

    def one(pdf):
        o = Online()
        for x in pdf.sort_values("draw")["value"]:
            o.add(np.array([x]))
        return pd.DataFrame({"chain": [pdf["chain"].iloc[0]], "n": [o.n], "mean": [o.mean[0]], "var": [o.m2[0] / (o.n - 1)]})

    return rounded(table(spark, sf, "draws").groupBy("chain").applyInPandas(one, "chain long, n long, mean double, var double"), mean=9, var=7)


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM {draws} d")
def chan_merge(spark, sf):
    per = _long(spark, sf).groupBy("param", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_samp("value") * (F.count("*") - 1)).alias("m2"))
    return P.merge_moments(per, ["param"]).select("n", F.round("mean", 6).alias("mean"), F.round(P.variance("n", "m2"), 4).alias("var"))


def _wide(spark, sf):
    """Each chain as a coefficient: (chain, draw, idx, value) of one chain."""
    return table(spark, sf, "draws").select(F.lit(1).alias("chain"), "draw", F.col("chain").cast("int").alias("idx"), "value", "kind")


@query("SELECT 'b' || CAST(a.chain // 2 AS string) AS block, CAST(a.chain AS int) AS i, CAST(b.chain AS int) AS j, round(covar_samp(a.value, b.value), 4) AS cov FROM {draws} a JOIN {draws} b ON a.draw = b.draw AND a.chain <= b.chain AND a.chain // 2 = b.chain // 2 GROUP BY 1, 2, 3")
def cov_from_draws(spark, sf):
    block = spark.createDataFrame([(i, f"b{i // 2}") for i in range(4)], "idx int, block string")
    return rounded(P.covariances(_wide(spark, sf), block), cov=4)


@query("SELECT CAST(chain AS int) AS idx, round(avg(CASE WHEN kind > 0 THEN 1.0 ELSE 0.0 END), 8) AS inclusion FROM {draws} d GROUP BY chain")
def inclusion_prob(spark, sf):
    arrays = _wide(spark, sf).groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", (F.col("kind") > 0).alias("on")))), lambda x: x["on"]).alias("inclusion"))
    return P.inclusion(arrays).select(F.col("idx").cast("int").alias("idx"), F.round("inclusion", 8).alias("inclusion"))


@query("SELECT CAST(chain AS int) AS idx, " + ", ".join(f"round(avg(CASE WHEN kind = {k} THEN 1.0 ELSE 0.0 END), 8) AS component_{k}" for k in range(3)) + ", round(1 - avg(CASE WHEN kind = 0 THEN 1.0 ELSE 0.0 END), 8) AS inclusion FROM {draws} d GROUP BY chain")
def component_prob(spark, sf):
    out = P.component_shares(_wide(spark, sf).withColumn("component", F.col("kind")), 3)
    return rounded(out, component_0=8, component_1=8, component_2=8, inclusion=8)


@query("SELECT CAST(chain AS int) AS idx, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS \"q{100 * p:g}\"" for p in (0.025, 0.5, 0.975)) + " FROM {draws} d GROUP BY chain")
def coef_quantiles(spark, sf):
    out = P.summarize(_wide(spark, sf), ["idx"])
    return out.select("idx", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "idx"])


@query("SELECT l_suppkey AS idx, round(avg(CAST(l_discount AS double)) - 0.05, 8) AS mean FROM lineitem GROUP BY l_suppkey ORDER BY abs(avg(CAST(l_discount AS double)) - 0.05) DESC NULLS LAST, l_suppkey LIMIT 20")
def summary_topk(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("idx")).agg((F.avg(F.col("l_discount").cast("double")) - 0.05).alias("mean"))
    return rounded(P.top(s, 20), mean=8)


@query("SELECT p_brand AS block, count(*) AS predictors, round(sum(p_size / 50.0), 6) AS expected_included, round(avg(p_size / 50.0), 8) AS mean_inclusion FROM part GROUP BY p_brand")
def block_summary(spark, sf):
    p = table(spark, sf, "part")
    out = P.block_summary(p.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("block")), p.select(F.col("p_partkey").alias("idx"), (F.col("p_size") / 50.0).alias("inclusion")))
    return rounded(out, expected_included=6, mean_inclusion=8)


@query("SELECT 'value' AS param, round(sqrt(((m - 1) / m * w + b) / w), 8) AS rhat FROM (SELECT avg(w) AS w, var_samp(mu) AS b, CAST(min(m) AS double) AS m FROM (SELECT avg(value) AS mu, var_samp(value) AS w, count(*) AS m FROM {draws} d GROUP BY chain) c) t")
def rhat(spark, sf):
    return rounded(D.rhat(_long(spark, sf)), rhat=8)


_QUAD = "(SELECT 0 AS i, 0 AS j, 2.0 AS v UNION ALL SELECT 0, 1, 0.5 UNION ALL SELECT 1, 1, 3.0 UNION ALL SELECT 1, 2, -0.25 UNION ALL SELECT 2, 2, 1.5 UNION ALL SELECT 2, 3, 0.75 UNION ALL SELECT 3, 3, 2.5)"


@query(f"""WITH g AS (SELECT i, j, v FROM {_QUAD} a UNION ALL SELECT j, i, v FROM {_QUAD} b WHERE i <> j),
t AS (SELECT x.draw, x.chain // 2 AS bi, y.chain // 2 AS bj, g.v * x.value * y.value AS w FROM g JOIN {{draws}} x ON x.chain = g.i JOIN {{draws}} y ON y.chain = g.j AND y.draw = x.draw)
SELECT draw, 'b' || CAST(bi AS string) AS block, round(sum(w), 6) AS along, round(sum(CASE WHEN bi = bj THEN w ELSE 0.0 END), 6) AS own FROM t GROUP BY draw, bi""")
def pve_from_draws(spark, sf):
    g = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.5), (1, 1, 3.0), (1, 2, -0.25), (2, 2, 1.5), (2, 3, 0.75), (3, 3, 2.5)], "i int, j int, v double")
    p = spark.createDataFrame([(i, f"b{i // 2}") for i in range(4)], "idx int, block string")
    return rounded(P.quadratic(_wide(spark, sf).select("draw", "idx", "value"), F.broadcast(g), F.broadcast(p)), along=6, own=6)


@query("SELECT l_orderkey, l_linenumber, round(100.0 + 950.5 * l_quantity + -20.25 * l_discount + 3.5 * l_tax, 4) AS fit FROM lineitem")
def predict_point(spark, sf):
    fit_ = R.linear(100.0, {"l_quantity": 950.5, "l_discount": -20.25, "l_tax": 3.5})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(fit_, 4).alias("fit"))


@query("""WITH d AS (SELECT draw, max(CASE WHEN chain = 0 THEN value END) AS b0, max(CASE WHEN chain = 1 THEN value END) AS b1 FROM {draws} q GROUP BY draw)
SELECT s_suppkey, round(avg(1.0 + b0 * s_nationkey + b1 * s_acctbal / 1000), 4) AS fit, round(quantile_cont(1.0 + b0 * s_nationkey + b1 * s_acctbal / 1000, 0.025), 4) AS lower, round(quantile_cont(1.0 + b0 * s_nationkey + b1 * s_acctbal / 1000, 0.975), 4) AS upper
FROM supplier CROSS JOIN d GROUP BY s_suppkey""")
def predict_credible(spark, sf):
    w = table(spark, sf, "draws").groupBy("draw").agg(F.max(F.when(F.col("chain") == 0, F.col("value"))).alias("b0"), F.max(F.when(F.col("chain") == 1, F.col("value"))).alias("b1"))
    d = w.select(F.lit(1).alias("chain"), "draw", F.lit(1.0).alias("intercept"), F.lit(1.0).alias("residual_var"), F.array("b0", "b1").alias("theta"))
    new = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal").cast("double") / 1000).alias("b"))
    return rounded(R.predict(new, d, ["a", "b"], "credible").select("s_suppkey", "fit", "lower", "upper"), fit=4, lower=4, upper=4)


@query("SELECT round(sum(t) / sum(t / s), 10) AS prop_var FROM (SELECT sum(p_retailprice) AS t, 0.9 + min(p_size) / 1000.0 AS s FROM part GROUP BY p_brand) x")
def prop_var_agg(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.sum(F.col("p_retailprice").cast("double")).alias("t"), (0.9 + F.min("p_size") / 1000.0).alias("s"))
    return rows.agg(F.round(F.sum("t") / F.sum(F.col("t") / F.col("s")), 10).alias("prop_var"))


@query("SELECT 'all::' || CAST(chain AS string) AS label, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM {draws} d GROUP BY chain")
def coef_labels(spark, sf):
    arrays = _wide(spark, sf).groupBy("chain", "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("theta"))
    return P.coefficients(arrays).select(F.concat_ws("::", F.lit("all"), F.col("idx").cast("string")).alias("label"), F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


# -- chains with given noise ------------------------------------------------

def lcg_noise(iteration: int, j: int) -> float:
    """A fixed table of normal-like numbers that integer arithmetic gives in any engine."""
    a = (iteration * 7919 + j * 104729 + 12345) % 65536
    b = (a * 25173 + 13849) % 65536
    return (a + b) / 65536.0 - 1.0


_INJECTED = """WITH RECURSIVE m AS (SELECT var_samp(CAST(l_quantity AS double)) AS vx, var_samp(CAST(l_tax AS double)) AS vt, covar_samp(CAST(l_quantity AS double), CAST(l_tax AS double)) AS vxt, covar_samp(CAST(l_quantity AS double), CAST(l_extendedprice AS double)) AS cx, covar_samp(CAST(l_tax AS double), CAST(l_extendedprice AS double)) AS ct, count(*) - 1 AS n FROM lineitem),
g AS (SELECT CAST(n AS double) AS n, n * vxt / sqrt(vx * vt) AS r, n * cx / sqrt(vx) / 1000 AS gx, n * ct / sqrt(vt) / 1000 AS gt, sqrt(vx) AS sx, sqrt(vt) AS st, 1 / (n / 4.0 + {prior}) AS v FROM m),
z AS (SELECT i, (a0 + (a0 * 25173 + 13849) % 65536) / 65536.0 - 1.0 AS z0, (a1 + (a1 * 25173 + 13849) % 65536) / 65536.0 - 1.0 AS z1 FROM (SELECT i, (i * 7919 + 12345) % 65536 AS a0, (i * 7919 + 104729 + 12345) % 65536 AS a1 FROM range(1, 301) t(i)) q),
c AS (SELECT 0 AS i, CAST(0 AS double) AS x, CAST(0 AS double) AS t UNION ALL
  SELECT i, x2 AS x, v * (gt - r * x2) / 4.0 + sqrt(v) * z1 AS t FROM (SELECT z.i, z.z1, g.*, g.v * (g.gx - g.r * c.t) / 4.0 + sqrt(g.v) * z.z0 AS x2 FROM c JOIN z ON z.i = c.i + 1 CROSS JOIN g) s)
SELECT CAST(c.i - 101 AS int) AS draw, round(x / sx, 7) AS b_quantity, round(t / st, 4) AS b_tax FROM c CROSS JOIN g WHERE c.i > 100"""


def _injected(spark, sf, block):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_tax", (F.col(Y).cast("double") / 1000).alias("y"))
    f = fit(df, "y", {**block, "columns": ["l_quantity", "l_tax"]}, noise=lcg_noise, residual_var=4.0, iterations=300, burnin=100)
    return f.draws.select("draw", F.round(F.col("theta")[0], 7).alias("b_quantity"), F.round(F.col("theta")[1], 4).alias("b_tax"))


@query()
def chain_normal_injected(spark, sf):
    return _injected(spark, sf, {"model": "Normal", "var": 0.5})


@query()
def chain_fixed_injected(spark, sf):
    return _injected(spark, sf, {"model": "Fixed"})


_KW = {"noise": lcg_noise, "residual_var": 4.0, "iterations": 300, "burnin": 100}
_TWO = ("l_quantity", "l_tax")


def _lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _TWO], (F.col(Y).cast("double") / 1000).alias("y"))


def _two(f) -> DataFrame:
    return f.draws.select("draw", F.round(F.col("theta")[0], 7).alias("b_quantity"), F.round(F.col("theta")[1], 4).alias("b_tax"))


def _normal(**more):
    return {"model": "Normal", "var": 0.5, **more}


@query()
def chain_array_injected(spark, sf):
    df = _lines(spark, sf).select("y", F.array(*_TWO).alias("x"))
    return _two(fit_array(df, "y", "x", _normal(), **_KW))


@query()
def chain_ss_injected(spark, sf):
    """From raw cross-products with means."""
    s = G.from_observations(_lines(spark, sf), "y", list(_TWO))
    raw = s.gram + s.n * np.outer(s.x_means, s.x_means)
    return _two(fit_ss(spark, s.n, raw, s.xty + s.n * s.x_means * s.y_mean, _normal(), yty=s.yty + s.n * s.y_mean**2, x_means=s.x_means, y_mean=s.y_mean, **_KW))


@query()
def chain_sparse_injected(spark, sf):
    """From triplets with an implicit centre."""
    df = _lines(spark, sf)
    r = df.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(_TWO)], *[F.sum(F.col(c) * F.col("y")).alias(f"g{i}") for i, c in enumerate(_TWO)]).first()
    p = spark.createDataFrame([(i, c, r[f"g{i}"], r[f"m{i}"]) for i, c in enumerate(_TWO)], "idx int, name string, xty double, x_mean double")
    return _two(fit_sparse(spark, r["n"], G.raw_triplets(df, _TWO), p, _normal(), y_mean=r["y"], **_KW))


@query()
def chain_eigen_injected(spark, sf):
    """From all eigenpairs."""
    s = G.from_observations(_lines(spark, sf), "y", list(_TWO))
    u, lam = E.decompose(s.gram)
    return _two(fit_eigen(spark, s.n, u, lam, 1.0, s.xty, _normal(), **_KW))


@query()
def chain_joint_injected(spark, sf):
    """All coefficients of a block at once: means and Cholesky factor of a block of two."""
    f = fit(_lines(spark, sf), "y", _normal(columns=list(_TWO)), joint=True, **_KW)
    return _two(f)


ORACLE_SQL["chain_normal_injected"] = _INJECTED.replace("{prior}", "1 / 0.5")
ORACLE_SQL["chain_fixed_injected"] = _INJECTED.replace("{prior}", "0.0")
for _name in ("array", "ss", "sparse", "eigen"):
    ORACLE_SQL[f"chain_{_name}_injected"] = ORACLE_SQL["chain_normal_injected"]
#: A = G / 4 + 2 I = L L'; the draw is A^-1 g / 4 + L'^-1 z.
ORACLE_SQL["chain_joint_injected"] = _INJECTED[: _INJECTED.index("c AS (SELECT 0")].replace("{prior}", "0.0").rstrip(",\n ") + """,
l AS (SELECT sqrt(n / 4 + 2) AS a, r / 4 / sqrt(n / 4 + 2) AS b, sqrt(n / 4 + 2 - (r / 4) * (r / 4) / (n / 4 + 2)) AS c, (n / 4 + 2) * (n / 4 + 2) - r * r / 16 AS det FROM g)
SELECT CAST(i - 101 AS int) AS draw, round((((n / 4 + 2) * gx / 4 - r / 4 * gt / 4) / det + z0 / a - b * z1 / (a * c)) / sx, 7) AS b_quantity, round((((n / 4 + 2) * gt / 4 - r / 4 * gx / 4) / det + z1 / c) / st, 4) AS b_tax
FROM z CROSS JOIN g CROSS JOIN l WHERE i > 100"""


_MOMENTS = f"WITH d AS ({_INJECTED.replace('{prior}', '1 / 0.5').replace('round(x / sx, 7)', 'x / sx').replace('round(t / st, 4)', 't / st')}) "


def _running(spark, sf):
    return fit(_lines(spark, sf), "y", _normal(columns=list(_TWO)), store="moments", **_KW)


@query(_MOMENTS + "SELECT CAST(1 AS int) AS position, 'l_quantity' AS label, round(avg(b_quantity), 7) AS mean FROM d UNION ALL SELECT 2, 'l_tax', round(avg(b_tax), 4) FROM d")
def moments_coef(spark, sf):
    c = _running(spark, sf).coef().where("position > 0")
    return c.select("position", "label", F.when(F.col("position") == 1, F.round("mean", 7)).otherwise(F.round("mean", 4)).alias("mean"))


@query(_MOMENTS + "SELECT 'l_quantity' AS label, round(avg(b_quantity), 7) AS mean, round(stddev_samp(b_quantity), 8) AS sd FROM d UNION ALL SELECT 'l_tax', round(avg(b_tax), 4), round(stddev_samp(b_tax), 5) FROM d")
def moments_summary(spark, sf):
    c = _running(spark, sf).summary()["coefficients"]
    small = F.col("label") == "l_quantity"
    return c.select("label", F.when(small, F.round("mean", 7)).otherwise(F.round("mean", 4)).alias("mean"), F.when(small, F.round("sd", 8)).otherwise(F.round("sd", 5)).alias("sd"))


@query(_MOMENTS + "SELECT l_orderkey, l_linenumber, round(l_quantity * q + l_tax * t, 4) AS fit FROM lineitem CROSS JOIN (SELECT avg(b_quantity) AS q, avg(b_tax) AS t FROM d) m")
def moments_predict(spark, sf):
    """Point predictions from moments, less the intercept, whose noise is not given."""
    f = _running(spark, sf)
    mu = f.coef().where("position = 0").first()["mean"]
    new = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_TWO)
    return f.predict(new).select("l_orderkey", "l_linenumber", F.round(F.col("fit") - F.lit(mu), 4).alias("fit"))


_GWAS = (
    _INJECTED.replace("count(*) - 1 AS n FROM lineitem)", "var_samp(CAST(l_extendedprice AS double)) AS vy, count(*) - 1 AS n FROM lineitem),\nb AS (SELECT n, vxt / sqrt(vx * vt) AS rho, cx / vx AS bx, ct / vt AS bt, sqrt((n * vy - cx / vx * n * cx) / (n - 1) / (n * vx)) AS ex, sqrt((n * vy - ct / vt * n * ct) / (n - 1) / (n * vt)) AS et FROM m)")
    .replace("n * vxt / sqrt(vx * vt) AS r, n * cx / sqrt(vx) / 1000 AS gx, n * ct / sqrt(vt) / 1000 AS gt, sqrt(vx) AS sx, sqrt(vt) AS st, 1 / (n / 4.0 + {prior}) AS v FROM m)",
             "n * rho AS r, sqrt(n) * sqrt(n / (bx / ex * bx / ex + n - 1)) * bx / ex AS gx, sqrt(n) * sqrt(n / (bt / et * bt / et + n - 1)) * bt / et AS gt, CAST(1 AS double) AS sx, CAST(-1 AS double) AS st, 1 / (n / 4.0 + 1 / 0.5) AS v FROM b)")
)


@query()
def chain_gwas_injected(spark, sf):
    """Marginal effects and an LD object of two variants, the second with its alleles the other way round."""
    import warnings

    r = table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), *[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate((*_TWO, Y))],
        *[F.covar_samp(F.col(c).cast("double"), F.col(Y).cast("double")).alias(f"c{i}") for i, c in enumerate(_TWO)], F.corr(*[F.col(c).cast("double") for c in _TWO]).alias("r"),
    ).first()
    n = r["n"]
    beta = [r[f"c{i}"] / r[f"v{i}"] for i in range(2)]
    se = [float(np.sqrt(((n - 1) * r["v2"] - beta[i] * (n - 1) * r[f"c{i}"]) / (n - 2) / ((n - 1) * r[f"v{i}"]))) for i in range(2)]
    v = spark.createDataFrame([("1", "a", 1, "A", "C", "p", 0), ("1", "b", 2, "A", "G", "p", 1)], "CHR string, ID string, POS long, A1 string, A0 string, parent string, pos_in_ld int")
    ld = L.build(v, spark.createDataFrame([("p", 1, 0, r["r"])], "parent string, i int, j int, v double"))
    g = spark.createDataFrame([("1", "a", 1, "A", "C", n, beta[0], se[0]), ("1", "b", 2, "G", "A", n, -beta[1], se[1])], "CHR string, ID string, POS long, A1 string, A0 string, N long, BETA double, SE double")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _two(fit_gwas(g, ld, _normal(), **_KW))


ORACLE_SQL["chain_gwas_injected"] = _GWAS


# -- fits -------------------------------------------------------------------

def _summary(f) -> DataFrame:
    return P.summarize(P.long_theta(f.draws), ["idx"]).join(f.predictors, "idx").select("label", "mean", "sd", F.col("`q2.5`").alias("low"), F.col("`q97.5`").alias("high"))


_RUN = {"iterations": 600, "burnin": 200, "chains": 2, "seed": 7}


def _lineitem_fit(spark, sf, pve=False, **block):
    df = table(spark, sf, "lineitem").withColumn("y", F.col(Y).cast("double") / 1000)
    return fit(df, "y", {**block, "columns": list(X)}, residual_shape=3.0, residual_scale=100.0, pve=pve, **_RUN)


@query()
def fit_lineitem_normal(spark, sf):
    return _summary(_lineitem_fit(spark, sf, model="Normal"))


@query()
def fit_spikeslab(spark, sf):
    return _summary(_lineitem_fit(spark, sf, model="SpikeSlab"))


@query()
def fit_globallocal(spark, sf):
    return _summary(_lineitem_fit(spark, sf, model="GlobalLocal"))


@query()
def fit_multislab(spark, sf):
    return _summary(_lineitem_fit(spark, sf, model="SpikeMultiSlab"))


@query()
def fit_fixed(spark, sf):
    return _summary(_lineitem_fit(spark, sf, model="Fixed"))


@query()
def fit_moments_only(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("y", F.col(Y).cast("double") / 1000)
    f = fit(df, "y", {"model": "Normal", "columns": list(X)}, residual_shape=3.0, residual_scale=100.0, store="moments", **_RUN)
    return P.merge_moments(f.moments, ["param", "idx"])


@query()
def fit_embeddings(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    return _summary(fit_array(df, "y", "embedding", {"model": "SpikeMultiSlab"}, residual_shape=3.0, residual_scale=1.0, **(_RUN | {"iterations": 300, "burnin": 100})))


@query()
def fit_embeddings_ss(spark, sf):
    s = G.from_observations(table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double")), "y", "embedding")
    f = fit_ss(spark, s.n, s.gram, s.xty, {"a": {"model": "SpikeSlab", "indices": list(range(32))}, "b": {"model": "Normal", "indices": list(range(32, 64))}}, yty=s.yty, likelihood=s.n - 1, residual_shape=3.0, residual_scale=1.0, **(_RUN | {"iterations": 300, "burnin": 100}))
    return _summary(f)


@query()
def fit_embeddings_eigen(spark, sf):
    s = G.from_observations(table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double")), "y", "embedding")
    u, lam = E.decompose(s.gram)
    f = fit_eigen(spark, s.n, u[:, :48], lam[:48], float(lam[:48].sum() / lam.sum()), s.xty, {"model": "Normal"}, yty=s.yty, likelihood=s.n - 1, residual_shape=3.0, residual_scale=1.0, **(_RUN | {"iterations": 300, "burnin": 100}))
    return _summary(f)


@query()
def fit_sparse_triplets(spark, sf):
    p, n, y = _predictors(spark, sf)
    yty = table(spark, sf, "lineitem").agg(F.sum(F.col(Y).cast("double") ** 2).alias("v")).first()["v"]
    f = fit_sparse(spark, n, G.raw_triplets(table(spark, sf, "lineitem"), X), p, {"model": "Normal", "var": 1e6}, yty=yty, y_mean=y, residual_shape=3.0, residual_scale=1e8, **_RUN)
    return _summary(f)


@query()
def fit_gwas_blocks(spark, sf):
    ld = _ld(spark, sf)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        f = fit_gwas(table(spark, sf, "gwas").drop("k"), ld, {"model": "Normal", "var": 0.01}, residual_var=1.0, iterations=60, burnin=20, seed=3)
    return _summary(f)


@query()
def pve_posterior(spark, sf):
    f = _lineitem_fit(spark, sf, pve=True, model="Normal")
    return P.summarize(P.pve_long(f.draws, [b.name for b in f.blocks]), ["param"])


@query()
def predict_interval(spark, sf):
    f = _lineitem_fit(spark, sf, model="Normal")
    new = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *X)
    return R.predict(new, P.thin(f.draws, 0, 8), list(X), "prediction")


@query("SELECT 'h' || CAST(chain AS string) AS param, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM {draws} d GROUP BY chain")
def hyper_summary(spark, sf):
    d = _wide(spark, sf).groupBy("chain", "draw").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("h"), F.col("idx").cast("string")), "value"))).alias("hyper"), F.lit(1.0).alias("residual_var"))
    out = P.summarize(P.hyper_long(d).where("param <> 'residual_var'"), ["param"], (0.25, 0.75))
    return out.select("param", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "q25", "q75")])


@query("""WITH p AS (SELECT draw, chain, abs(value) / 1000 AS x FROM {draws} d), r AS (SELECT draw, max(CASE WHEN chain = 0 THEN x END) AS a, max(CASE WHEN chain = 1 THEN x END) AS b, max(CASE WHEN chain = 2 THEN x END) AS t FROM p GROUP BY draw)
SELECT param, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd FROM (SELECT 'a' AS param, a AS x FROM r UNION ALL SELECT 'b', b FROM r UNION ALL SELECT 'Total', t FROM r UNION ALL SELECT 'Cross-block', t - (a + b) FROM r) u GROUP BY param""")
def pve_summary(spark, sf):
    x = F.abs("value") / 1000
    pick = lambda k: F.max(F.when(F.col("idx") == k, x))
    d = _wide(spark, sf).groupBy("chain", "draw").agg(F.array(pick(0), pick(1)).alias("pve_standalone"), pick(2).alias("pve_total"))
    out = P.summarize(P.pve_long(d, ["a", "b"]), ["param"], (0.5,))
    return out.select("param", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


@query()
def fit_summary(spark, sf):
    return _lineitem_fit(spark, sf, pve=True, model="SpikeSlab").summary()["coefficients"]


@query()
def fit_convergence(spark, sf):
    return _lineitem_fit(spark, sf, pve=True, model="GlobalLocal").assess_convergence()


@query()
def convergence(spark, sf):
    return D.assess(_long(spark, sf).withColumn("chain", F.col("chain").cast("int")))


#: Yule-Walker by Levinson's recursion on the autocovariances ``g`` of whole chains, their beginnings and their ends; the order is
#: the least by AIC.  Lists count from 1, so ``g[k + 1]`` is the autocovariance at lag k.
_SPECTRUM = """WITH RECURSIVE d0 AS (SELECT chain, value, row_number() OVER (PARTITION BY chain ORDER BY draw) AS t, count(*) OVER (PARTITION BY chain) AS m FROM {draws} d),
parts AS (SELECT chain, 'all' AS part, t, value FROM d0 UNION ALL SELECT chain, 'first', t, value FROM d0 WHERE t <= greatest(2, ceil(CAST(0.1 AS double) * m)) UNION ALL SELECT chain, 'last', t, value FROM d0 WHERE t > m - floor(CAST(0.5 AS double) * m)),
means AS (SELECT chain, part, count(*) AS n, avg(value) AS mu, var_samp(value) AS s2, CAST(least(count(*) - 1, floor(10 * log10(count(*)))) AS int) AS most FROM parts GROUP BY chain, part),
centred AS (SELECT p.chain, p.part, p.t, p.value - s.mu AS c FROM parts p JOIN means s ON s.chain = p.chain AND s.part = p.part),
lags AS (SELECT s.chain, s.part, s.n, s.most, k.k FROM means s JOIN range(0, 200) k(k) ON k.k <= s.most),
acov AS (SELECT l.chain, l.part, l.k, sum(a.c * b.c) / max(l.n) AS v FROM lags l JOIN centred a ON a.chain = l.chain AND a.part = l.part JOIN centred b ON b.chain = a.chain AND b.part = a.part AND b.t = a.t + l.k GROUP BY l.chain, l.part, l.k),
g AS (SELECT a.chain, a.part, max(s.n) AS n, max(s.most) AS most, list(a.v ORDER BY a.k) AS g FROM acov a JOIN means s ON s.chain = a.chain AND s.part = a.part GROUP BY a.chain, a.part),
ar AS (SELECT chain, part, n, most, g, 0 AS k, g[1] AS var, CAST([] AS double[]) AS phi, n * ln(g[1]) AS aic FROM g UNION ALL
  SELECT chain, part, n, most, g, k + 1 AS k, var * (1 - r * r) AS var, list_append(list_transform(phi, lambda x, i: x - r * phi[k + 1 - i]), r) AS phi, n * ln(var * (1 - r * r)) + 2 * (k + 1) AS aic
  FROM (SELECT ar.*, (g[k + 2] - coalesce(list_sum(list_transform(phi, lambda x, i: x * g[k + 2 - i])), 0)) / var AS r FROM ar WHERE k < most) q),
best AS (SELECT chain, part, n, k, var, phi, row_number() OVER (PARTITION BY chain, part ORDER BY aic, k) AS place FROM ar),
spec AS (SELECT b.chain, b.part, b.n, s.mu, s.s2, b.var * b.n / (b.n - (b.k + 1)) / power(1 - coalesce(list_sum(b.phi), 0), 2) AS s0 FROM best b JOIN means s ON s.chain = b.chain AND s.part = b.part WHERE place = 1)
"""


@query(_SPECTRUM + """SELECT 'value' AS param, CAST(w.chain AS int) AS chain, round((a.mu - b.mu) / sqrt(a.s0 / a.n + b.s0 / b.n), 6) AS geweke, round(w.n * w.s2 / w.s0, 4) AS ess
FROM spec w JOIN spec a ON a.chain = w.chain JOIN spec b ON b.chain = w.chain WHERE w.part = 'all' AND a.part = 'first' AND b.part = 'last'""")
def chain_diagnostics(spark, sf):
    """Geweke z and effective size of each chain."""
    return rounded(D.per_chain(_long(spark, sf).withColumn("chain", F.col("chain").cast("int"))), geweke=6, ess=4)
