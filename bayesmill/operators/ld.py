"""Linkage-disequilibrium objects: correlations of variants in exactly independent blocks.

An object is three tables and a manifest: ``variants`` (the variant table with
parent, block and place), ``blocks`` (a row for each block: its strictly lower
triangle by columns, the unit diagonal implied) and ``report`` (repairs).  All
are DataFrames; matrices exist only inside a task, one block at a time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.planner import compression
from ..plans.spec import SpecError, number, whole
from ..sources.quality import DataError, check_variants, duplicated, some
from .gram import ROOT_EPS

FORMAT_VERSION = 1
DIAGONAL_SLACK = 1e-6
BLOCK_SCHEMA = "name string, parent string, size int, type int, data array<double>, indptr array<int>, row_index array<int>"
REPORT_SCHEMA = (
    "block string, source_block string, parent string, predictors int, method string, shrink double, floor_shrink double, "
    "minimum_eigenvalue_before double, minimum_eigenvalue_after double, positive_definite_after boolean"
)
DIAGNOSIS_SCHEMA = "block string, predictors int, status string, minimum_eigenvalue double, maximum_eigenvalue double, positive_definite boolean, minimum_shrink double"


# -- compressed triangles ---------------------------------------------------

def compress_cells(p: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> dict:
    """A block's strict lower triangle from its non-zeros: type 0 keeps each column's run below the diagonal, type 1 the non-zeros and their rows."""
    order = np.lexsort((i, j))
    i, j, v = (np.asarray(x)[order] for x in (i, j, v))
    last = np.arange(p)
    np.maximum.at(last, j, i)
    kind, _ = compression(p, int((last - np.arange(p)).sum()), len(v))
    sizes = last - np.arange(p) if kind == 0 else np.bincount(j, minlength=p)
    ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.asarray(v, float)
    if kind == 0:
        data = np.zeros(ptr[-1])
        data[ptr[j] + i - j - 1] = v
    return {"size": p, "type": kind, "data": data, "indptr": ptr, "row_index": np.asarray(i, np.int32) if kind else None}


def compress(lower: np.ndarray) -> dict:
    """The same of a matrix, of which only what lies below the diagonal counts."""
    i, j = np.nonzero(np.tril(lower, -1))
    return compress_cells(len(lower), i, j, lower[i, j])


def columns(block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of each column of the strict lower triangle."""
    ptr, data = np.asarray(block["indptr"], int), np.asarray(block["data"], float)
    out = []
    for j in range(int(block["size"])):
        a, b = ptr[j], ptr[j + 1]
        r = np.asarray(block["row_index"][a:b], np.int64) if block["type"] else np.arange(j + 1, j + 1 + b - a)
        out.append((r, data[a:b]))
    return out


def dense(block) -> np.ndarray:
    m = np.eye(int(block["size"]))
    for j, (r, v) in enumerate(columns(block)):
        m[r, j] = m[j, r] = v
    return m


def check_block(block) -> None:
    """The invariants of a stored block."""
    p, ptr, n = int(block["size"]), list(block["indptr"]), len(block["data"])
    ok = p >= 1 and block["type"] in (0, 1) and len(ptr) == p + 1 and ptr[0] == 0 and ptr[-1] == n and all(a <= b for a, b in zip(ptr, ptr[1:], strict=False))
    if ok and block["type"] == 1:
        ri = [] if block["row_index"] is None else list(block["row_index"])
        ok = len(ri) == n and all(j < x < p for j in range(p) for x in ri[ptr[j] : ptr[j + 1]]) and all(a < b for j in range(p) for a, b in zip(ri[ptr[j] : ptr[j + 1]], ri[ptr[j] + 1 : ptr[j + 1]], strict=False))
    elif ok:
        ok = all(j + ptr[j + 1] - ptr[j] < p for j in range(p))
    if not ok or not all(np.isfinite(block["data"])) or any(abs(x) > 1 + ROOT_EPS for x in block["data"]):
        raise DataError(f"block {block['name']} is damaged")


def _steps(ptr: np.ndarray, limit: int = 1 << 18):
    """Ranges of columns of at most ``limit`` entries, or one larger."""
    a, p = 0, len(ptr) - 1
    while a < p:
        z = min(p, max(a + 1, int(np.searchsorted(ptr, ptr[a] + limit, "right")) - 1))
        yield a, z
        a = z


# -- blocks by gaps and islands ---------------------------------------------

def contiguous_blocks(variants: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``island``: the number, within its parent, of the run of places that no edge leaves.

    ``variants(parent, pos_in_ld, ...)``, ``edges(parent, i, j)`` with non-zero
    correlation.  Each edge opens at its lesser place and closes at its greater;
    a place after which nothing is open ends a block.
    """
    ends = edges.where("i <> j").select("parent", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    moves = ends.select("parent", F.col("a").alias("k"), F.lit(1).alias("d")).unionAll(ends.select("parent", F.col("b").alias("k"), F.lit(-1).alias("d")))
    moves = moves.groupBy("parent", "k").agg(F.sum("d").alias("d"))
    at = variants.join(moves, (variants.parent == moves.parent) & (variants.pos_in_ld == moves.k), "left").select(variants["*"], F.coalesce(moves.d, F.lit(0)).alias("_d"))
    w = Window.partitionBy("parent").orderBy("pos_in_ld")
    open_ = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.when(F.col("_open") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("_open", open_).withColumn("island", before.cast("int")).drop("_d", "_open")


def storage(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per block, bytes of both storage types and the choice; ``edges(block, i, j)`` places in the block, ``sizes(block, size)``."""
    low = edges.where("i <> j").select("block", F.least("i", "j").alias("c"), F.greatest("i", "j").alias("r"))
    by = low.groupBy("block", "c").agg((F.max("r") - F.col("c")).alias("span"), F.count("*").alias("n")).groupBy("block").agg(F.sum("span").alias("span"), F.sum("n").alias("n"))
    pointers = 4 * (F.col("size") + 1)
    out = sizes.join(by, "block", "left").withColumns({"interval_bytes": 8 * F.coalesce("span", F.lit(0)) + pointers, "indexed_bytes": 12 * F.coalesce("n", F.lit(0)) + pointers})
    return out.select("block", "size", "interval_bytes", "indexed_bytes", F.when(F.col("interval_bytes") <= F.col("indexed_bytes"), 0).otherwise(1).alias("type"))


def _block_names(ranked: DataFrame) -> DataFrame:
    """Give (parent, island) blocks unique names: the parent's, numbered if it has several.

    A numbered name that is a parent's own gets a further number.
    """
    per = ranked.groupBy("parent").agg((F.max("island") + 1).alias("islands"), F.min("parent_rank").alias("parent_rank")).orderBy("parent_rank").collect()
    parents, taken, rows = {r["parent"] for r in per}, set(), []
    for r in per:
        for k in range(r["islands"]):
            name = r["parent"] if r["islands"] == 1 else f"{r['parent']}.{k + 1}"
            base, extra = name, 0
            while name in taken or name != r["parent"] and name in parents:
                extra += 1
                name = f"{base}.{extra}"
            taken.add(name)
            rows.append((r["parent"], k, name, len(rows)))
    return ranked.sparkSession.createDataFrame(rows, "parent string, island int, block string, block_rank int")


# -- the object -------------------------------------------------------------

@dataclass
class LD:
    spark: SparkSession
    variants: DataFrame  # the variant table, parent, parent_rank, pos_in_ld, block, block_rank, place
    blocks: DataFrame  # BLOCK_SCHEMA
    report: DataFrame | None = None

    def block_table(self) -> DataFrame:
        """Per block in order: predictors, first and last place overall, stored correlations."""
        stored = self.blocks.select(F.col("name").alias("block"), "parent", F.col("size").alias("predictors"), F.size("data").alias("stored"))
        rank = self.variants.groupBy("block").agg(F.min("block_rank").alias("r"))
        w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        out = stored.join(rank, "block").withColumn("end", F.sum("predictors").over(w))
        return out.select("block", "parent", "predictors", (F.col("end") - F.col("predictors") + 1).alias("start"), "end", "stored")

    def correlations(self) -> DataFrame:
        """Stored correlations as (block, i, j, v), i > j, places in the block."""
        def unpack(batches):
            for b in batches:
                for name, kind, data, indptr, rows in zip(*b.columns, strict=True):
                    v, ptr = (x.values.to_numpy(zero_copy_only=False) for x in (data, indptr))
                    for a, z in _steps(ptr):  # whole columns, a bounded number of entries at a time
                        n = np.diff(ptr[a : z + 1])
                        j = np.repeat(np.arange(a, z, dtype=np.int32), n)
                        cut = slice(ptr[a], ptr[z])
                        i = rows.values.to_numpy(zero_copy_only=False)[cut] if kind.as_py() else (j + 1 + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                        keep = v[cut] != 0
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * int(keep.sum()), pa.string()), pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(v[cut][keep])], ["block", "i", "j", "v"])

        return self.blocks.select("name", "type", "data", "indptr", "row_index").mapInArrow(unpack, "block string, i int, j int, v double")

    def write(self, path: str) -> None:
        """A folder with the tables and a manifest; ``path`` may be in any store that Spark writes."""
        self.variants.write.parquet(f"{path}/variants")
        self.blocks.write.parquet(f"{path}/blocks")
        if self.report is not None:
            self.report.write.parquet(f"{path}/report")
        manifest = {"format_version": FORMAT_VERSION, "report": self.report is not None, "cross_block": "exactly zero"}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LD:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest.get("format_version") != FORMAT_VERSION:
            raise DataError("unknown version of an LD object")
        out = cls(spark, spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/blocks"), check_report(spark.read.parquet(f"{path}/report")) if manifest["report"] else None)
        out.check()
        return out

    def check(self) -> None:
        """Invariants of every stored block, tested in tasks."""
        def test(batches):
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    check_block(r)
                yield pd.DataFrame({"n": [len(pdf)]})

        tested = self.blocks.mapInPandas(test, "n long").agg(F.sum("n")).first()[0] or 0
        sizes = self.blocks.agg(F.sum("size")).first()[0] or 0
        if not tested or sizes != self.variants.count():
            raise DataError("blocks and variants of an LD object differ")


def check_report(report: DataFrame) -> DataFrame:
    """A repair report; ``source_block`` and ``floor_shrink`` may be missing from old ones."""
    if "source_block" not in report.columns:
        report = report.withColumn("source_block", F.col("block"))
    if "floor_shrink" not in report.columns:
        report = report.withColumn("floor_shrink", F.lit(0.0))
    names = [f.split()[0] for f in REPORT_SCHEMA.split(", ")]
    if missing := [c for c in names if c not in report.columns]:
        raise DataError(f"a repair report lacks {missing}")
    return report.select(*names)


def check_correlations(edges: DataFrame, bound: float) -> None:
    """Symmetric entries in [-1, 1] and a unit diagonal, each within its slack; null and NaN are refused."""
    v = F.col("v").cast("double")
    r = edges.agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("bad"), F.count_if((F.col("i") == F.col("j")) & (F.abs(v - 1) > DIAGONAL_SLACK)).alias("diagonal"),
        F.count_if((F.col("i") != F.col("j")) & (F.abs(v) > bound)).alias("large"),
    ).first()
    if r["bad"] or r["diagonal"] or r["large"]:
        raise DataError("correlations must be finite, with a unit diagonal and no value beyond 1")


def build(variants: DataFrame, edges: DataFrame) -> LD:
    """An LD object from ``variants`` (a variant table with parent and pos_in_ld from 0) and ``edges(parent, i, j, v)``.

    Either triangle or both may be given; mirrored entries must agree.
    """
    spark = variants.sparkSession
    v = check_variants(variants, ("pos_in_ld",)).persist()
    edges = edges.select("parent", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v")).persist()
    check_correlations(edges, 1 + ROOT_EPS)
    pairs = edges.where("i <> j and v <> 0").select("parent", F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v")
    one = pairs.groupBy("parent", "i", "j").agg(F.min("v").alias("v"), F.max("v").alias("top"))
    if one.where(F.col("top") - F.col("v") > ROOT_EPS).count():
        raise DataError("correlations are not symmetric")
    ranks = v.groupBy("parent").agg(F.count("*").alias("n"), F.min("pos_in_ld").alias("a"), F.max("pos_in_ld").alias("z"), F.count_distinct("pos_in_ld").alias("d")).orderBy("parent").collect()
    if any(r["a"] != 0 or r["z"] != r["n"] - 1 or r["d"] != r["n"] for r in ranks):
        raise DataError("places in a parent are numbered from 0 without gaps")
    order = spark.createDataFrame([(r["parent"], k) for k, r in enumerate(ranks)], "parent string, parent_rank int")
    return _assemble(spark, v.drop("parent_rank").join(F.broadcast(order), "parent"), one.select("parent", "i", "j", "v"))


def _assemble(spark, variants: DataFrame, pairs: DataFrame) -> LD:
    marked = contiguous_blocks(variants, pairs)
    marked = marked.join(F.broadcast(_block_names(marked)), ["parent", "island"])
    placed = marked.withColumn("place", (F.row_number().over(Window.partitionBy("block").orderBy("pos_in_ld")) - 1).cast("int")).drop("island").persist()
    where = placed.select("parent", F.col("pos_in_ld").alias("j"), "block", "place")
    start = placed.groupBy("block", "parent").agg(F.min("pos_in_ld").alias("start"), F.count("*").cast("int").alias("size"))
    local = pairs.join(where, ["parent", "j"]).join(start, ["block", "parent"]).select("block", (F.col("i") - F.col("start")).cast("int").alias("i"), F.col("place").alias("j"), "v")
    # blocks without correlations have a cell of nothing
    cells = start.select("block", "parent", "size").join(local, "block", "left")

    def pack(table: pa.Table) -> pa.Table:
        name, parent, size = (table.column(c)[0].as_py() for c in ("block", "parent", "size"))
        real = table.filter(pc.is_valid(table.column("v")))
        block = compress_cells(size, *(real.column(c).to_numpy() for c in ("i", "j", "v")))
        return pa.table({"name": [name], "parent": [parent], "size": pa.array([size], pa.int32()), "type": pa.array([block["type"]], pa.int32()), "data": [block["data"]], "indptr": pa.array([block["indptr"]], pa.list_(pa.int32())), "row_index": pa.array([block["row_index"]], pa.list_(pa.int32()))})

    return LD(spark, placed, cells.groupBy("block").applyInArrow(pack, BLOCK_SCHEMA).persist())


def subset(ld: LD, kept: DataFrame) -> LD:
    """The object of the variants whose ID is in ``kept``; blocks are found again, as removals may split them."""
    v = ld.variants.join(kept.select("ID").distinct(), "ID", "left_semi")
    if ld.report is not None:  # blocks of a repaired object keep the name of the one that was repaired
        v = v.withColumn("source_block", F.col("source_block" if "source_block" in v.columns else "block"))
    new = v.withColumn("_new", (F.row_number().over(Window.partitionBy("parent").orderBy("pos_in_ld")) - 1).cast("int"))
    at = new.select("block", "place", F.col("_new").alias("n"), "parent")
    pairs = ld.correlations().join(at.select("block", F.col("place").alias("i"), F.col("n").alias("ni"), "parent"), ["block", "i"]).join(at.select("block", F.col("place").alias("j"), F.col("n").alias("nj")), ["block", "j"])
    pairs = pairs.select("parent", F.col("ni").alias("i"), F.col("nj").alias("j"), "v")
    out = _assemble(ld.spark, new.withColumn("pos_in_ld", F.col("_new")).drop("_new", "block", "block_rank", "place"), pairs)
    # a subset may be taken of a subset, and its tables are used several times each
    return LD(ld.spark, cut(out.variants), cut(out.blocks), ld.report)


def submatrix(ld: LD, ids: DataFrame) -> DataFrame:
    """Stored correlations among the variants in ``ids(ID)``, as (ID_i, ID_j, v); others are zero, the diagonal one."""
    v = ld.variants.join(ids.select("ID").distinct(), "ID", "left_semi")
    side = lambda k: v.select("block", F.col("place").alias(k), F.col("ID").alias(f"ID_{k}"))
    return ld.correlations().join(side("i"), ["block", "i"]).join(side("j"), ["block", "j"]).select("ID_i", "ID_j", "v")


def report_map(fitted: LD) -> DataFrame:
    """Fitted blocks (``fitted_block``, ``fitted_predictors``) and the repair of the block that each comes from.

    A block that a subset has split has a row for each of its parts.
    """
    if fitted.report is None:
        raise DataError("the LD object was not repaired")
    source = "source_block" if "source_block" in fitted.variants.columns else "block"
    part = fitted.variants.groupBy(F.col("block").alias("fitted_block"), F.col(source).alias("source_block")).agg(F.count("*").cast("int").alias("fitted_predictors"))
    return part.join(fitted.report, "source_block")


# -- diagnosis and repair ---------------------------------------------------

def eigen_memory_mb(p) -> float:
    return 40 * p * p / 2**20


def eligible(blocks: DataFrame, max_block_size: int = 2000, memory_limit_mb: float = 512) -> DataFrame:
    """Blocks ``(block, size)`` whose eigenvalues may be computed: small enough, within the workspace allowed."""
    size = F.col("size").cast("double")
    return blocks.where((size <= max_block_size) & (40 * size * size / 2**20 <= memory_limit_mb))


def pointers(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Column pointers of the strict lower triangles: (block, j, start) of each column, from ``edges(block, i, j)``, ``sizes(block, size)``."""
    n = edges.where("i <> j").groupBy("block", F.least("i", "j").cast("int").alias("j")).agg(F.count("*").alias("n"))
    all_ = sizes.select("block", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("j"))
    w = Window.partitionBy("block").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    return all_.join(n, ["block", "j"], "left").select("block", "j", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w), F.lit(0)).alias("start"))


def _limits(max_block_size, memory_limit_mb) -> None:
    whole(max_block_size, "max_block_size", 1)
    number(memory_limit_mb, "memory_limit_mb", above=0)


def diagnose(ld: LD, max_block_size: int = 2000, memory_limit_mb: float = 512, tolerance: float = ROOT_EPS) -> DataFrame:
    """Per block, its eigenvalues' range, what that makes it, and the least shrinkage that makes it positive definite."""
    _limits(max_block_size, memory_limit_mb)
    number(tolerance, "tolerance", above=0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            p = int(r["size"])
            if p > max_block_size or eigen_memory_mb(p) > memory_limit_mb:
                out.append((r["name"], p, "not_assessed", None, None, None, None))
                continue
            lam = np.linalg.eigvalsh(dense(r))
            low, high = float(lam[0]), float(lam[-1])
            limit = tolerance * max(1.0, abs(lam).max())
            status = "positive_definite" if low > limit else "positive_semidefinite" if low >= -limit else "indefinite"
            need = 0.0 if low > limit else min(1.0, (limit - low) / (1 - low)) if low < 1 else 0.0
            out.append((r["name"], p, status, low, high, status == "positive_definite", need))
        return pd.DataFrame(out, columns=[f.split()[0] for f in DIAGNOSIS_SCHEMA.split(", ")])

    return ld.blocks.repartition("name").mapInPandas(lambda it: (one(x) for x in it), DIAGNOSIS_SCHEMA)


def repair_block(m: np.ndarray, method: str, shrink: float, floor: float) -> tuple[np.ndarray, dict]:
    """A correlation matrix with eigenvalues from ``floor`` (method eigen) or shrunk towards the identity."""
    lam, u = np.linalg.eigh(m)
    before, extra = float(lam[0]), 0.0
    if method == "none":
        return m, {"method": "none", "shrink": 0.0, "floor_shrink": 0.0, "before": before, "after": before}
    if method == "eigen":
        out = (u * np.maximum(lam, floor)) @ u.T
        d = np.sqrt(np.diag(out))
        out = out / np.outer(d, d)
        out = (out + out.T) / 2
        np.fill_diagonal(out, 1)
        low = float(np.linalg.eigvalsh(out)[0])
        if low < floor:
            extra = min(1.0, (floor - low) / (1 - low))
            out = (1 - extra) * out
            np.fill_diagonal(out, 1)
        used = 0.0
    else:
        out, used = (1 - shrink) * m, shrink
        np.fill_diagonal(out, 1)
    return out, {"method": method, "shrink": used, "floor_shrink": extra, "before": before, "after": float(np.linalg.eigvalsh(out)[0])}


def regularize(ld: LD, method: str = "auto", shrink: float = 0.01, max_block_size: int = 2000, memory_limit_mb: float = 512, eigen_floor: float = 1e-8) -> LD:
    """Repair blocks and report how.  ``auto`` repairs by eigenvalues what lies below the floor, and leaves the rest."""
    if method not in ("auto", "eigen", "shrink"):
        raise SpecError("method must be auto, eigen or shrink")
    number(shrink, "shrink", least=0)
    number(1 - shrink, "shrink", least=0)
    number(eigen_floor, "eigen_floor", above=0, below=1)
    _limits(max_block_size, memory_limit_mb)
    large = ld.blocks.where((F.col("size") > max_block_size) | (F.lit(40.0) * F.col("size") * F.col("size") / 2**20 > memory_limit_mb))
    if method != "shrink" and not large.isEmpty():
        raise DataError(f"blocks too large to repair by eigenvalues: {some(large, 'name')}")

    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = dense(r)
                how = method
                if method == "auto":
                    how = "eigen" if np.linalg.eigvalsh(m)[0] < eigen_floor else "none"
                fixed, info = repair_block(m, how, shrink, eigen_floor)
                block = {k: r[k] for k in ("type", "data", "indptr", "row_index")} if how == "none" else compress(np.tril(fixed, -1))
                out.append({"name": r["name"], "parent": r["parent"], "size": r["size"], **{k: block[k] for k in ("type", "data", "indptr", "row_index")}, **info})
            yield pd.DataFrame(out)

    both = ld.blocks.repartition("name").mapInPandas(work, BLOCK_SCHEMA + ", method string, shrink double, floor_shrink double, before double, after double").persist()
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
    report = both.select(
        F.col("name").alias("block"), F.col("name").alias("source_block"), "parent", F.col("size").alias("predictors"), "method", "shrink", "floor_shrink",
        F.col("before").alias("minimum_eigenvalue_before"), F.col("after").alias("minimum_eigenvalue_after"), (F.col("after") > 0).alias("positive_definite_after"),
    )
    return LD(ld.spark, ld.variants, both.select(*names), report)


def from_matrices(spark: SparkSession, matrices: Mapping[str, np.ndarray], variants: DataFrame) -> LD:
    """An LD object from dense matrices by parent; ``variants`` are in the matrices' order by (parent, pos_in_ld)."""
    rows = []
    for name, m in matrices.items():
        m = np.asarray(m, float)
        if m.ndim != 2 or m.shape[0] != m.shape[1]:
            raise DataError("an LD matrix must be square")
        i, j = np.nonzero(m)
        rows += [(name, int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)]
    twice = duplicated(variants, "ID")
    if not twice.isEmpty():
        raise DataError(f"ids occur more than once: {some(twice, 'ID')}")
    return build(variants, spark.createDataFrame(rows, "parent string, i int, j int, v double"))
