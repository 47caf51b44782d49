"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes.  A document's size is its number of words.  One aggregation gives each
   source's size; targets follow from weights by water-filling.
2. Blocks.  A hash of the document deals a source's documents into blocks; the
   number of blocks is bounded, so their sizes fit the driver at any input.
3. Quotas.  A source is taken whole as often as its target holds its size; the
   rest is a run of its permuted blocks, the last of them in part, so that the
   words taken are the target's to the word.
4. Tree.  The taken blocks are split among output shards by halving the shards
   again and again: a half's numbers of blocks of each source are a
   multivariate hypergeometric draw from its parent's.  Leaves then draw the
   next blocks of each source's permutation, so draws are disjoint.
5. Rows.  Each document looks its block up in the plan (bounded, broadcast), and
   shards are shuffled by a hash order of their own.

Everything random comes from the seed and the rows' content, so runs agree.

Defined cases: a null text has size 0 and is taken as often as its block; null
sources are one source, last in order; a source without words has target 0;
repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as tx
from .workspace import Workspace, frugal

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCKS = 1 << 16  # of all sources together, besides one for each source
MAX_SOURCES = 1_000_000  # what the driver holds of them: name, size and target
REPEATS = 2


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0
    blocks: int = 1


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, repeats: int = REPEATS) -> list[float]:
    """``share`` of all sizes dealt by weight; a target stops at ``repeats`` times its size and leaves the rest to the others."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if unit * weights[i] > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shard, source) numbers of blocks that add up to ``quotas``, by recursive halving."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def halve(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        total = int(have.sum())
        mine = total * (mid - first) // (last - first)
        # marginals: time in the number of sources, whatever the quotas
        left = rng.multivariate_hypergeometric(have, mine, method="marginals") if total else have
        halve(first, mid, left)
        halve(mid, last, have - left)

    halve(0, shards, quotas.astype(np.int64))
    return out


def plan(sources: list[Source], block_sizes: dict[tuple[int, int], int], shards: int, seed: int) -> list[tuple[int, int, int, int, int | None]]:
    """Rows (source, block, epoch, shard, words); words is null but for a block taken in part."""
    draws: list[list[tuple[int, int, int | None]]] = []
    own: list[list[int]] = [[] for _ in sources]
    for s, b in sorted(block_sizes):
        own[s].append(b)
    for s, src in enumerate(sources):
        rng = np.random.default_rng([seed, s])
        whole = min(int(src.target // src.size), REPEATS) if src.size else 0
        rest = min(max(round(src.target - whole * src.size), 0), src.size) if whole < REPEATS else 0
        taken: list[tuple[int, int, int | None]] = []
        for epoch in range(whole + 1):
            for b in rng.permutation(own[s]).tolist() if own[s] else []:
                n = block_sizes[s, b]
                if epoch < whole:
                    taken.append((b, epoch, None))
                elif rest > 0:
                    taken.append((b, epoch, None if n <= rest else rest))
                    rest -= min(n, rest)
        draws.append(taken)
    dealt = split_tree(np.array([len(d) for d in draws]), shards, np.random.default_rng([seed, len(sources)]))
    out = []
    for s, taken in enumerate(draws):
        to = np.repeat(np.arange(shards), dealt[:, s]).tolist()
        out += [(s, b, epoch, shard, words) for (b, epoch, words), shard in zip(taken, to, strict=True)]
    return out


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _content_hash(id: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


class Mix:
    """Sizes, targets and the plan for one table; ``rows`` and ``taken`` apply them to it."""

    def __init__(self, docs: DataFrame, ws: Workspace, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, shards: int = 16, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source"):
        self.docs, self.seed, self.id, self.text, self.source, self.shards = docs, seed, id, text, source, shards
        self.shard_column, self.order_column = (_free_name(n, docs.columns) for n in ("_shard", "_order"))
        spark = docs.sparkSession
        hashed = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), _content_hash(id, text, seed).alias("h"))
        self.slim = ws.save(hashed, "sizes")
        totals = self.slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        # code point order is the order of Python strings; null last
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sources = [Source(r["source"], r["size"], weights[i % len(weights)]) for i, r in enumerate(totals)]
        everything = sum(s.size for s in self.sources)
        for s, t in zip(self.sources, targets([s.size for s in self.sources], [s.weight for s in self.sources], share), strict=True):
            s.target, s.blocks = t, 1 + BLOCKS * s.size // max(everything, 1)
        self.table = spark.createDataFrame([(i, s.name is None, s.name or "", s.size, s.target, s.blocks) for i, s in enumerate(self.sources)], "_s int, _null boolean, _name string, _source_size long, _target double, _blocks long")
        blocks = self._with_block(self.slim, "source").groupBy("_s", "_block").agg(F.sum("size").alias("n")).collect()
        self.plan = plan(self.sources, {(r["_s"], r["_block"]): r["n"] for r in blocks}, shards, seed)
        draws: dict[tuple[int, int], list] = {}
        for s, b, epoch, shard, words in self.plan:
            draws.setdefault((s, b), []).append((epoch, shard, words))
        schema = "_s int, _block int, _draws array<struct<epoch:int,shard:int,words:long>>, _part boolean"
        self.draws = spark.createDataFrame([(s, b, d, any(w is not None for *_, w in d)) for (s, b), d in draws.items()], schema)
        self.edges = self._edges()

    def _with_block(self, df: DataFrame, source: str) -> DataFrame:
        """Add the source's columns and the block that ``h`` falls in."""
        keyed = df.withColumns({"_null": F.col(source).isNull(), "_name": F.coalesce(F.col(source), F.lit(""))})
        unit = F.shiftrightunsigned("h", 12).cast("double") / F.lit(float(1 << 52))
        return keyed.join(F.broadcast(self.table), ["_null", "_name"]).withColumn("_block", F.floor(unit * F.col("_blocks")).cast("int")).drop("_null", "_name")

    def _drawn(self, df: DataFrame, source: str) -> DataFrame:
        return self._with_block(df, source).join(F.broadcast(self.draws), ["_s", "_block"], "left")

    def _placed(self) -> DataFrame:
        """Sizes with draws, and for documents of blocks taken in part the words before them in the block."""
        named = self._drawn(self.slim, "source")
        order = Window.partitionBy("_s", "_block").orderBy("h", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        part = named.where("_part").withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
        return named.where("_part is null or not _part").withColumn("_before", F.lit(0).cast("long")).unionByName(part)

    def _edges(self) -> DataFrame:
        """Of each block taken in part the document (hash and id) at which its words are used up, and the words left for it: a row for each source at most."""
        part = self._placed().where("_part").withColumn("_left", F.array_max(F.transform("_draws", lambda d: d["words"])))
        keyed = part.groupBy("_s", "_block", "h", "id").agg(F.min("_before").alias("_before"), F.sum("size").alias("n"), F.first("_left").alias("_left"))
        found = keyed.where("_before < _left and _left <= _before + n").select("_s", "_block", F.col("h").alias("_h"), F.col("id").alias("_edge"), F.expr("_left - _before").alias("_left")).collect()
        kind = self.docs.select(F.col(self.id).alias("_edge")).schema["_edge"].dataType
        return self.docs.sparkSession.createDataFrame(found, StructType().add("_s", "integer").add("_block", "integer").add("_h", "long").add("_edge", kind).add("_left", "long"))

    @staticmethod
    def _words(draw: Column) -> Column:
        """What a draw takes of its document."""
        return F.when(draw["words"].isNull(), F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), draw["words"] - F.col("_before"))))

    def taken(self) -> DataFrame:
        """Per document: id, size, source_size, target and the words that the mix takes, repeats counted."""
        rows = self._placed()
        total = F.aggregate(F.transform(F.coalesce("_draws", F.array().cast("array<struct<epoch:int,shard:int,words:long>>")), self._words), F.lit(0).cast("long"), lambda a, x: a + x)
        return rows.select(F.col("id").alias(self.id), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), total.alias("taken"))

    def rows(self) -> DataFrame:
        """The mix: the table's columns once for each draw, then the shard and the place in its local shuffle.

        These two are named by ``shard_column`` and ``order_column``: _shard and
        _order, with more underscores if the table has such columns.

        A document that is taken in part is cut after its last word taken; if
        there is a column n_chars it then counts what is left.
        """
        c = self.docs.columns
        full = self.docs.select(F.struct(*[F.col(f"`{x}`") for x in c]).alias("_row"), F.col(self.id).alias("_id"), F.col(self.source).alias("_source"), F.col(self.text).alias("_text"), _content_hash(self.id, self.text, self.seed).alias("h"))
        # only blocks taken in part need their documents' sizes again
        drawn = self._drawn(full, "_source").where("_draws is not null").withColumn("size", F.when(F.col("_part"), word_count("_text"))).drop("_text")
        part = drawn.where("_part").join(F.broadcast(self.edges), ["_s", "_block"])
        same = part.where("h = _h and _id <=> _edge")
        turn = F.row_number().over(Window.partitionBy("_s", "_block").orderBy("h")) - 1
        first = F.expr("h < _h or h = _h and (_id < _edge or _id is null and _edge is not null)")
        same = same.withColumn("_own", F.least("size", F.greatest(F.lit(0).cast("long"), F.col("_left") - turn * F.col("size"))))
        other = part.where("not (h = _h and _id <=> _edge)").withColumn("_own", F.when(first, F.col("size")).otherwise(F.lit(0).cast("long")))
        whole = drawn.where("not _part").withColumn("_own", F.lit(None).cast("long"))
        keep = [*drawn.columns, "_own"]
        drawn = whole.select(keep).unionByName(same.select(keep)).unionByName(other.select(keep)).withColumn("_draw", F.explode("_draws"))
        drawn = drawn.withColumn("_words", F.when(F.col("_draw.words").isNotNull(), F.col("_own"))).where("_words is null or _words > 0 or size = 0")
        shard = [F.col("_draw.shard").alias(self.shard_column), F.xxhash64(F.lit(self.seed), F.col("h"), F.col("_draw.epoch")).alias(self.order_column)]
        columns = [F.col("_row")[x].alias(x) for x in c]
        whole = drawn.where("_words is null or _words = size").select(*columns, *shard)
        short = drawn.where("_words < size").select(*columns, *shard, F.col("_words").alias("_cut_after"))
        return whole.union(_cut(short, self.text))


def first_words(raw: bytes, n: int) -> bytes:
    """Up to the end of the ``n``-th word."""
    low, _, ends, _ = tx.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return raw[: ends[n - 1]] if 0 < n <= len(ends) else raw[: 0 if n <= 0 else len(raw)]


def _free_name(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def _cut(rows: DataFrame, text: str) -> DataFrame:
    """Keep the first words of each text, as many as the last column says, and drop that; few rows come here, one for each source."""
    schema = StructType(rows.schema.fields[:-1])
    chars = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches):
        for b in batches:
            t = b.schema.names.index(text)
            cut = [first_words(s.encode(), k).decode() for s, k in zip(b.column(t).to_pylist(), b.columns[-1].to_pylist(), strict=True)]
            columns = list(b.columns[:-1])
            columns[t] = pa.array(cut, columns[t].type)
            if chars is not None:
                columns[chars] = pa.array([len(s) for s in cut]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return rows.mapInArrow(frugal(run), schema)


def write_shards(mix: Mix, path: str) -> None:
    """Write a mix as a folder for each shard, each shuffled in its own order."""
    by = [mix.shard_column, mix.order_column]
    mix.rows().repartitionByRange(*by).sortWithinPartitions(*by).drop(mix.order_column).write.partitionBy(mix.shard_column).parquet(path)
