"""SimHash near-duplicates by the words themselves: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Equal sets are one node.  Two sets of that similarity differ in a bit of their
fingerprints with a chance of about ``DIFFER``, about ten bits of 64, too many for
one table of segments.  So a fingerprint here has 64 * ``WORDS`` bits, and there are
several tables.  Each puts bits drawn for it into a 64-bit word; nodes whose words
begin with the same ``route`` bits are a group, sorted by Gray rank and searched as
a hierarchical index (:class:`~bayesmill.llm.simhash.GrayIndex`).  A group of nodes
is left once its accumulated differences exceed what ``KEPT`` of such pairs have
in as many bits.  ``route`` follows from the number of nodes, and the number of
tables from ``route``, so that a pair at the very limit is in reach of no table
with a chance of ``MISS``; it is less the more similar a pair is.

A candidate pair within ``FAR`` bits is verified on the sets, so nothing less
similar is ever linked.  Pairs that are connected already are not compared.  The
sets, as sorted hashes, stay in files; tasks read those of candidates.

A group of over ``split_at`` nodes is cut into blocks.  These find links within
themselves first; then those of the group's nodes that are not of its largest
component so far are searched for in every block, so no pair of the group is left out
but those that are connected.

Words are those of the fingerprints.  A shorter text has one shingle of all its
words; texts without words are one node.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import text as tx
from .components import components
from .rows import file_hash, row_hash
from .simhash import GrayIndex, _hook, choose, majority, shingle_hashes
from .workspace import Workspace, frugal, parts, small_batches

WIDTH = 5
WORDS = 4  # 64-bit words of a fingerprint
DIFFER = 0.17  # the chance that a pair at the limit differs in a bit: arccos(8/9)/pi, and more for short sets
KEPT, MISS = 0.9, 1e-3
FAR = 80  # bits of a fingerprint in which candidates differ at most; others differ in about half
GROUP = 1024  # nodes that a route is to hold
ROW_BYTES = 80  # of a routed node
START, BYTES = 36, 5  # bits of a place that count hashes within a file, those above name the file; bytes of a stored hash

_U = np.uint64
_SALT = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, WORDS, dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's five-word shingles, each once, cut to ``BYTES`` bytes."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), _U) >> _U(64 - 8 * BYTES))


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """``WORDS`` words for each set; a bit is 1 if it is in over half of the members' mixed hashes."""
    members = np.concatenate([*sets, np.empty(0, _U)])
    return majority(np.stack([tx.mix64(members ^ s) for s in _SALT]), np.array([len(s) for s in sets]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


# -- tables -----------------------------------------------------------------

def limits(route: int) -> np.ndarray:
    """Allowed differences among the first k bits of a word, the first ``route`` being equal: what ``KEPT`` of pairs at the limit have."""
    out = np.zeros(65, np.int64)
    for k in range(route + 1, 65):
        n, p, total = k - route, (1 - DIFFER) ** (k - route), 0.0
        for d in range(n + 1):
            total += p
            if total >= KEPT:
                out[k] = d
                break
            p *= (n - d) / (d + 1) * DIFFER / (1 - DIFFER)
    return out


def reach(route: int) -> float:
    """The chance that a table finds a pair at the limit: the differences stay within the limits at every bit."""
    allowed = limits(route)
    now = np.zeros(66)
    now[0] = (1 - DIFFER) ** route
    for k in range(route + 1, 65):
        now[1:] = now[1:] * (1 - DIFFER) + now[:-1] * DIFFER
        now[0] *= 1 - DIFFER
        now[allowed[k] + 1 :] = 0
    return float(now.sum())


def tables_for(n: int) -> tuple[int, int]:
    """Bits of a route and the number of tables for ``n`` nodes."""
    route = min(40, max(n // GROUP, 1).bit_length() - 1)
    return route, math.ceil(math.log(MISS) / math.log1p(-reach(route)))


def table_words(fp: np.ndarray, table: int) -> np.ndarray:
    """The 64 bits of each fingerprint (a row of words) that a table looks at, in its order."""
    if not len(fp):
        return np.empty(0, _U)
    pick = np.random.Generator(np.random.PCG64([20240302, table])).permutation(64 * WORDS)[:64]
    out = np.zeros(len(fp), _U)
    for place, bit in enumerate(pick.tolist()):
        out |= (fp[:, bit >> 6] >> _U(bit & 63) & _U(1)) << _U(63 - place)
    return out


# -- sets -------------------------------------------------------------------

def set_table(docs: DataFrame, uri: str, id: str, text: str) -> DataFrame:
    """Per row ``id``, ``file``, ``row``, ``node`` (a digest of its set), ``place`` and ``size`` (where its set is in the files at ``uri``), ``fp``."""
    small_batches(docs.sparkSession)
    schema = docs.select(id).schema
    for name in ("file", "row", "node", "place", "size"):
        schema = schema.add(name, "binary" if name == "node" else "long")
    schema = schema.add("fp", ArrayType(LongType()))

    def run(batches):
        task, at, out = TaskContext.get().taskAttemptId(), 0, None  # no other attempt has the same number
        try:
            for b in batches:
                data, off = tx.utf8(b.column(3))
                for i, j in tx.runs(off):
                    raw = data[off[i] : off[j]].tobytes()
                    sets = [shingle_set(raw[p:q]) for p, q in zip((off[i:j] - off[i]).tolist(), (off[i + 1 : j + 1] - off[i]).tolist(), strict=True)]
                    size = np.array([len(s) for s in sets])
                    room = np.maximum(size, 1)  # an empty set has a place of its own too
                    start = at + np.cumsum(room) - room
                    at += int(room.sum())
                    if out is None:
                        out = _create(uri, task)
                    for s in sets:
                        out.write(s.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() or bytes(BYTES))
                    node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                    fp = pa.FixedSizeListArray.from_arrays(pa.array(set_fingerprints(sets).view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
                    columns = [*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(node, pa.binary()), pa.array((task << START) + start), pa.array(size), fp]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
        finally:
            if out is not None:
                out.close()

    return docs.select(id, file_hash(docs).alias("file"), row_hash(id, text).alias("row"), text).mapInArrow(frugal(run), schema)


def _create(uri: str, task: int):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{task}")


class Sets:
    """Reads sets from the files at ``uri``."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.open = lru_cache(64)(lambda task: self.fs.open_input_file(f"{self.path}/{task}"))
        self.get = lru_cache(1024)(self._get)

    def _get(self, place: int, size: int) -> np.ndarray:
        raw = self.open(place >> START).read_at(BYTES * size, BYTES * (place & (1 << START) - 1))
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(size, BYTES)
        return wide.view(_U)[:, 0]


# -- links ------------------------------------------------------------------

def forest(group: np.ndarray, word: np.ndarray, fp: np.ndarray, place: np.ndarray, size: np.ndarray, get, allowed: np.ndarray, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between places of a group that are found and similar; what they connect is all that such pairs connect.

    ``label`` (of each place, or -1) says what is connected already; then only
    those with a label of -2 or less, -2 - label, are searched for.
    """
    index = GrayIndex(group, word)
    fp, place, size = fp[index.order], place[index.order], size[index.order]
    if label is None:
        root, queries = np.arange(len(place)), index.companied()
    else:
        label = label[index.order]
        known = np.where(label <= -2, -2 - label, label)
        _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
        root, queries = first[inverse], np.flatnonzero(label <= -2)
    out = []
    for q, m in index.neighbours(queries, allowed, root, step=256, later=label is None):
        near = (np.bitwise_count(fp[q] ^ fp[m]).sum(axis=1) <= FAR) & (root[q] != root[m])
        near &= (5 * size[q] >= 4 * size[m]) & (5 * size[m] >= 4 * size[q])
        for a, b in zip(q[near].tolist(), m[near].tolist(), strict=True):
            if root[a] != root[b] and similar(get(int(place[a]), int(size[a])), get(int(place[b]), int(size[b]))):
                out.append((int(place[a]), int(place[b])))
                _hook(root, np.array([a]), np.array([b]))
    return out


def _routed(nodes: DataFrame, route: int, tables: int) -> DataFrame:
    """``nodes(place, size, fp)`` -> a row (key, place, size, fp) for each table; the key is the table and the route."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = b.column(2).flatten().to_numpy().reshape(-1, WORDS).view(_U)
            for t in range(tables):
                way = (table_words(fp, t) >> _U(64 - route)).astype(np.int64) if route else np.zeros(len(fp), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((t << 40) + way), *b.columns], ["key", "place", "size", "fp"])

    return nodes.where("size > 0").select("place", "size", "fp").mapInArrow(frugal(run), "key long, place long, size long, fp array<long>")


def _search(rows: DataFrame, by: list[str], uri: str, route: int, count: int, labelled: bool) -> DataFrame:
    """Links within each group of ``rows(key, place, size, fp, block, label)``."""
    allowed, parted = limits(route), max(parts(rows.sparkSession), count * ROW_BYTES >> 26)

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        t = t.combine_chunks()
        key, place, size, block, label = (t.column(k).to_numpy() for k in ("key", "place", "size", "block", "label"))
        fp = t.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, WORDS).view(_U)
        word = np.zeros(len(key), _U)
        for table in np.unique(key >> 40).tolist():
            mine = key >> 40 == table
            word[mine] = table_words(fp[mine], table)
        group = tx.mix64(key.view(_U)) ^ tx.mix64(block.view(_U) + _U(1))
        found = forest(group, word, fp, place, size, Sets(uri).get, allowed, label if labelled else None)
        for i in range(0, len(found), 100_000):
            a, b = zip(*found[i : i + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("key", "place", "size", "fp", "block", "label").repartition(parted, *by).mapInArrow(frugal(run), "a long, b long")


def link_components(nodes: DataFrame, uri: str, ws: Workspace, split_at: int = 1 << 14) -> DataFrame:
    """``nodes(place, size, fp)`` -> ``(node, component)`` of places that similar pairs connect."""
    n = nodes.count()
    route, tables = tables_for(n)
    routed = _routed(nodes, route, tables)
    hot = ws.save(routed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split_at).select("key", (F.col("n") / (split_at // 2) + 1).cast("int").alias("blocks")), "hot")
    none = F.lit(0).cast("long")
    if hot.isEmpty():
        return components(_search(routed.select("*", none.alias("block"), none.alias("label")), ["key", "block"], uri, route, n * tables, False), ws)
    routed = ws.save(routed.join(hot, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), none).otherwise(F.pmod(F.xxhash64("place", "key"), F.col("blocks").cast("long")))), "routed")
    first = ws.save(_search(routed.withColumn("label", none), ["key", "block"], uri, route, n * tables, False), "first")
    found = ws.save(components(first, ws, "firsts"), "found")
    of_hot = routed.where("blocks is not null").join(found.withColumnRenamed("node", "place"), "place", "left").withColumn("part", F.coalesce("component", "place"))
    main = of_hot.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "part")).alias("m")).select("key", F.col("m.part").alias("main"))
    # labels are places, which are not negative; those to search for have -2 - label, and are sent to every block
    of_hot = ws.save(of_hot.join(main, "key").withColumn("minor", F.expr("part <> main")), "labelled")
    members = of_hot.where("not minor").withColumn("label", F.col("part"))
    minor = of_hot.where("minor").withColumn("label", -2 - F.col("part")).withColumn("block", F.explode(F.sequence(none, F.col("blocks").cast("long") - 1)))
    rows = ws.save(members.unionByName(minor).select("key", "place", "size", "fp", "block", "label"), "second")
    second = _search(rows, ["key", "block"], uri, route, rows.count(), True)
    return components(first.unionByName(second), ws)


def keep_one(docs: DataFrame, ws: Workspace, id: str = "doc_id", text: str = "text", split_at: int = 1 << 14) -> DataFrame:
    """One row of ``docs`` for each group connected by similar pairs: the one with the least id (nulls last), then the least text."""
    rows = ws.save(set_table(docs, ws.path("sets"), id, text), "rows")
    nodes = ws.save(rows.groupBy("node").agg(F.min(F.struct("place", "size", "fp")).alias("s")).select("node", "s.*"), "nodes")
    found = link_components(nodes, ws.path("sets"), ws, split_at)
    ws.drop("sets")
    named = nodes.select("node", "place").join(found.withColumnRenamed("node", "place"), "place", "left").select("node", F.coalesce("component", "place").alias("component"))
    return choose(docs, rows.join(named, "node").select(id, "file", "row", "component"), ws, id, text)
