"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of equal value are one node.  Two nodes link at ``radius`` or fewer
differing bits.  Links are found without comparing all pairs:

* Routing.  radius+1 segments are cut from the 64 bits, each as wide as it takes
  for its values to make groups of about ``GROUP`` fingerprints; linked
  fingerprints agree in one of the segments, so each is sent once per segment,
  keyed by the segment's value.  A key with more than ``split_at`` fingerprints
  is cut again: its members agree there, so they must also agree in one of the
  parts of the remaining bits.  This repeats, so no key need hold a large group.
* Index.  Each task sorts what it has by key and Gray rank, which puts
  fingerprints that share bits side by side, and builds a tree over it.  A
  node holds the bits on which all below it agree, less those its parent has
  (mask and pattern).  A search carries the differences found so far down the
  tree and leaves a whole group once they exceed the radius.
* Links.  A task keeps a forest: it reports one link for each fingerprint that
  is connected to an earlier one, not all pairs.  A group whose members and the
  searcher are already connected is skipped too.

Components of these links are those of all links.  Nodes are named by their
fingerprints, so null or repeated ids join nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .rows import KEPT, file_hash, keep_rows, row_hash
from .workspace import Workspace, frugal, small_batches

_U = np.uint64
FAN = 8
FRONTIER = 1 << 21
GROUP = 512  # fingerprints that a segment's value is to hold


# -- fingerprints -----------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words joined by spaces; all words if there are fewer; nothing for none."""
    words = text.translate(_LOWER).split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(n) - 1
    first = (end - n + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(first, end[width - 1 :].tolist(), strict=True)]


_LOWER = bytes(tx.LOWER)


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the values ``h[:, at[i]:at[i+1]]`` have each bit, for every non-empty range i: rows of 64 counts for each row of ``h``.

    Eight bits of eight bytes are counted at a time in the bytes of a word, over
    pieces of at most 255 values.
    """
    size = np.diff(at)
    pieces = -(-size // 255)
    head = np.cumsum(pieces) - pieces
    start = np.repeat(at[:-1], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(head, pieces))
    out = np.empty((len(start), len(h), 8, 8), np.uint8)
    for j in range(8):
        lanes = np.add.reduceat((h >> _U(j)) & _U(0x0101010101010101), start, axis=1)
        out[:, :, :, j] = np.ascontiguousarray(lanes.T).view(np.uint8).reshape(len(start), len(h), 8)
    return np.add.reduceat(out.reshape(len(start), -1), head, axis=0, dtype=np.int32)


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` columns of ``h``, each row's fingerprint: a bit is 1 if it is in over half of the values; of none, zero."""
    out = np.zeros((len(sizes), len(h)), _U)
    full = np.flatnonzero(sizes)
    if len(full):
        ones = bit_counts(h, np.concatenate([[0], np.cumsum(sizes[full])]))
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little").view(_U)
    return out


def fingerprints(data: np.ndarray, off: np.ndarray, width: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is in over half of the hashes, repeats included."""
    raw = data.tobytes()
    hashes, sizes = [], np.zeros(len(off) - 1, np.int64)
    for i in range(len(sizes)):
        h = shingle_hashes(raw[off[i] : off[i + 1]], width)
        hashes += h
        sizes[i] = len(h)
    return majority(np.array(hashes, _U)[None], sizes)[:, 0]


def fingerprint_table(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``file`` and ``row`` (hashes of the file that the row is read from, and of its id and text) and ``fp`` (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)
    schema = docs.select(id).schema.add("file", "long").add("row", "long").add("fp", "long")

    def run(batches):
        for b in batches:
            data, off = tx.utf8(b.column(3))
            for i, j in tx.runs(off):
                fp = fingerprints(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(fp.view(np.int64))], [id, "file", "row", "fp"])

    return docs.select(id, file_hash(docs).alias("file"), row_hash(id, text).alias("row"), text).mapInArrow(frugal(run), schema)


# -- index ------------------------------------------------------------------

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Each value's place in the Gray sequence, in which neighbours differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(k))
    return x


class GrayIndex:
    """A tree over fingerprints sorted by (group, Gray rank); no node spans two groups.

    ``visited`` counts the nodes that searches looked at.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.visited = 0
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[self.order], group[self.order]
        n = len(fp)
        # levels[0] are leaves (single fingerprints); each further level is runs of FAN nodes of one group
        ones, zeros = self.fp, ~self.fp  # bits that are 1, or 0, in all below a node
        child_of, masks, patterns, spans = [], [np.full(n, ~_U(0))], [self.fp], [np.arange(n + 1)]
        while True:
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            start = np.flatnonzero(new)
            if len(start) == len(group):
                break
            size = np.diff(np.append(start, len(group)))
            place = np.arange(len(group)) - np.repeat(start, size)
            head = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_and.reduceat(zeros, head)
            child_of.append(np.append(head, len(group)))
            group = group[head]
            spans.append(spans[-1][child_of[-1]])
            masks.append(ones | zeros)
            patterns.append(ones)
        self.group, self.children, self.spans = group, child_of, spans
        self.known = [np.bitwise_count(m) for m in masks]  # bits compared once a node is
        # factor: a node keeps the shared bits that its parent does not hold already
        self.masks = list(masks)
        for k, kids in enumerate(child_of):
            self.masks[k] = masks[k] & ~np.repeat(masks[k + 1], np.diff(kids))
        self.patterns = patterns
        self.root = np.repeat(np.arange(len(group)), np.diff(spans[-1]))  # of each fingerprint

    def neighbours(self, queries: np.ndarray, limits: np.ndarray, labels: np.ndarray | None = None, step: int = FRONTIER // (FAN * 64), later: bool = True):
        """Blocks of (query, member) places that no node on the member's path tells apart; members after queries if ``later``.

        A node is left once the accumulated differences exceed ``limits[k]``, k
        being the number of bits compared so far; so with one limit for all k,
        these are the members at most so many bits apart.  ``labels``, read as
        the search goes on, gives places that are connected already: a node all
        of whose members carry the query's label is skipped.
        """
        limits = np.asarray(limits)
        allowed = [limits[k] for k in self.known]
        for lo in range(0, len(queries), step):
            q = queries[lo : lo + step]
            uniform = self._uniform(labels) if labels is not None else None
            yield from self._descend(len(self.children), q, self.root[q], np.zeros(len(q), np.uint8), allowed, labels, uniform, later)

    def _uniform(self, labels):
        """Per level, the label that all members of a node share, or -1."""
        out = [labels]
        for kids in self.children:
            low, high = np.minimum.reduceat(out[-1], kids[:-1]), np.maximum.reduceat(out[-1], kids[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def _descend(self, level, q, node, far, allowed, labels, uniform, later):
        self.visited += len(q)
        far = far + np.bitwise_count((self.fp[q] ^ self.patterns[level][node]) & self.masks[level][node])
        ok = far <= allowed[level][node]
        if later:
            ok &= self.spans[level][node + 1] - 1 > q
        if uniform is not None:
            ok &= uniform[level][node] != labels[q]
        q, node, far = q[ok], node[ok], far[ok]
        if level == 0:
            if len(q):
                yield q, node
            return
        kids = self.children[level - 1]
        n = kids[node + 1] - kids[node]
        for a in range(0, len(q), FRONTIER // FAN):
            b = a + FRONTIER // FAN
            m = n[a:b]
            total = int(m.sum())
            if total:
                child = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(kids[node[a:b]], m)
                yield from self._descend(level - 1, np.repeat(q[a:b], m), child, np.repeat(far[a:b], m), allowed, labels, uniform, later)

    def companied(self) -> np.ndarray:
        """Places of fingerprints that are not alone in their group."""
        many = np.flatnonzero(np.diff(self.spans[-1]) > 1) if self.children else np.empty(0, np.int64)
        return np.flatnonzero(np.isin(self.root, many))


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a and b; on return every place points at its set's least place."""
    while True:
        ra, rb = parent[a], parent[b]
        if (ra == rb).all():
            return
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places in the input) that connect what is within ``radius``, at most one for each place."""
    index = GrayIndex(group, fp)
    n = len(fp)
    parent = np.arange(n)
    for q, m in index.neighbours(index.companied(), np.full(65, radius), parent):
        _hook(parent, q, m)
    at = np.flatnonzero(parent != np.arange(n))
    return index.order[at], index.order[parent[at]]


# -- routing ----------------------------------------------------------------

def _segments(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def segment_width(n: int, radius: int, group: int = GROUP) -> int:
    """Bits of a segment so that ``n`` fingerprints make groups of about ``group``, as far as radius+1 segments fit 64 bits."""
    return min(64 // (radius + 1), max(n // group, 1).bit_length())


def candidates(nodes: DataFrame, ws: Workspace, radius: int, split_at: int, depth: int = 4) -> DataFrame:
    """``nodes(node, fp)`` -> rows ``(k1, k2, node, fp)``; linked fingerprints share a key (k1, k2)."""
    cuts = _segments(list(range((radius + 1) * segment_width(nodes.count(), radius))), radius + 1)
    paths = lambda some: F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(_mask(bits)).cast("long").alias("m")) for p, bits in some])
    path = F.explode(paths(enumerate(cuts)))
    # k1: which bits must agree (a path of segment numbers); k2: a hash of their values
    now = nodes.select("node", "fp", path.alias("s")).select("node", "fp", F.col("s.p").alias("k1"), F.col("s.m").alias("fixed"))
    known, number = dict(enumerate(cuts)), radius
    done = []
    for level in range(depth):
        now = now.withColumn("k2", F.xxhash64(F.col("fp").bitwiseAND(F.col("fixed"))))
        hot = ws.save(now.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > split_at).select("k1", "k2", F.lit(True).alias("hot")), f"hot{level}")
        if level == depth - 1 or hot.isEmpty():
            done.append(now)
            break
        flagged = now.join(hot, ["k1", "k2"], "left")
        done.append(flagged.where("hot is null").drop("hot"))
        deeper, step = {}, []
        for p, bits in known.items():
            own, rest = {}, [b for b in range(64) if b not in set(bits)]
            for c in _segments(rest, radius + 1):
                own[number := number + 1] = bits + c
            step += [F.lit(p).cast("long"), paths(own.items())]
            deeper |= own
        now = flagged.where("hot").select("node", "fp", F.explode(F.create_map(*step)[F.col("k1")]).alias("s")).select("node", "fp", F.col("s.p").alias("k1"), F.col("s.m").alias("fixed"))
        known = deeper
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("k1", "k2", "node", "fp")


def links(nodes: DataFrame, ws: Workspace, radius: int = 2, split_at: int = 4 * GROUP) -> DataFrame:
    """``nodes(node long, fp long)``, fp distinct -> links ``(a, b)`` whose components are those of all links."""
    routed = candidates(nodes, ws, radius, split_at).repartition("k1", "k2")

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        k1, k2, node, fp = (t.column(i).to_numpy() for i in range(4))
        group = tx.mix64(k1.view(_U)) ^ k2.view(_U)
        a, b = forest(group, fp.view(_U), radius)
        a, b = node[a], node[b]
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"])

    return routed.mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, ws: Workspace, radius: int = 2, width: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``fp`` and ``component_id``, the least id reachable over links.

    A null text is empty; a text without words has fingerprint zero, which links
    like any other.  Rows with equal texts share fingerprint and component;
    repeated ids keep all their rows, and join nothing by being equal.  A null id
    names a component only if there is no other in it; that component's id is
    null.  An empty table gives no rows.
    """
    prints = ws.save(fingerprint_table(docs, id, text, width).drop("file", "row"), "prints")
    nodes = ws.save(prints.groupBy(F.col("fp").alias("node")).agg(F.min(F.col(id).cast("long")).alias("least")), "nodes")
    found = components(links(nodes.select("node", F.col("node").alias("fp")), ws, radius), ws)
    part = F.coalesce("component", "node").alias("part")
    named = ws.save(nodes.join(found, "node", "left").select("node", part, "least"), "named")
    # components of one node have its least id; only the others need looking up
    several = found.select(F.col("component").alias("part")).distinct()
    least = named.join(several, "part", "left_semi").groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part", "left").select(F.col("node").alias("fp"), F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return ws.finish(prints.join(named, "fp").select(id, "fp", "component_id"), "components")


def keep_one(docs: DataFrame, ws: Workspace, radius: int = 2, width: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the least id, nulls last.

    If several rows have that id, the one with the least text stays.
    """
    prints = ws.save(fingerprint_table(docs, id, text, width), "prints")
    # nodes are named by fingerprint, as ids may be null or repeated
    nodes = prints.select(F.col("fp").alias("node"), "fp").distinct()
    found = components(links(nodes, ws, radius), ws)
    named = prints.join(found, F.col("fp") == F.col("node"), "left").select(id, "file", "row", F.coalesce("component", "fp").alias("component"))
    return choose(docs, named, ws, id, text)


def choose(docs: DataFrame, named: DataFrame, ws: Workspace, id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each component of ``named(id, file, row, component)``: of those with its least id the one with the least text."""
    known = F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("known")
    by_id = named.groupBy("component", known).agg(F.count("*").alias("n"), F.min("file").alias("file"), F.min("row").alias(KEPT))
    kept = ws.save(by_id.groupBy("component").agg(F.min(F.struct("known", "n", "file", KEPT)).alias("k")).select("component", "k.*"), "kept")
    once = keep_rows(docs, ws, kept.where("n = 1").select(KEPT, "file"), id, text)
    repeated = kept.where("n > 1").select("component", "known")
    if repeated.isEmpty():
        return once
    rows = named.select("component", known, F.col("row").alias(KEPT)).join(repeated, ["component", "known"], "left_semi")
    rows = rows.select(F.col("component").alias(PART), KEPT).distinct()
    some = docs.withColumn(KEPT, row_hash(id, text)).join(rows, KEPT)
    least = some.groupBy(PART).agg(F.min(F.struct(text, *(c for c in docs.columns if c != text))).alias("r"))
    return once.unionByName(least.select(*[F.col("r")[c].alias(c) for c in docs.columns]))


NO_ID = (1 << 63) - 1
PART = "__kept_part"  # a name that no table is likely to have
