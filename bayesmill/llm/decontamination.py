"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the short items that lie inside long documents: pairs in which at least
``threshold`` of an item's distinct five-word shingles occur in the document.

* Words are runs of bytes other than ASCII punctuation, space and control
  characters, with A-Z and the capitals of Latin-1 in lower case.  A text of one
  to four words has one shingle, all its words; one without words has none.
* Items are partitioned by their number of shingles (powers of two), documents
  likewise.  For a pair of partitions, a document's MinHash signature is the
  least hash in each of a number of bins.  The number is chosen from both sizes
  so that a qualifying pair shares a minimum but with probability e**-14; it is
  less the larger the items are.  Bins are given by a hash's first bits, so that
  a signature of fewer bins is made from one of more.  For items of a few
  shingles the bins would be far more than the document's hashes; then the
  signature is these hashes themselves, and no pair is missed.
* A candidate document is verified: its hashes against those of the items, then
  the words themselves, for pairs that pass.

Items are indexed in blocks of bounded size, written by tasks to the shared
folder and mapped by those that scan documents, so neither driver nor task
holds all items.  Every document meets every block; documents are never
exchanged or paired with each other.

Defined cases: null texts are empty and match nothing; repeated items or
documents give a row each; empty tables give no rows; other columns are left
alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .workspace import Workspace, frugal, map_arrays, put_arrays, small_batches

_U = np.uint64
WIDTH, THRESHOLD = 5, 0.8
MISS = 14.0  # a qualifying pair shares no minimum with probability e**-MISS at most
SPARE = 3  # bins are at most 2**SPARE times the document's hashes
BLOCK_BYTES = 32 << 20  # of item texts in one block
POSTINGS = 4 << 20  # (document, item) hits counted at once, but for those of one document

SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = [not chr(i).isalnum() for i in range(128)]


def fold_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals U+00C0 to U+00DE, but for the sign U+00D7, in lower case."""
    hit = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if len(hit):
        data = data.copy()
        data[hit] += 32
    return data


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the texts' offsets in them."""
    low, starts, ends, first = tx.words(fold_latin(data), off, SEPARATOR)
    h = tx.word_hashes(low, starts, ends)
    n = np.diff(first)
    out_n = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(out_n)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], out_n) + np.repeat(first[:-1], out_n)
    size = np.repeat(np.minimum(n, width), out_n)
    acc = tx.mix64(size.astype(_U))
    for k in range(width):
        use = k < size
        acc = np.where(use, tx.mix64(acc * _U(0x9E3779B97F4A7C15) + h[np.where(use, place + k, 0)]), acc) if len(h) else acc
    return acc, at


def word_shingles(text: str | bytes, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The shingles themselves, as tuples of words."""
    raw = text.encode() if isinstance(text, str) else text
    data = fold_latin(np.frombuffer(raw, np.uint8))
    low, starts, ends, _ = tx.words(data, np.array([0, len(raw)]), SEPARATOR)
    b = low.tobytes()
    w = [b[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def bins(doc_size: int, item_size: int, threshold: float = THRESHOLD) -> int | None:
    """Log2 of the number of bins for documents of up to ``doc_size`` and items of at least ``item_size`` shingles; None for the hashes themselves.

    A hash of n is its bin's least of B with probability (1 - exp(-x)) / x, x = n / B;
    those that a pair shares are all not so with that of one, to the power of their number.
    """
    shared = math.ceil(threshold * item_size - 1e-9)
    need = -math.expm1(-MISS / shared)
    best = None
    for b in range(doc_size.bit_length() + SPARE, -1, -1):
        x = doc_size / (1 << b)
        if -math.expm1(-x) / x < need:
            break
        best = b
    return best


class Run:
    """Hashes of a run of documents, and their signatures."""

    def __init__(self, h: np.ndarray, at: np.ndarray):
        self.h, self.n = h, np.diff(at)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        size_class = np.frexp(self.n)[1]  # n < 2**class
        self.classes = {c: np.flatnonzero(size_class == c) for c in np.unique(size_class[self.n > 0]).tolist()}
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def hashes(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a class's documents, and the documents."""
        if c not in self.own:
            take = np.flatnonzero(np.isin(self.doc, self.classes[c])) if len(self.classes) > 1 else slice(None)
            self.own[c] = self.h[take], self.doc[take]
        return self.own[c]

    def signature(self, c: int, b: int) -> np.ndarray:
        """The least hash in each of 2**b bins of each of a class's documents, the largest value in empty ones."""
        if (c, b) not in self.made:
            finer = [k for d, k in self.made if d == c and k > b]
            d = self.classes[c]
            if finer:
                self.made[c, b] = self.made[c, min(finer)].reshape(len(d) << b, -1).min(axis=1)
            else:
                rank = np.zeros(len(self.n), np.int64)
                rank[d] = np.arange(len(d))
                h, doc = self.hashes(c)
                least = np.full(len(d) << b, ~_U(0), _U)
                np.minimum.at(least, (rank[doc] << b) + ((h >> _U(64 - b)).astype(np.int64) if b else 0), h)
                self.made[c, b] = least
        return self.made[c, b]


# -- index ------------------------------------------------------------------

def build_index(items: DataFrame, ws: Workspace, name: str = "items", id: str = "item_id", text: str = "text") -> list[str]:
    """Write blocks of items; returns their folders."""
    spark = items.sparkSession
    small_batches(spark)
    total = items.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    uri = ws.path(name)

    def run(batches):
        ids, present, texts = [], [], []
        for b in batches:
            i = b.column(0)
            ids += i.fill_null(0).to_pylist()
            present += i.is_valid().to_pylist()
            texts += [s.encode() for s in b.column(1).fill_null("").to_pylist()]
        if not ids:
            return
        folder = f"{uri}/{TaskContext.get().partitionId()}"
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        h, cut = shingles(raw, at)
        item = np.repeat(np.arange(len(ids)), np.diff(cut))
        order = np.lexsort((h, item))
        h, item = h[order], item[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        h, item = h[new], item[new]
        sizes = np.bincount(item, minlength=len(ids))
        put_arrays(folder, id=np.array(ids, np.int64), present=np.array(present, np.uint8), size=sizes, text=raw, text_at=at)
        kind = np.array([int(n).bit_length() for n in sizes])[item] if len(item) else item
        kinds = sorted(set(kind.tolist()))
        for k in kinds:
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(h[mine], kind="stable")]
            key, first = np.unique(h[mine], return_index=True)
            put_arrays(f"{folder}/{k}", key=key, at=np.append(first, len(mine)), item=item[mine])
        yield pa.RecordBatch.from_pydict({"folder": [folder], "kinds": [kinds]}, pa.schema([("folder", pa.string()), ("kinds", pa.list_(pa.int32()))]))

    dealt = items.select(F.col(id).cast("long"), text).repartition(1 + int(total // BLOCK_BYTES), F.xxhash64(id, text))
    found = dealt.mapInArrow(frugal(run), "folder string, kinds array<int>").collect()
    return sorted((r["folder"], list(r["kinds"])) for r in found)


class Block:
    """One block, mapped; it answers for a run of documents."""

    def __init__(self, folder: str, kinds: list[int], threshold: float):
        self.threshold = threshold
        self.items = map_arrays(folder)
        self.kinds = {k: map_arrays(f"{folder}/{k}") for k in kinds}
        self.words: dict[int, set] = {}

    @staticmethod
    def _hits(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are keys, and where."""
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        ok = np.flatnonzero(key[at] == h)
        return ok, at[ok]

    def pairs(self, run: Run) -> list[tuple[int, int, int]]:
        """(document, item, shared hashes) that qualify by hash."""
        out = []
        h, doc = run.h, run.doc
        for k, index in sorted(self.kinds.items()):  # those of few shingles need the most bins
            seen = np.zeros(len(run.n), bool)
            for c, d in run.classes.items():
                b = bins((1 << c) - 1, 1 << (k - 1), self.threshold)
                if b is None:
                    own, of = run.hashes(c)
                    ok, _ = self._hits(index["key"], own)
                    seen[of[ok]] = True
                else:
                    least = run.signature(c, b)
                    full = np.flatnonzero(least != ~_U(0))
                    ok, _ = self._hits(index["key"], least[full])
                    seen[d[full[ok] >> b]] = True
            if not seen.any():
                continue
            take = np.flatnonzero(seen[doc])
            ok, where = self._hits(index["key"], h[take])
            both = np.unique(doc[take[ok]] * len(index["key"]) + where)
            d, where = both // len(index["key"]), both % len(index["key"])
            m = index["at"][where + 1] - index["at"][where]
            # shingles that many items share: whole documents at a time, so that their items fit memory
            edges = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)) if len(d) else np.zeros(1, np.int64)
            before, i = np.concatenate([[0], np.cumsum(m)])[edges], 0
            while i < len(edges) - 1:
                j = max(i + 1, int(np.searchsorted(before, before[i] + POSTINGS, "right")) - 1)
                part = slice(edges[i], edges[j])
                out += self._count(index, d[part], where[part], m[part])
                i = j
        return out

    def _count(self, index, d, where, m) -> list[tuple[int, int, int]]:
        post = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index["at"][where], m)
        code, shared = np.unique(np.repeat(d, m) * len(self.items["id"]) + index["item"][post], return_counts=True)
        d, i = code // len(self.items["id"]), code % len(self.items["id"])
        good = shared >= np.ceil(self.threshold * self.items["size"][i] - 1e-9)
        return list(zip(d[good].tolist(), i[good].tolist(), shared[good].tolist(), strict=True))

    def verify(self, item: int, doc_words: set) -> tuple[int, int]:
        """Shared and own shingles of an item, by their words."""
        if item not in self.words:
            if len(self.words) > 10_000:
                self.words.clear()
            a, b = self.items["text_at"][item : item + 2]
            self.words[item] = word_shingles(self.items["text"][a:b].tobytes())
        own = self.words[item]
        return len(own & doc_words), len(own)


def _scan(blocks: list[tuple[str, list[int]]], threshold: float):
    """A function from a run of texts to (document, item id, shared, item's shingles)."""
    mapped = [Block(f, k, threshold) for f, k in blocks]

    def scan(data: np.ndarray, off: np.ndarray):
        run = Run(*shingles(data, off))
        words: tuple[int, set] = (-1, set())
        for b in mapped:
            for d, i, _ in sorted(b.pairs(run)):
                if words[0] != d:
                    words = (d, word_shingles(data[off[d] : off[d + 1]].tobytes()))
                shared, own = b.verify(i, words[1])
                if shared >= threshold * own - 1e-9:
                    yield d, int(b.items["id"][i]) if b.items["present"][i] else None, shared, own

    return scan


def find_contained(docs: DataFrame, items: DataFrame, ws: Workspace, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc id, item_id, shared, item_shingles, containment) of all pairs at or above the threshold."""
    small_batches(docs.sparkSession)
    blocks = build_index(items, ws, id=item_id, text=item_text)
    schema = docs.select(id).schema.add("item_id", "long").add("shared", "long").add("item_shingles", "long").add("containment", "double")

    def run(batches):
        scan = _scan(blocks, threshold)
        for b in batches:
            data, off = tx.utf8(b.column(1))
            for i, j in tx.runs(off):
                found = list(scan(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                if found:
                    d, item, shared, own = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d) if not i else pa.array([i + x for x in d])), pa.array(item, pa.int64()), pa.array(shared), pa.array(own), pa.array([s / o for s, o in zip(shared, own, strict=True)])], [id, "item_id", "shared", "item_shingles", "containment"])

    return docs.select(id, text).mapInArrow(frugal(run), schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, ws: Workspace, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    small_batches(docs.sparkSession)
    blocks = build_index(items, ws)

    def run(batches):
        scan = _scan(blocks, threshold)
        for b in batches:
            data, off = tx.utf8(b.column(b.schema.get_field_index(text)))
            keep = np.ones(len(off) - 1, bool)
            for i, j in tx.runs(off):
                for d, *_ in scan(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    keep[i + d] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(frugal(run), docs.schema)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_SMALL = "".join(chr(ord(c) + 32) for c in _CAPITALS)


def _sql_shingles(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i : i + {WIDTH - 1}], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""


ORACLE = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}),
b AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM p JOIN n USING (item_id) WHERE shared >= {THRESHOLD} * item_shingles - 1e-9
"""
