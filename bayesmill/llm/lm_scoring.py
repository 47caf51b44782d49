"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score.

No pass gathers more than per-shard totals on the driver:

1. Words.  Each task hashes the words of its texts, counts them, and sends its
   counts by hash range.  One task per range writes the sorted hashes and the
   counts.  A word's id is its rank over all ranges.
2. Word pairs.  Each task looks ids up in the mapped arrays and collects pairs.
   A pair of ids is mixed by a bijection (four Feistel rounds), so pairs cannot
   collide, and is dealt by its first half, so no word, however frequent, makes a
   large task.  A pair's place is its shard and its rank there.
3. Word triples (order 3).  A triple is the place of its first two words and the
   id of the third; it is dealt to that pair's shard and stored sorted, a
   context's followers side by side from a place that is stored for each pair.  Each triple then counts once for its
   last two words: that is the pair's value in the model of order 2 below.
4. Words as contexts and as followers: sums over pairs, dealt by id.
5. Scores.  Each task looks up the distinct triples of a run of texts, then pairs,
   then words.

With V known words and the unknown one, words back off to 1/(V+1).  Every text is
preceded by start marks and followed by an end token.  Sorted keys travel as
differences of as few bytes as they need, and are stored without the bits that a
table of offsets gives.

Words are told apart by 64-bit hashes (:func:`~bayesmill.llm.text.word_hashes`),
so two of n words count as one with a chance of about n**2 / 2**65.

Defined cases: a null text is empty and consists of the end token; a null
document id hashes as the empty string; repeated rows count as often as they
occur; with no training text every probability is 1/(V+1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .workspace import Workspace, frugal, map_arrays, parts, put_arrays, small_batches

_U = np.uint64
END = np.uint64(0x5F1D36F1A9C4E2B7)  # the end token's hash; words' hashes are spread over all values
START_ID = 0
FLUSH = 3_000_000
SHARD_BYTES = 128 << 20  # of training texts for each shard
GATHER = 4_000_000  # followers summed at a time
RUN = 2 << 20  # bytes of texts looked up together, or one longer text


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a run of texts, each text's end token included, and the texts' offsets in them."""
    low, starts, ends, first = tx.words(data, off)
    h = tx.word_hashes(low, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(h) + len(n), END, _U)
    out[np.arange(len(h)) + doc] = h
    return out, first + np.arange(len(first))


def _texts(batches, name="text"):
    """Runs of texts of bounded size, with the rows they are."""
    for b in batches:
        data, off = tx.utf8(b.column(b.schema.get_field_index(name)))
        for i, j in tx.runs(off, RUN):
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


# -- sorted keys ------------------------------------------------------------

def _least(c: np.ndarray) -> np.ndarray:
    """The counts in as few bytes as the largest needs."""
    return c.astype(np.min_scalar_type(int(c.max()))) if len(c) else c.astype(np.uint8)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Different sorted keys: the first, and the differences in as few bytes as the largest needs."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, _U)
    width = raw[8]
    d = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(d) + 1, 8), np.uint8)
    wide[1:, :width] = d
    out = wide.view("<u8")[:, 0]
    out[0] = np.frombuffer(raw, "<u8", 1)[0]
    return np.cumsum(out, dtype=_U)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, _U), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(c[order], at) if len(at) else c


def _counted(hi: np.ndarray, lo: np.ndarray, bits: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (hi, lo) in order, and how often each occurs; lo has ``bits`` bits, both have ``total``."""
    if total <= 64:
        k, n = np.unique((hi << _U(bits)) | lo, return_counts=True)
        return k >> _U(bits), k & _U((1 << bits) - 1), n
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    at = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.empty(0, np.int64)
    return hi[at], lo[at], np.diff(np.append(at, len(hi)))


class Shards:
    """Where shards begin among the values of ``hi``, of which ``lo`` has ``bits`` bits more."""

    def __init__(self, begin: np.ndarray, bits: int):
        self.begin, self.bits = begin.astype(_U), bits

    @classmethod
    def even(cls, n: int, size: int, bits: int) -> Shards:
        """``n`` shards of the values below ``size``."""
        step = -(-size // n)
        return cls(np.array([min(i * step, (1 << 64) - 1) for i in range(n)], _U), bits)

    def cut(self, hi: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(hi, self.begin[1:]), [len(hi)]])

    def keys(self, s: int, hi: np.ndarray, lo: np.ndarray | int) -> np.ndarray:
        """Keys within a shard."""
        return ((hi - self.begin[s]) << _U(self.bits)) | lo

    def rows(self, hi: np.ndarray, lo: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted (hi, lo) and their counts, a row for each shard."""
        found = []
        cut = self.cut(hi)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                c = _least(n[a:b])
                found.append((s, pack_sorted(self.keys(s, hi[a:b], lo[a:b] if lo is not None else _U(0))), c.tobytes(), c.itemsize))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), PACKED_TYPES, strict=True)], ["shard", "keys", "counts", "width"])


PACKED = "shard int, keys binary, counts binary, width int"
PACKED_TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.int32())


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a shard's rows."""
    counts = [np.frombuffer(x.as_py(), f"u{w.as_py()}").astype(np.int64) for x, w in zip(rows["counts"], rows["width"], strict=True)]
    return _merge([unpack_sorted(x.as_py()) for x in rows["keys"]], counts)


class _Flushed:
    """Collects (hi, lo) and gives their counted rows whenever there are many."""

    def __init__(self, shards: Shards, total: int):
        self.shards, self.total, self.held, self.n = shards, total, [], 0

    def add(self, hi: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((hi, lo))
        self.n += len(hi)
        if self.n > FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            hi, lo = (np.concatenate(x) for x in zip(*self.held, strict=True))
            yield from self.shards.rows(*_counted(hi, lo, self.shards.bits, self.total))
        self.held, self.n = [], 0


def sorted_arrays(keys: np.ndarray) -> dict[str, np.ndarray]:
    """How different sorted keys are stored: their last 32 bits, and where each value of the rest begins; whole if there would be too many of those."""
    top = int(keys[-1] >> _U(32)) if len(keys) else 0
    if top > len(keys) + 1024:
        return {"whole": keys}
    return {"low": keys.astype(np.uint32), "at": np.searchsorted(keys, np.arange(top + 2, dtype=_U) << _U(32)).astype(np.int64) if top + 1 < 1 << 32 else np.array([0, len(keys)])}


def places(m: dict[str, np.ndarray], q: np.ndarray) -> np.ndarray:
    """How many stored keys are below each of the sorted q."""
    if "whole" in m:
        return m["whole"].searchsorted(q)
    low, at = m["low"], m["at"]
    top = np.minimum(q >> _U(32), _U(len(at) - 1)).astype(np.int64)
    a, z, x = at[top], at[np.minimum(top + 1, len(at) - 1)], q.astype(np.uint32)
    edge = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(q) else np.empty(0, np.int64)
    if 8 * len(edge) > len(q):
        return within(low, a, z, x)
    out = np.empty(len(q), np.int64)
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(q)], strict=True):
        out[i:j] = a[i] + low[a[i] : z[i]].searchsorted(x[i:j])
    return out


def within(low: np.ndarray, a: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each range [a, z) of ``low``, sorted there, its first place with x or more."""
    a, z = a.copy(), z.copy()
    go = np.flatnonzero(a < z)
    while len(go):
        mid = (a[go] + z[go]) >> 1
        less = low[mid] < x[go]
        a[go[less]] = mid[less] + 1
        z[go[~less]] = mid[~less]
        go = go[a[go] < z[go]]
    return a


def ranks(m: dict[str, np.ndarray], q: np.ndarray) -> np.ndarray:
    """The place of each of q among stored keys, or -1."""
    at, n = places(m, q), len(m["whole"] if "whole" in m else m["low"])
    if not n:
        return np.full(len(q), -1)
    there = np.minimum(at, n - 1)
    if "whole" in m:
        same = m["whole"][there] == q
    else:
        top = (q >> _U(32)).astype(np.int64)
        same = (m["low"][there] == q.astype(np.uint32)) & (at < m["at"][np.minimum(top + 1, len(m["at"]) - 1)])
    return np.where(same & (at < n), at, -1)


class _Mapped:
    """A table's shards, mapped once in each worker."""

    def __init__(self, uri: str, sizes: np.ndarray, shards: Shards):
        self.uri, self.sizes, self.shards = uri, sizes, shards
        self.maps: dict[int, dict[str, np.ndarray]] = {}

    def shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self.maps:
            self.maps[s] = map_arrays(f"{self.uri}/{s}")
        return self.maps[s]

    def ranks(self, hi: np.ndarray, lo: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For sorted (hi, lo): shards and places there, or -1."""
        shard, out = np.zeros(len(hi), np.int64), np.full(len(hi), -1, np.int64)
        cut = self.shards.cut(hi)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            shard[a:b] = s
            if b > a and self.sizes[s]:
                out[a:b] = ranks(self.shard(s), self.shards.keys(s, hi[a:b], lo[a:b] if lo is not None else _U(0)))
        return shard, out

    def values(self, shard: np.ndarray, place: np.ndarray, name: str) -> np.ndarray:
        """The value stored at each place; 0 at -1.  Shards are in order."""
        out = np.zeros(len(place), np.int64)
        cut = np.searchsorted(shard, np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[s], cut[s + 1])
            if self.sizes[s]:
                stored = self.shard(s)[name]
                if len(stored):
                    out[mine] = np.where(place[mine] >= 0, stored[place[mine]], 0)
        return out


# -- pairs ------------------------------------------------------------------

_KEYS = np.random.Generator(np.random.PCG64(20240310)).integers(0, 1 << 64, 4, dtype=np.uint64)


def mix_pair(v: np.ndarray, w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection on pairs of values of ``bits`` bits that spreads both over both."""
    v, w, mask = v.astype(_U), w.astype(_U), _U((1 << bits) - 1)
    for k in _KEYS:
        v, w = w, v ^ (tx.mix64(w + k) & mask)
    return v, w


def unmix_pair(v: np.ndarray, w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << bits) - 1)
    for k in _KEYS[::-1]:
        v, w = w ^ (tx.mix64(v + k) & mask), v
    return v, w


def discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of things seen 1 to 4 times; k/2 where these are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k) if n[k - 1] and n[k] and y else k / 2 for k in (1, 2, 3)]


def _seen(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


class Model:
    """Where the arrays are, and the numbers that belong to them."""

    def __init__(self, uri: str, order: int, words: Shards, word_sizes: np.ndarray, total: int):
        self.uri, self.order, self.words, self.word_sizes, self.total = uri, order, words, word_sizes, total
        self.starts = np.concatenate([[0], np.cumsum(word_sizes)])
        self.vocab = int(self.starts[-1])
        self.bits = max(1, self.vocab.bit_length())  # of an id
        # keys within a shard of pairs have 64 bits at most, so very many words ask for more shards
        self.n = max(len(word_sizes), 1 << max(0, 2 * self.bits - 64))
        self.pairs = Shards.even(self.n, 1 << self.bits, self.bits)
        self.pair_sizes = np.zeros(self.n, np.int64)
        self.ranges = -(-(self.vocab + 1) // self.n)
        self.discounts: list[list[float]] = []  # of words, pairs and triples
        self.types, self.left, self.stored = 0, 0.0, set()

    def triples(self) -> Shards:
        """Triples lie in the shards of their first two words, whose ranks over all shards are ``hi``."""
        return Shards(np.concatenate([[0], np.cumsum(self.pair_sizes)[:-1]]), self.bits)


class _Ids:
    """Ids and counts of tokens, from the mapped words."""

    def __init__(self, m: Model):
        self.m, self.table = m, _Mapped(f"{m.uri}/words", m.word_sizes, m.words)

    def __call__(self, toks: np.ndarray, counted: bool = False):
        """The tokens' places among the distinct ones, the ids of these (-1: unknown), and their counts."""
        uniq, inverse = np.unique(toks, return_inverse=True)
        shard, place = self.table.ranks(uniq, None)
        ids = np.where(place >= 0, place + self.m.starts[shard] + 1, -1)
        return inverse, ids, self.table.values(shard, place, "count") if counted else None


def _before(x: np.ndarray, at: np.ndarray, first: int = START_ID) -> np.ndarray:
    """Of each token of each text the value of the one before; ``first`` for the first of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


# -- training ---------------------------------------------------------------

def train(docs: DataFrame, ws: Workspace, shards: int, text: str = "text", order: int = 3) -> Model:
    """Count ``docs`` into a model of order 2 or 3 whose arrays lie in ``ws``."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    uri, texts = ws.uri, docs.select(text)
    small_batches(docs.sparkSession)
    deal = Shards.even(shards, 1 << 64, 0)

    def count_words(batches):
        keys, counts, held = [], [], 0
        for _, data, off in _texts(batches, text):
            k, c = np.unique(tokens(data, off)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > FLUSH:
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], 0
                if len(k) > FLUSH // 2:
                    yield from deal.rows(k, None, c)
                    keys, counts = [], []
        k, c = _merge(keys, counts)
        yield from deal.rows(k, None, c)

    def store_words(key, rows):
        s = key[0].as_py()
        k, c = _merged(rows)
        put_arrays(f"{uri}/words/{s}", **sorted_arrays(k), count=_least(c))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(k)], "total": [int(c.sum())]})

    got = texts.mapInArrow(frugal(count_words), PACKED).groupBy("shard").applyInArrow(store_words, "shard int, n long, total long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in got:
        sizes[r["shard"]] = r["n"]
    m = Model(uri, order, deal, sizes, sum(r["total"] for r in got))

    def pairs_of(batches, ids):
        """Per run: mixed pairs of each token with the one before, and the ids."""
        for _, data, off in _texts(batches, text):
            toks, at = tokens(data, off)
            inverse, known, _ = ids(toks)
            w = known[inverse].astype(_U)
            yield *mix_pair(_before(w, at), w, m.bits), w, at

    start = mix_pair(np.zeros(1, _U), np.zeros(1, _U), m.bits)  # two start marks, the context of a text's first token

    def count_pairs(batches):
        ids, out = _Ids(m), _Flushed(m.pairs, 2 * m.bits)
        for hi, lo, _, _ in pairs_of(batches, ids):
            if order == 3:
                hi, lo = np.append(hi, start[0]), np.append(lo, start[1])
            yield from out.add(hi, lo)
        yield from out.rest()

    def store_pairs(key, rows):
        s = key[0].as_py()
        k, c = _merged(rows)
        put_arrays(f"{uri}/pairs/{s}", **sorted_arrays(k))
        if order == 3:
            return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(k)]})
        put_arrays(f"{uri}/values/{s}", value=_least(c))
        return _about_words(m, s, k, c)

    grouped = texts.mapInArrow(frugal(count_pairs), PACKED).groupBy("shard")
    if order == 2:
        return _finish(m, grouped.applyInArrow(store_pairs, PARTIAL))
    for r in grouped.applyInArrow(store_pairs, "shard int, n long").collect():
        m.pair_sizes[r["shard"]] = r["n"]
    deal3, types = m.triples(), int(m.pair_sizes.sum())

    def count_triples(batches):
        ids, table = _Ids(m), _Mapped(f"{uri}/pairs", m.pair_sizes, m.pairs)
        out = _Flushed(deal3, types.bit_length() + m.bits)
        first = table.ranks(*start)
        for hi, lo, w, at in pairs_of(batches, ids):
            uniq_hi, uniq_lo, inverse = _distinct(hi, lo, m.bits)
            shard, place = table.ranks(uniq_hi, uniq_lo)
            rank = (deal3.begin[shard].astype(np.int64) + place)[inverse]
            yield from out.add(_before(rank, at, int(deal3.begin[first[0]][0]) + int(first[1][0])).astype(_U), w)
        yield from out.rest()

    def store_triples(key, rows):
        s = key[0].as_py()
        k, c = _merged(rows)
        # each context's followers lie side by side, by id
        first = np.searchsorted(k >> _U(m.bits), np.arange(m.pair_sizes[s] + 1, dtype=_U))
        last = k & _U((1 << m.bits) - 1)
        put_arrays(f"{uri}/triples/{s}", first=first.astype(np.min_scalar_type(len(k) | 1 << 16)), word=last.astype(np.uint32 if m.bits <= 32 else _U), count=_least(c))
        # each triple counts once for its last two words
        own = map_arrays(f"{uri}/pairs/{s}")
        context = _all_keys(own)[(k >> _U(m.bits)).astype(np.int64)]
        _, v = unmix_pair((context >> _U(m.bits)) + m.pairs.begin[s], context & _U((1 << m.bits) - 1), m.bits)
        hi, lo, n = _counted(*mix_pair(v, last, m.bits), m.bits, 2 * m.bits)
        batches = [b.append_column("seen", pa.array([None] * b.num_rows, pa.list_(pa.int64()))) for b in m.pairs.rows(hi, lo, n)]
        batches.append(pa.RecordBatch.from_pydict({"shard": [s], "keys": [b""], "counts": [b""], "width": [1], "seen": [_seen(c)]}, pa.schema([*zip(("shard", "keys", "counts", "width"), PACKED_TYPES, strict=True), ("seen", pa.list_(pa.int64()))])))
        return pa.Table.from_batches(batches)

    def store_values(key, rows):
        s = key[0].as_py()
        k, n = _merged(rows)
        own = map_arrays(f"{uri}/pairs/{s}")
        value = np.zeros(m.pair_sizes[s], np.int64)
        value[ranks(own, k)] = n
        put_arrays(f"{uri}/values/{s}", value=_least(value))
        used = value > 0  # all but the two start marks
        seen = [x for x in rows["seen"].to_pylist() if x]
        return _about_words(m, s, _all_keys(own)[used], value[used], [sum(x) for x in zip(*seen, strict=True)] or [0] * 4)

    grouped = texts.mapInArrow(frugal(count_triples), PACKED).groupBy("shard")
    of_pairs = grouped.applyInArrow(store_triples, f"{PACKED}, seen array<long>").groupBy("shard")
    return _finish(m, of_pairs.applyInArrow(store_values, PARTIAL))


PARTIAL = "range int, keys binary, counts binary, width int, pairs long, pairs_seen array<long>, triples_seen array<long>"
_PARTIAL = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("width", pa.int32()), ("pairs", pa.int64()), ("pairs_seen", pa.list_(pa.int64())), ("triples_seen", pa.list_(pa.int64()))])


def _all_keys(m: dict[str, np.ndarray]) -> np.ndarray:
    """The stored keys."""
    if "whole" in m:
        return m["whole"]
    return (np.repeat(np.arange(len(m["at"]) - 1, dtype=_U), np.diff(m["at"])) << _U(32)) | m["low"]


def _distinct(hi: np.ndarray, lo: np.ndarray, bits: int, total: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (hi, lo) in order, and the place of each among them; lo has ``bits`` bits, both have ``total``, or twice as many."""
    if (total or 2 * bits) <= 64:
        k, inverse = np.unique((hi << _U(bits)) | lo, return_inverse=True)
        return k >> _U(bits), k & _U((1 << bits) - 1), inverse
    order = np.lexsort((lo, hi))
    new = np.append(True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])) if len(hi) else np.empty(0, bool)
    inverse = np.empty(len(hi), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return hi[order][new], lo[order][new], inverse


def _about_words(m: Model, s: int, keys: np.ndarray, value: np.ndarray, triples_seen: list[int] | None = None) -> pa.Table:
    """What a shard's pairs say of words, by ranges of ids: id * 8 + code, summed here before they travel.

    Code 1: different words before it; 2 to 4: followers of value 1, 2 and more; 5: the sum of its followers' values.
    """
    v, w = unmix_pair((keys >> _U(m.bits)) + m.pairs.begin[s], keys & _U((1 << m.bits) - 1), m.bits)
    ones = np.ones(len(keys), np.int64)
    code, n = _merge([w * _U(8) + _U(1), v * _U(8) + np.minimum(value, 3).astype(_U) + _U(1), v * _U(8) + _U(5)], [ones, ones, value])
    to = (code >> _U(3)).astype(np.int64) // m.ranges
    cut = np.searchsorted(to, np.arange(m.n + 1))
    zero = [0] * 4
    out = [(r, pack_sorted(code[a:b]), (c := _least(n[a:b])).tobytes(), c.itemsize, 0, zero, zero) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    out.append((s, b"", b"", 1, len(keys), _seen(value), triples_seen or zero))
    return pa.Table.from_pydict(dict(zip(_PARTIAL.names, map(list, zip(*out, strict=True)), strict=True)), _PARTIAL)


def _finish(m: Model, partial: DataFrame) -> Model:
    """Store what is known of words, and the model's discounts."""
    uri = m.uri

    def store(key, rows):
        r = key[0].as_py()
        codes, n = _merged(rows)
        dense = np.zeros((m.ranges, 8), np.int64)
        dense[(codes >> _U(3)).astype(np.int64) - r * m.ranges, (codes & _U(7)).astype(np.int64)] = n
        before = dense[:, 1]
        put_arrays(f"{uri}/contexts/{r}", before=_least(before), once=_least(dense[:, 2]), twice=_least(dense[:, 3]), more=_least(dense[:, 4]), sum=_least(dense[:, 5]))
        total = lambda name: [sum(x) for x in zip(*rows[name].to_pylist(), strict=True)]
        return pa.table({"r": pa.array([r], pa.int32()), "types": [int((before > 0).sum())], "seen": [_seen(before)], "pairs": [sum(rows["pairs"].to_pylist())], "pairs_seen": [total("pairs_seen")], "triples_seen": [total("triples_seen")]})

    got = partial.groupBy("range").applyInArrow(store, "r int, types long, seen array<long>, pairs long, pairs_seen array<long>, triples_seen array<long>").collect()
    add = lambda name: [sum(r[name][i] for r in got) for i in range(4)]
    seen, m.types = add("seen"), sum(r["pairs"] for r in got)
    m.discounts = [discounts(seen), discounts(add("pairs_seen")), discounts(add("triples_seen"))]
    e = m.discounts[0]
    m.left = (e[0] * seen[0] + e[1] * seen[1] + e[2] * (sum(r["types"] for r in got) - seen[0] - seen[1])) / max(m.types, 1)
    m.stored = {r["r"] for r in got}
    return m


# -- scoring ----------------------------------------------------------------

def _cut(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discounts."""
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


class Scorer:
    """Reads a model in a worker."""

    def __init__(self, m: Model):
        self.m, self.ids = m, _Ids(m)
        self.pairs = _Mapped(f"{m.uri}/pairs", m.pair_sizes if m.order == 3 else np.ones(m.n, np.int64), m.pairs)
        self.values = _Mapped(f"{m.uri}/values", self.pairs.sizes, m.pairs)
        self.triples = _Mapped(f"{m.uri}/triples", self.pairs.sizes, m.triples() if m.order == 3 else m.pairs)
        self.context: dict[int, dict[str, np.ndarray]] = {}
        self.long: dict[tuple[int, int], tuple] = {}  # what is known of contexts with many followers

    def _by_id(self, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Dense per-word numbers for sorted known ids."""
        out, size = [np.zeros(len(ids), np.int64) for _ in names], self.m.ranges
        for r in np.unique(ids // size).tolist():
            a, b = np.searchsorted(ids, [r * size, (r + 1) * size])
            if r not in self.context:  # a range without words has no arrays
                self.context[r] = map_arrays(f"{self.m.uri}/contexts/{r}") if r in self.m.stored else {}
            for o, name in zip(out, names, strict=True):
                if name in self.context[r]:
                    o[a:b] = self.context[r][name][ids[a:b] - r * size]
        return out

    def _followers(self, s: int, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """For contexts of a shard, whose triples lie in [a, z): the sum of their followers' counts, and how many have 1, 2 and more."""
        count = self.triples.shard(s)["count"]
        out, n, i = np.zeros((len(a), 4), np.int64), z - a, 0
        ends = np.cumsum(n)
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GATHER, "right")))
            if n[i] > GATHER // 8:
                j, key = i + 1, (s, int(a[i]))
                if key not in self.long:
                    c = count[a[i] : z[i]]
                    self.long[key] = int(c.sum(dtype=np.int64)), int((c == 1).sum()), int((c == 2).sum()), int((c > 2).sum())
                out[i] = self.long[key]
            else:
                m = n[i:j]
                full = np.flatnonzero(m)
                if len(full):
                    head = np.cumsum(m) - m
                    c = count[np.arange(int(m.sum())) + np.repeat(a[i:j] - head, m)]
                    for k, x in enumerate((c, c == 1, c == 2)):
                        out[i + full, k] = np.add.reduceat(x, head[full], dtype=np.int64)
                    out[i:j, 3] = m - out[i:j, 1] - out[i:j, 2]
            i = j
        return out

    def score(self, toks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability of each token."""
        m = self.m
        inverse, ids, count = self.ids(toks, counted=True)
        known = ids >= 0
        kid = np.unique(np.append(ids[known], START_ID))
        before, once, twice, more, total = self._by_id(kid, ("before", "once", "twice", "more", "sum"))
        if not m.types:
            return count[inverse], np.full(len(toks), np.log10(self.uniform))
        # words: discounted numbers of left neighbours, over all pairs, with the rest spread evenly
        p1 = np.full(len(ids), self.uniform)
        p1[known] += (_cut(before, m.discounts[0]) / m.types)[np.searchsorted(kid, ids[known])]
        # pairs: what a word's followers have, and the share that their discounts leave to words
        d = m.discounts[1]
        rest = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
        w = ids[inverse]
        v = _before(w, at)
        context = np.searchsorted(kid, v)  # of unknown words: 0, and not used
        p = np.where(v >= 0, rest[context], 1.0) * p1[inverse]
        both = (v >= 0) & (w >= 0)
        hi, lo, back = _distinct(*mix_pair(v[both], w[both], m.bits), m.bits)
        shard, place = self.pairs.ranks(hi, lo)
        value = self.values.values(shard, place, "value")
        p[both] += _cut(value, d)[back] / np.maximum(total[context[both]], 1)
        if m.order == 3:
            p = self._triples(p, w, at, both, shard, place, back)
        return count[inverse], np.log10(p)

    def _triples(self, p, w, at, both, shard, place, back) -> np.ndarray:
        """The probabilities of order 3 from those of order 2."""
        m, d = self.m, self.m.discounts[2]
        deal = self.triples.shards
        # of each token the rank of the pair that ends with it, or -1, and so of the pair before each token
        pair = np.full(len(w), -1, np.int64)
        pair[both] = np.where(place >= 0, deal.begin[shard].astype(np.int64) + place, -1)[back]
        s0, p0 = self.pairs.ranks(*mix_pair(np.zeros(1, _U), np.zeros(1, _U), m.bits))
        context = _before(pair, at, int(deal.begin[s0[0]]) + int(p0[0]))
        # context by context, and the words after it
        some = np.flatnonzero(context >= 0)
        bits = int(m.pair_sizes.sum()).bit_length() + m.bits + 1
        lo = np.where(w[some] >= 0, w[some], m.vocab + 1).astype(_U)  # of unknown words: no id
        uniq, last, back = _distinct(context[some].astype(_U), lo, m.bits + 1, bits)
        first = np.flatnonzero(np.append(True, uniq[1:] != uniq[:-1])) if len(uniq) else np.empty(0, np.int64)
        each, of = uniq[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(uniq))))
        stats, count = np.zeros((len(first), 4), np.int64), np.zeros(len(uniq), np.int64)
        cut, steps = deal.cut(each), np.append(first, len(uniq))
        for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                t = self.triples.shard(s)
                own = (each[i:j] - deal.begin[s]).astype(np.int64)
                a, z = (t["first"][k].astype(np.int64) for k in (own, own + 1))
                stats[i:j] = self._followers(s, a, z)
                mine = slice(steps[i], steps[j])
                x, end, n = last[mine], z[of[mine] - i], len(t["count"])
                at3 = within(t["word"], a[of[mine] - i], end, x)
                if n:
                    hit = (at3 < end) & (t["word"][np.minimum(at3, n - 1)] == x)
                    count[mine] = np.where(hit, t["count"][np.where(hit, at3, 0)], 0)
        total = stats[:, 0]
        rest = np.where(total > 0, stats[:, 1:] @ np.array(d) / np.maximum(total, 1), 1.0)
        seen = _cut(count, d) / np.maximum(total[of], 1)
        p[some] = rest[of][back] * p[some] + seen[back]
        return p

    @property
    def uniform(self) -> float:
        """An unknown word's probability: what the discounts leave, spread over V+1 words."""
        m = self.m
        return (m.left if m.types else 1.0) / (m.vocab + 1)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: n_tokens, n_known, base_score and score (log10); ``keep`` names further columns to carry."""
    small_batches(docs.sparkSession)
    schema = docs.select(id, *keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def run(batches):
        s = Scorer(model)
        for rows, data, off in _texts(batches, text):
            toks, at = tokens(data, off)
            count, lp = s.score(toks, at)
            base = np.log10((count + 1) / (model.total + model.vocab + 1))
            cols = [np.diff(at), np.add.reduceat((count > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(lp, at[:-1])]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns - 1)), *map(pa.array, cols)], [id, *keep, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(id, *keep, text).mapInArrow(frugal(run), schema)


def held_out(id: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """A shard for each ``SHARD_BYTES`` of texts, and as many as the session's shuffles have at least."""
    n = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(8, parts(docs.sparkSession), -(-n // SHARD_BYTES))


def perplexity_scores(docs: DataFrame, ws: Workspace, shards: int | None = None, order: int = 3) -> DataFrame:
    """Learn from the rows that are not held out, score all rows, and free the model."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    model = train(docs.where(~F.col("held_out")), ws, shards or shards_for(docs), order=order)
    return ws.finish(score(docs, model, keep=("held_out",)).withColumn("train_tokens", F.lit(model.total).cast("long")), "scores")
