"""Token ids in bit-packed files: fixed width, block offsets, random access.

A file holds the documents of one range of ids, in ascending order::

    "BMTK"           4 bytes
    data             blocks of ``block`` ids of ``width`` bits, least significant bit first,
                     each begun on a byte
    block table      byte offset of each block in the data, u8 (and the end)
    document table   present u1 | id i8 | offset of the first id u8 (and the end)
    tail             version  width  block  ids  documents (5 x u8)  "BMTK"      little-endian

Blocks are written as they fill, so a task holds one block and the tables.
``width`` is the least number of bits that holds every id of the vocabulary.  A
manifest names the files in order with the ids that precede each.

Tasks write whole files under a temporary name and rename them; a file's name is
its range's number, so a repeated task writes the same file.
"""

from __future__ import annotations

import functools
import io
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .workspace import frugal, parts, small_batches

MAGIC, VERSION, BLOCK = b"BMTK", 2, 1 << 16
_TAIL = struct.Struct("<5Q4s")
FILE_BYTES = 256 << 20  # of texts in one file, or one longer text


# -- packing ----------------------------------------------------------------

def width_of(vocab: int) -> int:
    """Bits for ids 0 to vocab-1."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u8")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    if width % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()
    out = []
    for i in range(0, len(ids), 1 << 15):  # a multiple of 8 ids: whole bytes
        bits = (ids[i : i + (1 << 15), None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: bytes, width: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids that begin ``skip`` bits into ``raw``, each gathered from the bytes that hold it."""
    bit = skip + np.arange(n, dtype=np.int64) * width
    buf, got = np.frombuffer(raw + bytes(8), np.uint8), np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        got |= buf[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((got >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


# -- files ------------------------------------------------------------------

class TokenWriter:
    """Writes one file under a temporary name, and gives it its own when closed."""

    def __init__(self, fs, path: str, width: int, block: int = BLOCK):
        self.fs, self.path, self.width, self.block = fs, path, width, block
        self.part = f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.held, self.waiting, self.n, self.offsets = [], 0, 0, [0]
        self.present, self.doc_id, self.first = [], [], [np.zeros(1, np.int64)]

    def add(self, doc_ids: list[int | None], ids: np.ndarray, cut: np.ndarray) -> None:
        """Documents whose ids are those of ``ids`` between the offsets ``cut``."""
        self.present.append(np.array([i is not None for i in doc_ids], np.uint8))
        self.doc_id.append(np.array([i or 0 for i in doc_ids], "<i8"))
        self.first.append(self.n + np.asarray(cut[1:], np.int64))
        self.n += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._put(self.waiting // self.block * self.block)

    def _put(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for i in range(0, n, self.block):
            raw = pack(ids[i : min(i + self.block, n)], self.width)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.held, self.waiting = [ids[n:].copy()], len(ids) - n

    def close(self) -> int:
        """Write the rest and the tables; returns the number of ids."""
        if self.waiting:
            self._put(self.waiting)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for table in (self.present, self.doc_id, self.first):
            for part in table:
                self.out.write((part if table is not self.first else part.astype("<u8")).tobytes())
        self.out.write(_TAIL.pack(VERSION, self.width, self.block, self.n, sum(map(len, self.doc_id)), MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.n


def write_file(fs, path: str, docs: list[tuple[int | None, np.ndarray]], width: int, block: int = BLOCK) -> int:
    """Write one file; returns the number of ids in it."""
    w = TokenWriter(fs, path, width, block)
    for i, ids in docs:
        w.add([i], ids, np.array([0, len(ids)]))
    return w.close()


class TokenFile:
    """Random access: only the tables and the blocks asked for are read."""

    def __init__(self, fs, path: str):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(_TAIL.size, size - _TAIL.size) if size >= _TAIL.size else b""
        version, self.width, self.block, self.n, self.docs, magic = _TAIL.unpack(tail) if tail else (0,) * 6
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is not a token file of version {VERSION}")
        blocks, self.data = -(-self.n // self.block), len(MAGIC)
        self.f.seek(size - _TAIL.size - 9 * self.docs - 8 * (self.docs + 1) - 8 * (blocks + 1))
        self.offsets = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.present = np.frombuffer(self.f.read(self.docs), np.uint8).astype(bool)
        self.doc_id = np.frombuffer(self.f.read(8 * self.docs), "<i8")
        self.first = np.frombuffer(self.f.read(8 * (self.docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        out = [np.empty(0, np.uint32)]
        for b in range(start // self.block, -(-stop // self.block)):
            a, z = max(start - b * self.block, 0), min(stop - b * self.block, self.block)
            lo, hi = a * self.width // 8, -(-z * self.width // 8)
            self.f.seek(self.data + self.offsets[b] + lo)
            out.append(unpack(self.f.read(hi - lo), self.width, z - a, a * self.width - 8 * lo))
        return np.concatenate(out)

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


# -- encoding ---------------------------------------------------------------

def _rare_space(data: np.ndarray) -> np.ndarray:
    """Places of white space other than the space and the line break, in UTF-8 bytes."""
    found = [np.flatnonzero(_RARE[data])]
    two = np.flatnonzero(data[:-1] == 0xC2)
    found.append(two[np.isin(data[two + 1], (0x85, 0xA0))])
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    if len(three):
        code = (data[three].astype(np.int64) << 16) | (data[three + 1].astype(np.int64) << 8) | data[three + 2]
        found.append(three[np.isin(code, _SPACES)])
    return np.concatenate(found)


def _places(raw: bytes, part: bytes) -> np.ndarray:
    out, at = [], raw.find(part)
    while at >= 0:
        out.append(at)
        at = raw.find(part, at + 1)
    return np.array(out, np.int64)


#: White space by code point; in one byte, then in three.
_RARE = np.isin(np.arange(256), (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F))
_SPACES = [int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    """A byte-level BPE of the tokenizers library, with what it gave for each piece kept for the next time.

    The library's splitting rule always begins a new piece at a space between two
    characters that are not white space, and makes a line break between two such
    a piece of its own; merges never cross pieces.  So such a text is the pieces
    at its spaces and line breaks, each encoded alone.  A text with white space at
    its ends, two together or of a rarer kind, or that holds one of the
    tokenizer's added strings, is encoded whole.

    A piece of up to ``SHORT`` bytes is told apart by a value made of these bytes,
    its length and how it begins; these are kept as a sorted array beside their
    ids, so that a run of texts is put together without a step for each word.
    Longer pieces are looked up by their bytes.  So no two pieces are taken for
    one.
    """

    KEEP = 2_000_000  # pieces kept, of about 30 bytes each
    LONGEST = 256  # bytes of a piece that is kept; texts with longer ones are encoded whole
    SHORT = 7
    RUN = 2 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.vocab = self.t.get_vocab_size()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        rules = json.loads(self.t.to_str())
        pre = rules.get("pre_tokenizer") or {}
        self.added = [x["content"].encode() for x in rules.get("added_tokens") or []]
        between = self.t.encode("a\na", add_special_tokens=False).ids
        self.pieces = rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(between) == 3 and not any(set(x) & set(b" \n") for x in self.added)
        self.line = between[1] if len(between) > 1 else 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted, of short pieces
        self.slot = np.empty(0, np.int64)  # of each key
        self.long: dict[bytes, int] = {}  # slots of others, that after a space with it
        self.ids = np.empty(1 << 16, self.kind)  # of all slots, one after another
        self.at = np.zeros(1 << 16, np.int64)  # where each slot begins, and the last ends
        self.n = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], prefix: str) -> np.ndarray:
        """Encode pieces in one go, a line each: a single line break is a piece of its own.  Returns their slots."""
        if not pieces:
            return np.empty(0, np.int64)
        got = np.array(self.t.encode_batch_fast([prefix + ("\n" + prefix).join([p.decode() for p in pieces])], add_special_tokens=False)[0].ids, self.kind)
        breaks = np.flatnonzero(got == self.line)
        sizes = np.diff(np.concatenate([[-1], breaks, [len(got)]])) - 1
        body = np.delete(got, breaks)
        end = self.at[self.n]
        while end + len(body) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[end : end + len(body)] = body
        self.at[self.n + 1 : self.n + 1 + len(sizes)] = end + np.cumsum(sizes)
        slots = self.n + np.arange(len(sizes))
        self.n += len(sizes)
        return slots

    def _short_slots(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray, raw: bytes) -> np.ndarray:
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = self.keys[where] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if new.any():
            fresh, slots = first[new], np.empty(int(new.sum()), np.int64)
            for prefix, mine in ((" ", spaced[fresh]), ("", ~spaced[fresh])):
                pick = fresh[mine]
                slots[mine] = self._learn([raw[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)], prefix)
            to = np.searchsorted(self.keys, uniq[new])
            self.keys, self.slot = np.insert(self.keys, to, uniq[new]), np.insert(self.slot, to, slots)
        return self.slot[np.searchsorted(self.keys, uniq)][inverse] if len(uniq) else np.empty(0, np.int64)

    def _long_slots(self, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray, raw: bytes) -> list[int]:
        # a piece after a space is looked up with that space, so it is no other piece
        pieces = [raw[a:b] for a, b in zip((starts - spaced).tolist(), ends.tolist(), strict=True)]
        found = list(map(self.long.get, pieces))
        if None in found:
            new = {p for p, k in zip(pieces, found, strict=True) if k is None}
            for prefix in (" ", ""):
                mine = [p for p in new if p.startswith(b" ") == (prefix == " ")]
                self.long.update(zip(mine, self._learn([p[len(prefix) :] for p in mine], prefix).tolist(), strict=True))
            found = [self.long[p] for p in pieces]
        return found

    def run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts given as bytes and offsets, and the texts' offsets in them."""
        n, raw = len(off) - 1, data.tobytes()
        sep = (data == 32) | (data == 10)
        edge = np.ones(len(data) + 1, bool)  # nothing that belongs to the same text comes before
        edge[:-1] = False
        edge[off] = True
        at = np.flatnonzero(sep)
        bad = at[edge[at] | edge[at + 1] | np.append(sep, True)[at + 1]]
        odd = np.zeros(n, bool)
        odd[np.searchsorted(off, np.concatenate([bad, _rare_space(data), *(_places(raw, x) for x in self.added)]), "right") - 1] = True
        if not self.pieces:
            odd[:] = True
        # pieces: what stands between separators; how each begins: 0 its text, 1 after a line break, 2 after a space
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = begins[at + 1] = True
        starts = np.flatnonzero(begins[:-1])
        doc = np.searchsorted(off, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        ends = np.where(edge[ends], ends, ends - 1)
        odd[doc[ends - starts > self.LONGEST]] = True
        use = ~odd[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        how = np.where(edge[starts], 0, np.where(data[np.maximum(starts - 1, 0)] == 10, 1, 2)) if len(starts) else starts
        if self.n > self.KEEP:
            self._forget()
        size, spaced, slot = ends - starts, how == 2, np.empty(len(starts), np.int64)
        short = size <= self.SHORT
        key = tx.head(tx.eights(data), starts[short], size[short]) | ((size[short] + 8 * spaced[short]).astype(np.uint64) << np.uint64(56))
        slot[short] = self._short_slots(key, starts[short], ends[short], spaced[short], raw)
        slot[~short] = self._long_slots(starts[~short], ends[~short], spaced[~short], raw)
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        # a line break's id comes before what follows it
        broken = (how == 1).astype(np.int64) if len(how) else size
        total = size + broken
        end = np.cumsum(total)
        out = np.full(int(end[-1]) if len(end) else 0, self.line, self.kind)
        to = np.arange(int(size.sum()))
        shift = np.repeat(end - size - (np.cumsum(size) - size), size)
        out[to + shift] = self.ids[to + np.repeat(begin - (np.cumsum(size) - size), size)]
        counts = np.bincount(doc, total, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            parts, cut = [], np.concatenate([[0], np.cumsum(counts)])
            done = 0
            for d, ids in zip(which.tolist(), self.whole([raw[off[d] : off[d + 1]].decode() for d in which]), strict=True):
                parts += [out[done : cut[d]], ids]
                done, counts[d] = cut[d], len(ids)
            out = np.concatenate([*parts, out[done:]])
        return out, np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, off = tx.utf8(pa.array(texts, pa.string()))
        ids, cut = self.run(data, off)
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks share what it keeps."""
    return Encoder(path)


# -- operators --------------------------------------------------------------

def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0, files: int | None = None, id: str = "doc_id", text: str = "text") -> dict:
    """Encode ``docs`` into token files under ``uri`` in ascending id order; returns the manifest.

    Each document ends with ``end_id``.  A null text is empty, so it is the end
    id alone.  Null ids come first.  Rows that repeat an id are all kept, in
    order of a hash of their texts, and may span files.  Other columns are not
    looked at.  An empty table gives a manifest without ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    n = files or max(parts(spark), (docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0) // FILE_BYTES)
    dealt = rows.repartitionByRange(n, "id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "text")
    listing = pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        enc, part, w, held = encoder(tokenizer), TaskContext.get().partitionId(), None, 0
        name = f"part-{part:06d}.tok"
        for b in batches:
            ids, (data, off) = b.column(0).to_pylist(), tx.utf8(b.column(1))
            for i, j in tx.runs(off, enc.RUN):
                if w is None:
                    fs, base = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(base, recursive=True)
                    w = TokenWriter(fs, f"{base}/{name}", width_of(enc.vocab))
                got, cut = enc.run(data[off[i] : off[j]], off[i : j + 1] - off[i])
                w.add(ids[i:j], np.insert(got, cut[1:], enc.kind(end_id)), cut + np.arange(len(cut)))
                held += j - i
        if w is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "documents": [held], "ids": [w.close()]}, listing)

    at, listed = 0, []
    for r in sorted(dealt.mapInArrow(frugal(run), "part int, name string, documents long, ids long").collect()):
        listed.append({"name": r["name"], "documents": r["documents"], "ids": r["ids"], "start": at})
        at += r["ids"]
    manifest = {"version": VERSION, "ids": at, "files": listed}
    put_manifest(uri, manifest)
    return manifest


def put_manifest(uri: str, manifest: dict) -> None:
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())


def read_manifest(uri: str) -> dict:
    fs, base = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.load(io.BytesIO(f.read()))


def read_documents(spark: SparkSession, uri: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    files = read_manifest(uri)["files"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for k in b.column(0).to_pylist():
                t = TokenFile(fs, f"{base}/{files[k]['name']}")
                i = 0
                while i < t.docs:
                    j = max(i + 1, int(np.searchsorted(t.first, t.first[i] + (1 << 20), "right")) - 1)
                    ids = t.ids(int(t.first[i]), int(t.first[j])).astype("<u4")
                    cut = t.first[i : j + 1] - t.first[i]
                    crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(t.doc_id[i:j], pa.int64(), mask=~t.present[i:j]), pa.array(t.first[i:j] + files[k]["start"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], schema=schema)
                    i = j

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
