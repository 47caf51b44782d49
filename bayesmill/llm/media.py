"""Media columns: PNG in binary columns, and hashes of its low frequencies.

Encoding cuts a payload into rows of 8-bit samples, gives each row the filter
that leaves the fewest different values, compresses them as one zlib stream and
puts that into chunks, each with its checksum.  A private chunk keeps the
payload's length.  Decoding tests the signature, every chunk's checksum, the
order of chunks, the stream's own checksum and the number of samples, and undoes
the filters with numpy: rows of filters that do not look at both neighbours by
sums, others along the diagonals of all images of a batch at once.

The hash of an image is the sign of its 63 lowest cosine coefficients (of 8 x 8,
without the mean) against their median, on a 32 x 32 area average, and one bit
for the mean itself.

Defined cases: a null payload is empty; an empty payload is one row of padding;
equal payloads give equal bytes and hashes; a damaged image gives a null payload
and says why in ``error``, and its row stays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .workspace import frugal, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, PAD = 192, 32
IDAT = 1 << 16
RUN = 1 << 20  # bytes of images decoded together, or one longer image
LENGTH = b"paLn"


class MediaError(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH, kind: int | None = None, level: int = 6) -> bytes:
    """A greyscale PNG of ``width`` samples a row, the last row padded with spaces; ``kind`` is the filter of all rows, None the best of each."""
    n = len(payload)
    rows = max(1, -(-n // width))
    x = np.frombuffer(payload.ljust(rows * width, bytes([PAD])), np.uint8).reshape(rows, width)
    out = np.empty((rows, width + 1), np.uint8)
    if kind is None:
        best = np.full(rows, width + 1)
        for k in range(5):
            y = _filter(x, k)
            few = _different(y)
            use = few < best
            best[use] = few[use]
            out[use, 0] = k
            out[use, 1:] = y[use]
    else:
        out[:, 0] = kind
        out[:, 1:] = _filter(x, kind)
    z = zlib.compress(out.tobytes(), level)
    return b"".join([
        SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)), _chunk(LENGTH, struct.pack(">Q", n)),
        *(_chunk(b"IDAT", z[i : i + IDAT]) for i in range(0, len(z), IDAT)), _chunk(b"IEND", b""),
    ])


def _different(x: np.ndarray) -> np.ndarray:
    """How many different values each row has."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        seen = np.zeros(len(part) << 8, bool)
        seen[((np.arange(len(part)) << 8)[:, None] + part).ravel()] = True
        out[i : i + 4096] = seen.reshape(-1, 256).sum(axis=1)
    return out


def _filter(x: np.ndarray, kind: int) -> np.ndarray:
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    if kind == 0:
        return x
    if kind in (1, 2):
        return x - (left, up)[kind - 1]
    a, b, c = (v.astype(np.int16) for v in (left, up, corner))
    if kind == 3:
        return x - ((a + b) // 2).astype(np.uint8)
    if kind == 4:
        return x - _paeth(a, b, c).astype(np.uint8)
    raise MediaError("no such filter")


def _paeth(a, b, c):
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples (one byte a pixel) of one image from its filtered rows."""
    return unfilter_all([(kinds, rows)])[0]


def unfilter_all(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Samples of each image (filters, filtered rows)."""
    out: list[np.ndarray] = [None] * len(images)
    waves: dict[int, list[int]] = {}
    for i, (kinds, rows) in enumerate(images):
        if len(kinds) and kinds.max() > 4:
            raise MediaError(f"filter {kinds.max()}")
        if len(kinds) and kinds.max() > 2:
            waves.setdefault(rows.shape[1], []).append(i)
        else:
            out[i] = _by_sums(kinds, rows)
    for some in waves.values():
        sizes = [len(images[i][0]) for i in some]
        got = _by_diagonals(np.concatenate([images[i][0] for i in some]), np.concatenate([images[i][1] for i in some]), np.array(sizes))
        for i, x in zip(some, np.split(got, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = x
    return out


def _by_sums(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of rows with one of the filters 0 to 2 are done at once."""
    if not kinds.any():
        return rows
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        r = rows[i:j]
        if kinds[i] == 0:
            out[i:j] = r
        elif kinds[i] == 1:
            out[i:j] = np.cumsum(r, axis=1, dtype=np.uint8)
        else:
            out[i:j] = np.cumsum(r, axis=0, dtype=np.uint8) + above
        above = out[j - 1]
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Images one below the other, of ``sizes`` rows each.

    A sample needs those to its left, above and above left, so the samples whose
    row (in its image) and column have one sum are done together.
    """
    n, width = rows.shape
    y = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(y, kind="stable")  # rows at work are then a slice
    y, kinds = y[order], kinds[order].astype(np.int64)
    flat = np.zeros((n + 1) * (width + 1), np.uint8)  # a column of zeros before each row, and a row of them for what has none above
    here = order * (width + 1)
    above = np.where(y == 0, n, order - 1) * (width + 1)
    source, start = rows.ravel(), order * width
    for t in range(width + int(y[-1])):
        a, b = np.searchsorted(y, (t - width + 1, t + 1))
        x = t - y[a:b]
        at, up = here[a:b] + x, above[a:b] + x
        left, over, corner = (flat[k].astype(np.int16) for k in (at, up + 1, up))
        guess = np.choose(kinds[a:b], (np.zeros_like(left), left, over, (left + over) >> 1, _paeth(left, over, corner)))
        flat[at + 1] = source[start[a:b] + x] + guess.astype(np.uint8)
    return flat.reshape(n + 1, width + 1)[:n, 1:].copy()


def decode(png: bytes) -> tuple[np.ndarray, int]:
    """The samples and the payload's length.  Raises MediaError for anything that is not whole."""
    kinds, rows, n = read_chunks(png)
    return unfilter(kinds, rows), n


def read_chunks(png: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters, filtered rows, and the payload's length."""
    if png[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at, head, length, z, ended = 8, None, None, [], False
    while at < len(png):
        if ended or at + 12 > len(png):
            raise MediaError("bytes after the end" if ended else "cut short")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png):
            raise MediaError("cut short")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(png[at + 4 : at + 8 + n]):
            raise MediaError("checksum of a chunk")
        if (head is None) != (kind == b"IHDR"):
            raise MediaError("order of chunks")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
            if head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
                raise MediaError("only 8-bit greyscale without interlacing")
        elif kind == LENGTH:
            (length,) = struct.unpack(">Q", data)
        elif kind == b"IDAT":
            z.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError("unknown critical chunk")
        at += 12 + n
    if not ended:
        raise MediaError("no end")
    width, rows = head[:2]
    want = rows * (width + 1)
    try:
        d = zlib.decompressobj()
        raw = d.decompress(b"".join(z), want + 1)
    except zlib.error as e:
        raise MediaError("compressed data") from e
    if len(raw) != want or not d.eof and d.decompress(d.unconsumed_tail, 1) or not d.eof or d.unused_data:
        raise MediaError("number of samples")
    x = np.frombuffer(raw, np.uint8).reshape(rows, width + 1)
    if length is not None and length > rows * width:
        raise MediaError("length")
    if x[:, 0].max() > 4:
        raise MediaError(f"filter {x[:, 0].max()}")
    return x[:, 0], x[:, 1:], rows * width if length is None else length


# -- hashes -----------------------------------------------------------------

def _averages(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` equal parts of the rows of ``x``, each averaged; parts may begin inside a row."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    at = np.linspace(0, len(x), n + 1)
    low = np.minimum(at.astype(int), len(x) - 1)
    sums = total[low] + (at - low)[:, None] * x[low]
    return np.diff(sums, axis=0) * (n / len(x))


_COS = np.cos(np.pi * (2 * np.arange(32) + 1) * np.arange(8)[:, None] / 64)


def cosine_hash(x: np.ndarray) -> int:
    """64 bits of the lowest frequencies; row-major, lowest first."""
    small = _averages(_averages(x.astype(np.float64), 32).T, 32).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = small.mean() > 127.5
    return int(np.packbits(bits).view(">u8")[0])


# -- columns ----------------------------------------------------------------

def encode_column(df: DataFrame, payload: str = "text", media: str = "media", kind: int | None = None, level: int = 6) -> DataFrame:
    """Replace a text or binary column by PNG in a binary column."""
    small_batches(df.sparkSession, 500)
    rest = [c for c in df.columns if c not in (payload, media)]
    schema = df.select(*rest).schema.add(media, "binary")

    def run(batches):
        for b in batches:
            png = [encode(p or b"", kind=kind, level=level) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(rest))), pa.array(png, pa.binary())], [*rest, media])

    return df.select(F.col(payload).cast("binary").alias("_payload"), *rest).mapInArrow(frugal(run), schema)


FEATURES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "error": "string"}


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Decode a column of PNG and say what it holds; the other columns stay, but for those named as the results."""
    small_batches(df.sparkSession, 500)
    rest = [c for c in df.columns if c != media and c not in FEATURES]
    schema = df.select(*rest).schema
    for name, kind in FEATURES.items():
        schema = schema.add(name, kind)

    def read(png):
        try:
            return read_chunks(png or b""), None
        except MediaError as e:
            return None, str(e)

    def describe(png, x, n, error):
        own = (len(png), hashlib.sha256(png).hexdigest()) if png is not None else (None, None)
        if x is None:
            return (None, None, None, None, *own, None, error)
        raw = x.tobytes()
        return (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), *own, f"{cosine_hash(x):016x}", None)

    def run(batches):
        kinds = [{"long": pa.int64(), "string": pa.string()}[k] for k in FEATURES.values()]
        for b in batches:
            sizes = np.diff(np.frombuffer(b.column(0).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(0).offset)) if b.num_rows else []
            at, parts = np.concatenate([[0], np.cumsum(sizes)]), []
            for i, j in tx.runs(at, RUN):  # so that unpacked images are few
                pngs = b.column(0).slice(i, j - i).to_pylist()
                found = [read(p) for p in pngs]
                samples = iter(unfilter_all([f[:2] for f, _ in found if f]))
                rows = [describe(p, next(samples) if f else None, f and f[2], error) for p, (f, error) in zip(pngs, found, strict=True)]
                parts.append(pa.RecordBatch.from_arrays([*(b.column(k + 1).slice(i, j - i) for k in range(len(rest))), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*rest, *FEATURES]))
            yield from parts

    return df.select(F.col(media).alias("_media"), *rest).mapInArrow(frugal(run), schema)
