"""Bit packing, random access, and ids against the library's own."""

import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from bayesmill.llm import tokenfile as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70_001, dtype=np.uint64)
    raw = T.pack(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert (T.unpack(raw, width, len(ids)) == ids).all()


def test_width():
    assert [T.width_of(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        T.pack(np.array([4]), 2)


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(None, rng.integers(0, 5000, 3)), (1, np.empty(0, np.int64)), (2, rng.integers(0, 5000, 1000)), (2, rng.integers(0, 5000, 1))]
    fs = pafs.LocalFileSystem()
    assert T.write_file(fs, f"{tmp_path}/x.tok", docs, 13, block=64) == 1004
    f = T.TokenFile(fs, f"{tmp_path}/x.tok")
    allids = np.concatenate([x for _, x in docs])
    for a, b in [(0, 1004), (0, 0), (63, 65), (64, 128), (5, 6), (1003, 1004), (100, 777)]:
        assert (f.ids(a, b) == allids[a:b]).all()
    for i, (_, x) in enumerate(docs):
        assert (f.doc(i) == x).all()


@pytest.mark.parametrize("keep", [0, 20, 10_000])
def test_pieces_are_the_librarys_ids(keep):
    e = T.Encoder(PATH)
    texts = ["Hello world", "", "a  b", " lead", "trail ", "x\ny z", "it's 'tis ' s don't", "é ñ 漢字 かな", "a b c", "a  b", "1 22 3,4 $5 ... !? a", "\x1c a\x1fb c", "tab\t x", "x\n", "\ny", "a\n\nb", "a\n b", "“q” — x", "a\u2003b", "a\u3000", "", "é\u00a0à", "<|endoftext|> y<|endoftext|>", "a b c　d", "²½ Ⅷ x²"]
    e.KEEP = keep
    for _ in range(2):
        for t, got, want in zip(texts, e.encode(texts), e.whole(texts), strict=True):
            assert got.tolist() == want.tolist(), t


def morse(n, a, b):
    """The Thue-Morse word of 2**n letters, whose halves' polynomial hashes modulo 2**64 are equal for n >= 10."""
    w = [0]
    for _ in range(n):
        w += [1 - x for x in w]
    return "".join((a, b)[x] for x in w)


def test_ids_are_those_of_the_plain_library():
    """Against the library called as anyone would: control strings, and words that simple hashes mistake for each other."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = [morse(10, "a", "b"), morse(10, "b", "a"), f"x {morse(7, 'a', 'b')} y", f"x {morse(7, 'b', 'a')} y", "ab <|endoftext|> cd", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext", "abcdefg abcdefg\nabcdefg abcdefgh", "abcdefgh\nabcdefgh abcdefgh", "\0 \0\0 a\0"]
    e = T.Encoder(PATH)
    for _ in range(2):
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert got.tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert e.encode(["ab <|endoftext|> cd"])[0].tolist() == [397, 220, 50256, 22927]


def test_a_file_is_written_as_blocks_fill(tmp_path, monkeypatch):
    """A file of many blocks never has more than a block and a run of ids waiting."""
    waiting, real = [], T.TokenWriter.add
    monkeypatch.setattr(T.TokenWriter, "add", lambda self, *a: (real(self, *a), waiting.append(sum(map(len, self.held))))[0])
    fs, rng = pafs.LocalFileSystem(), np.random.default_rng(0)
    docs = [(i, rng.integers(0, 50_000, 3000)) for i in range(2000)]
    assert T.write_file(fs, f"{tmp_path}/x.tok", docs, 16) == 6_000_000
    assert max(waiting) < T.BLOCK and len(waiting) == 2000
    f = T.TokenFile(fs, f"{tmp_path}/x.tok")
    assert len(f.offsets) == 93 and all((f.doc(i) == docs[i][1]).all() for i in (0, 21, 22, 1999))
    with pytest.raises(ValueError):
        (tmp_path / "y.tok").write_bytes(b"BMTK")
        T.TokenFile(fs, f"{tmp_path}/y.tok")


def test_files_and_query(spark, tmp_path):
    rows = [(3, "b c", "q"), (1, "a " * 5000, "q"), (2, None, "q"), (None, "n", "q"), (3, "a", "q"), (3, "b c", "q"), (-5, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    uri = f"file://{tmp_path}/t"
    T.write_tokens(df, uri, PATH, files=3)
    got = T.read_documents(spark, uri).orderBy("start").collect()
    enc = T.Encoder(PATH)
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 3, 3, 3]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        crcs = [zlib.crc32(np.append(enc.whole([t or ""])[0], 0).astype("<u4").tobytes()) for i, t, _ in rows if i == r["doc_id"]]
        assert r["ids_crc32"] in crcs
    T.write_tokens(df.limit(0), f"{uri}0", PATH)
    assert T.read_documents(spark, f"{uri}0").count() == 0
