"""Word and byte kernels against plain Python."""

import random

import numpy as np
import pyarrow as pa

from bayesmill.llm import text as T


def test_words_and_hashes():
    rng = random.Random(0)
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "B", " ", "\n", "é", "\x1c", "\t", "漢", ""]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
        data, off = T.utf8(pa.array(texts, pa.string()))
        low, s, e, first = T.words(data, off)
        for i, t in enumerate(texts):
            mine = [bytes(low[a:b]) for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)]
            want = bytes(T.LOWER[np.frombuffer(t.encode(), np.uint8)]).translate(None).split() if t else []
            assert mine == want
        assert [int(h) for h in T.word_hashes(low, s, e)] == [T.hash_word(bytes(low[a:b])) for a, b in zip(s, e, strict=True)]


def test_runs_cover_all_texts_once():
    off = np.array([0, 5, 5, 9, 40, 41, 41])
    got = list(T.runs(off, 10))
    assert [k for i, j in got for k in range(i, j)] == list(range(6))
    assert all(off[j] - off[i] <= 10 or j == i + 1 for i, j in got)
    assert list(T.runs(np.array([0]), 10)) == []


def test_slices_and_nulls():
    a = pa.array(["xx", None, "yé", "z"]).slice(1, 3)
    data, off = T.utf8(a)
    assert bytes(data) == "yéz".encode() and off.tolist() == [0, 0, 3, 4]
    assert T.utf8(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_that_polynomial_hashes_mistake_have_hashes_of_their_own():
    seen = set()
    for n in range(1, 13):
        w = [0]
        for _ in range(n):
            w += [1 - x for x in w]
        for a, b in (b"ab", b"ba"):
            seen.add(T.hash_word(bytes((a, b)[x] for x in w)))
    assert len(seen) == 24
    words = [bytes([65 + k]) * n for n in range(1, 80) for k in range(3)] + [b"\0" * n for n in range(1, 80)]
    assert len({T.hash_word(w) for w in words}) == len({w.lower() for w in words})
