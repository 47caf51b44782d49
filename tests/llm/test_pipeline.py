"""Each stage against a plain version of its decision, and the whole run."""

from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from bayesmill.llm import decontamination, mixing, quality, simhash, tokenfile

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    words = text.encode().translate(simhash._LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """Least id reachable over pairs of five-word similarity 0.8 or more, by comparing all pairs."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [f for _, f in P.STAGES]
    assert len(stages) == 5
    now, columns = docs, docs.columns

    kept = stages[0](spark, now, SF)
    before, after = rows(now), rows(kept)
    assert kept.columns == columns
    learn = [i for i in before if i in labels and not quality_held_out(i)]
    stat = {i: quality.statistics(*quality.tx.utf8(pa.array([r["text"]])))[0] for i, r in before.items()}
    m = quality.Discriminant.fit(*[quality.Moments.of(np.array([stat[i] for i in learn if labels[i] == c])) for c in (0, 1)])
    score = {i: m.score(x[None])[0] for i, x in stat.items()}
    assert set(after) == {i for i, s in score.items() if s >= 0.3} and 0 < len(after) < len(before)

    now = spark.createDataFrame(list(after.values()), docs.schema)
    kept = stages[1](spark, now, SF)
    want = {i for i, c in components({i: r["text"] for i, r in after.items()}).items() if i == c}
    before, after = after, rows(kept)
    assert kept.columns == columns and set(after) == want and len(want) < len(before)

    now = spark.createDataFrame(list(after.values()), docs.schema)
    kept = stages[2](spark, now, SF)
    own = [decontamination.word_shingles(t) for t in items]
    bad = {i for i, r in after.items() if any(o and len(o & decontamination.word_shingles(r["text"])) >= 0.8 * len(o) for o in own)}
    before, after = after, rows(kept)
    assert kept.columns == columns and set(after) == set(before) - bad

    now = spark.createDataFrame(list(after.values()), docs.schema)
    kept = stages[3](spark, now, SF)
    out = kept.collect()
    sizes = Counter()
    for r in after.values():
        sizes[r["source"]] += len(r["text"].split())
    names = sorted(sizes)
    target = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5), strict=True))
    got = Counter()
    for r in out:
        got[r["source"]] += len(r["text"].split())
        assert after[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert kept.columns == columns and all(abs(got[s] - target[s]) <= 1 for s in names)

    now = spark.createDataFrame(out, docs.schema)
    ids = stages[4](spark, now, SF).orderBy("start").collect()
    enc = tokenfile.Encoder(__import__("public_tokenizers").path(P.TOKENIZER))
    n = Counter((r["doc_id"], len(x) + 1) for r, x in zip(out, enc.whole([r["text"] for r in out]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in ids) == n
    assert [r["start"] for r in ids] == np.cumsum([0, *(r["n_tokens"] for r in ids[:-1])]).tolist()
    assert [r["doc_id"] for r in ids] == sorted(r["doc_id"] for r in ids)
    assert P.run(spark, SF).count() == len(out)


def quality_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_empty(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        now = f(spark, now, SF)
        assert now.count() == 0
