"""Base rules against the plain patterns; trees; added spans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.llm import pii as P
from bayesmill.llm.boosting import BoostedTrees

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(s):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(s):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and P.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_rules():
    rng = random.Random(0)
    bits = ["a", "B.", "@", "x@y.z", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "+1 ", "4111111111111111", "555-1234", "é", "_", "0001"]
    for _ in range(20_000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert P.base_spans(s) == plain(s), s


@pytest.mark.parametrize("s", ["1" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "+1" + " " * 300_000, "1." * 150_000, "a@b" * 100_000, "1 " * 150_000, "+1(" * 100_000, "(at)" * 50_000, "a at b " * 30_000])
def test_long_texts_take_linear_time(s):
    import time

    t = time.process_time()
    P.base_spans(s)
    P.candidates(s)
    assert time.process_time() - t < 8


@pytest.fixture(scope="module")
def model(spark):
    return P.train(spark.createDataFrame([], "text string"))


@pytest.mark.parametrize("s", ["(415) 555-2671 ", "jo (at) x (dot) org ", "10[.]20[.]30[.]40, ", "4111.1111.1111.1111 and ", "a@b.co (415) 555-2671 x ", "1" * 50, "0 1 2 3 4 5 6 7 8 9 "])
def test_added_spans_take_linear_time(model, s):
    import time

    took = []
    for size in (100_000, 1_000_000):
        text = (s * (1 + size // len(s)))[:size]
        t = time.process_time()
        base = P.base_spans(text)
        found = model.added(text, base)
        took.append(time.process_time() - t)
        ends = [b for _, _, b in found]
        assert all(a >= b for (a, *_), b in zip(found[1:], ends, strict=False))
    assert took[1] < 30 * took[0] + 1 and took[1] < 90


def labelled(seed=5):
    """Sentences with their added spans, in words and layouts that the made training rows do not use."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(first="4", n=16):
        d = first + num(n - 1 - len(first))
        return next(d + c for c in "0123456789" if P.luhn(d + c))

    names, hosts = ["maria.lopez", "t_schmidt", "ana", "bob77", "c.nguyen"], ["northwind", "posteo", "uni-koeln", "acme", "fastmail"]
    out = []
    for _ in range(60):
        who, at, top = r.choice(names), r.choice(hosts), r.choice(["com", "org", "de", "net"])
        d4 = [num(4) for _ in range(4)]
        c = card()
        true = [
            (0, "Questions go to {} before Friday.", f"{who} (at) {at} (dot) {top}"),
            (0, "Feedback, please, to {}, thanks!", f"{who}[at]{at}.{top}"),
            (1, "The attacker came from {} at noon.", "[.]".join(str(r.randrange(1, 255)) for _ in range(4))),
            (1, "Block {} in the firewall.", "[.]".join(str(r.randrange(1, 255)) for _ in range(4))),
            (2, "She read out her number, {}, twice.", ".".join(c[i : i + 4] for i in range(0, 16, 4))),
            (2, "My Visa is {} if you need it.", "/".join(c[i : i + 4] for i in range(0, 16, 4))),
            (3, "Ring me on {} after six.", f"({r.randrange(201, 990)}) {r.randrange(201, 990)}-{num(4)}"),
            (4, "The old login was {} until May.", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))),
            (4, "db_password={} ; port=5432", "".join(r.choice("abcdefghkmnpqrstuvwxyz23456789!") for _ in range(r.randrange(10, 18)))),
            (4, "export SERVICE_TOKEN='{}' before it starts", "".join(r.choice("0123456789abcdef") for _ in range(32))),
            (3, "Our front desk: {}, daily.", f"{r.randrange(201, 990)}-{r.randrange(201, 990)}-{num(4)}"),
        ]
        false = [
            f"They met at the station. Dot said nothing about {who}.",
            f"Release 4.{num(1)}.{num(2)} fixed ticket {num(6)} on 20{num(2)}-0{r.randrange(1, 9)}-1{num(1)}.",
            f"The sum of {num(3)} {num(3)} {num(3)} euros was paid in {r.randrange(1900, 2020)}.",
            f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)} is out of print.",
            f"Tracking code {''.join(d4)}{'1' if P.luhn(''.join(d4)) else ''} was scanned.",
            f"Commit {''.join(r.choice('0123456789abcdef') for _ in range(40))} broke the build.",
            f"The image is at /srv/media/20{num(2)}/album-{num(4)}/photo-{num(3)} since then.",
            "The password: required, at least eight characters.",
            f"See pp. {num(3)}-{num(3)} and chapter {num(1)}.{num(1)}.{num(1)}.",
        ]
        out += [(t.format(x), [(t.index("{"), k, t.index("{") + len(x))]) for k, t, x in true] + [(t, []) for t in false]
    return out


def test_precision_and_recall_on_sentences_of_another_hand(model):
    """Per kind, added spans against the labels; README has the figures."""
    hit, said, real = ([0] * len(P.NAMES) for _ in range(3))
    for s, want in labelled():
        base = P.base_spans(s)
        got = set(model.added(s, base))
        for span in want:
            if span not in base:
                real[span[1]] += 1
                hit[span[1]] += span in got
        for span in got:
            said[span[1]] += 1
    figures = {n: (round(hit[k] / real[k], 3), round(hit[k] / max(said[k], 1), 3)) for k, n in enumerate(P.NAMES)}
    print("recall, precision:", figures)
    assert all(r > 0.8 and p > 0.9 for r, p in figures.values()), figures


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_boosting_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.1)).astype(float)
    m = BoostedTrees(rounds=80).fit(x[:1500], y[:1500]).calibrate(x[1500:2200], y[1500:2200])
    p = m.predict(x[2200:])
    assert ((p > 0.5) == y[2200:]).mean() > 0.8
    assert abs(p.mean() - y[2200:].mean()) < 0.05
    assert BoostedTrees().fit(x[:0], y[:0]).predict(x[:3]).tolist() == [0.5] * 3


def test_query(spark):
    more = {
        "write to jo.doe (at) example (dot) org soon": "jo.doe (at) example (dot) org",
        "the host 10[.]20[.]30[.]40 is down": "10[.]20[.]30[.]40",
        "call (415) 555-2671 today": "(415) 555-2671",
        "her phone +1 (415) 555-2671 4111111111111111 yes": "+1 (415) 555-2671",
    }
    clean = ["version 1.2.3 of 2021-03-04", "she was at home. nothing dot", "", None, "isbn 978-3-1614-8410-0", "order 123456789012345", "in 1999 and 2000"]
    rows = [(i, s) for i, s in enumerate([*more, *clean])] + [(None, "mail a@b.co"), (99, "é +49 30 123456 and 1.2.3.4")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit(1))
    model = P.train(df)
    got = P.find(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        s = next(t for i, t in rows if i == r["doc_id"])
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        if s in more:
            assert more[s] in [s[int(a) : int(b)] for _, a, b in spans], s
        elif s in clean:
            assert not spans, s
        assert set(r["base"].split(",")) - {""} <= set(r["spans"].split(","))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([x for x in r["base"].split(",") if x])
    assert P.spans_digest(P.find(df.limit(0), P.train(df.limit(0)))).count() == 0
    assert P.redact("mail a@b.co now", model) == "mail <email> now"


def test_secrets_have_a_column_of_their_own(spark, model):
    s = "set api_key = 'f3a94c0b77de21a5' and mail a@b.co"
    df = spark.createDataFrame([(1, s), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.find(df, model).collect()}
    assert (got[1]["secrets"], got[1]["spans"], got[1]["n_found"]) == ("secret:15:31", "email:42:48", 2)
    assert all((got[k]["secrets"], got[k]["spans"], got[k]["n_found"]) == ("", "", 0) for k in (2, 3))
    assert P.redact(s, model) == "set api_key = '<secret>' and mail <email>"


def test_a_corpus_rich_in_other_formats_does_not_unlearn_them(spark):
    rng = random.Random(1)
    texts = [f"please call ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} today" for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = P.find(df, P.train(df)).where("spans like '%phone%'").count()
    assert found > 0.9 * len(texts)


def test_what_is_proven_false():
    false = ["4111 1111 1111 1112", "300[.]1[.]1[.]1", "isbn 978-0-306-40615-7", "01.02.2020 1234"]
    true = ["4111 1111 1111 1111", "10[.]20[.]30[.]40", "(415) 555-2671", "jo (at) x (dot) org"]
    for s in false:
        assert [c for c in P.candidates(s) if P.proven_false(s, c)], s
    for s in true:
        assert not [c for c in P.candidates(s) if (c[0], c[2]) == (0, len(s)) and P.proven_false(s, c)], s
