"""Personal data: rules for what is certain, boosted trees for what is not.

Base rules give emails, IP addresses, card and phone numbers; each is a single
pass with no search that starts again inside what failed, so time is linear in
a text's length.  Generators of high recall propose further, overlapping spans:
emails with a written-out sign, addresses with bracketed dots, phone numbers
without a country code, grouped card numbers, and secrets (values given to names
such as password or token, access keys, long runs of letters and digits), for
which there is no base rule.  Boosted trees score a span by its
format and context, a calibrated threshold of its kind decides, and of accepted
spans that overlap the best stays.  Base spans always stay.

The trees learn from rows made by rule (proper numbers in usual contexts;
dates, versions, measures, ISBNs, hex and reference numbers as what they are
not) and from at most ``SAMPLE`` candidates of the corpus itself, of different
contexts, those with the least hashes: base spans as what they are, and as what
they are not only candidates that a rule proves false.

Defined cases: a null text is empty and has no spans; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .workspace import frugal, small_batches

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
SAMPLE = 5000
STEP = 4096  # candidates of a text scored at a time
PRECISION = 0.99  # asked of a kind's threshold on the calibration rows

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(s: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, s.find("@")
    while at >= 0:
        i = at
        while i > done and s[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(s, at + 1) if i < at else None
        if m:
            done = m.end()
            out.append((i, done))
        at = s.find("@", m.end() if m else at + 1)
    return out


def base_spans(s: str) -> list[Span]:
    """Spans of the base rules, by start and kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(s)] if "@" in s else []
    if _DIGIT.search(s):
        if s.count(".") > 2:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(s) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(s):
            if m.end() - m.start() > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in s:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(s) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# -- candidates -------------------------------------------------------------

_AT = r"(?:\(at\)|\[at\]|\{at\}| at )"
_DOT = r"(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)"
_GENERATORS = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?{_AT} ?[A-Za-z0-9-]{{1,63}}(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?)[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:00|0)[1-9](?:[ ./-]?[0-9]){7,12}(?![0-9])")),
    (3, re.compile(r"\+ ?\(?[0-9][ ()./0-9-]{6,22}[0-9](?![0-9])")),
)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_GIVEN = re.compile(r"""[:=][ \t]{0,3}["']?([^\s"'`<>,;&]{6,})""")
_NAMED = re.compile(r"""(?:passw(?:or)?d|pwd|secret|token|key|credential)s?["']?[ \t]{0,3}\Z""", re.I)
_LETTER = re.compile("[A-Za-z]")
LONGEST = 200  # characters of a secret
#: How widely used kinds of access keys begin.
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_", "hf_")
_WRITTEN = re.compile(r"[(\[{]at[)\]}]| at .{1,80}? dot ", re.I)
_CUES = (
    ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact", "dial"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "pay"),
    ("email", "e-mail", "mail", "write", "reach", "contact"),
    ("ip", "host", "server", "address", "from", "login", "addr"),
    ("isbn", "version", "v", "date", "order", "ref", "id", "no", "serial", "code", "sku", "page", "pp", "vol", "doi", "commit", "hash", "total", "sum", "cm", "mm", "kg"),
    ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth"),
    ("sha", "md", "checksum", "digest", "uuid", "build", "revision", "file", "url", "path", "image"),
)


def candidates(s: str) -> list[Span]:
    """Proposed spans, which may overlap."""
    found: set[Span] = set()
    written, digit = bool(_WRITTEN.search(s)) if ("at" in s or "AT" in s) and ("(" in s or "[" in s or "{" in s or " dot " in s) else False, bool(_DIGIT.search(s))
    for kind, g in _GENERATORS:
        if written if kind == 0 else digit:
            found.update((m.start(), kind, m.end()) for m in g.finditer(s))
    for m in _RUN.finditer(s):
        if m.end() - m.start() <= LONGEST and (m[0].startswith(_KEYS) or digit and _DIGIT.search(m[0]) and _LETTER.search(m[0])):
            found.add((m.start(), SECRET, m.end()))
    for m in _GIVEN.finditer(s) if ":" in s or "=" in s else ():
        t = m[1].rstrip(".)]}")
        if 6 <= len(t) <= LONGEST and _NAMED.search(s, max(0, m.start() - 24), m.start()):
            found.add((m.start(1), SECRET, m.start(1) + len(t)))
    return sorted(found)


_DATE = re.compile(r"(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-](?:0[1-9]|1[0-2])[./-](?:0[1-9]|[12][0-9]|3[01]))(?![0-9])")


def proven_false(s: str, span: Span) -> bool:
    """Whether a rule shows that a candidate is not of its kind: a failed check sum, a number over 255, a date, an ISBN, hardly any different characters."""
    a, kind, b = span
    d = _digits(s[a:b])
    if kind == SECRET:
        return len(set(s[a:b])) < 4
    if kind == 1:
        return any(int(g) > 255 for g in re.findall(r"[0-9]+", s[a:b]))
    if kind == 2 and not (12 <= len(d) <= 19 and luhn(d)):
        return True
    isbn = len(d) == 13 and d[:3] in ("978", "979") and sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d)) % 10 == 0
    return kind in (2, 3) and (isbn and "isbn" in s[max(0, a - 32) : a].lower() or bool(_DATE.match(s, a)))


def describe(s: str, span: Span) -> list[float]:
    """Format and context of a span as numbers."""
    a, kind, b = span
    t, before, after = s[a:b], s[max(0, a - 32) : a], s[b : b + 16]
    d = _digits(t)
    groups = re.findall(r"[0-9]+", t)
    octets = [int(g) <= 255 for g in groups if len(g) <= 3]
    cue = before.lower()
    last = re.findall(r"[a-z-]+", cue)[-3:]
    return [
        *(float(kind == k) for k in range(len(NAMES))), float(len(t)), float(len(d)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0), float(t.count(" ")), float(t.count("-")), float(t.count(".")), float(t.count("/")), float(t.count("(")),
        float(t[:1] == "+"), float(t[:1] == "("), float(d[:1] == "0"), float(luhn(d)) if d else 0.0, float(int(d[:1] or 0)), float(len(octets) == 4 and all(octets)),
        float(len(set(d))), float(len(set(c for c in t if not c.isalnum()))), float(bool(re.search(r"[(\[{]at[)\]}]", t, re.I))), float(bool(re.search(r"(?:com|org|net|edu|io|de|fr|es|uk)\Z", t, re.I))),
        *(float(any(w in c for w in last)) for c in _CUES), float(before[-1:].isalnum()), float(before[-1:] in "#=:/._-" and before != ""), float(after[:1].isalnum()), float(after[:1] in "%/_=-" and after != ""),
        float(bool(re.search(r"[0-9] ?\Z", before))), float(bool(re.match(r" ?[0-9]", after))),
        *(_looks(t, before) if kind == SECRET else _NO_SECRET),
    ]


def _looks(t: str, before: str) -> list[float]:
    """How random a candidate secret is, and how it is introduced."""
    n = {c: t.count(c) for c in set(t)}
    given = re.search(r"""[:=][ \t]{0,3}["']?\Z""", before)
    return [
        -sum(k / len(t) * math.log2(k / len(t)) for k in n.values()), float(bool(re.fullmatch("[0-9a-fA-F]+", t))), float(bool(re.search("[A-Z]", t))), float(bool(re.search("[a-z]", t))), float(t.startswith(_KEYS)),
        float(bool(given)), float(bool(given and _NAMED.search(before, 0, given.start()))), float(sum(1 for a, b in zip(t, t[1:], strict=False) if a.isdigit() != b.isdigit())),
        float(max(map(len, re.findall("[A-Za-z]+", t)), default=0)), float(t.count("_")), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", t))),
    ]


_NO_SECRET = [0.0] * len(_looks("none", ""))


# -- learning ---------------------------------------------------------------

def made_rows(n: int = 7500, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Candidates with labels, made by rule."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))

    def card():
        d = r.choice("3456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def grouped(d, seps):
        c = r.choice(seps)
        return c.join(d[i : i + 4] for i in range(0, len(d), 4))

    name = lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}"
    tld = lambda: r.choice(["com", "org", "net", "edu", "io", "de", "fr", "es"])
    octet = lambda: str(r.randint(0, 255))
    some = lambda k, of: "".join(r.choice(of) for _ in range(k))
    hexes, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "0123456789"
    value = lambda: r.choice([some(r.randint(12, 40), hexes), some(r.randint(10, 44), mixed), some(r.randint(8, 16), mixed + "!#$%*+-_"), some(r.choice([24, 32, 44]), mixed + "+/")])
    secret = lambda: r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "secret_key", "auth_token", "PASSWORD", "API_KEY", "Token"])
    other = lambda: r.choice(["checksum", "sha256", "md5", "id", "uuid", "digest", "url", "file", "build", "ref", "path"])
    uuid = lambda: "-".join(some(k, hexes) for k in (8, 4, 4, 4, 12))
    good = {
        0: lambda: r.choice([f"{name()} (at) {word()} (dot) {tld()}", f"{name()}[at]{word()}.{tld()}", f"{name()} [at] {word()}[dot]{tld()}", f"{name()} at {word()} dot {tld()}"]),
        1: lambda: r.choice(["[.]", "(.)"]).join(octet() for _ in range(4)),
        2: lambda: grouped(card(), [".", "/", "_", "  ", " ", "-"]),
        3: lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{r.randint(2, 9)}{num(2)}-{num(3)}-{num(4)}", f"{r.randint(2, 9)}{num(2)}.{num(3)}.{num(4)}", f"0{r.randint(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+ {r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"00{r.randint(1, 99)} {num(3)} {num(3)} {num(3)}"]),
        SECRET: lambda: r.choice([r.choice(["AKIA", "ASIA"]) + some(16, upper), r.choice(["ghp_", "gho_"]) + some(36, mixed), r.choice(["sk_live_", "rk_live_"]) + some(24, mixed), f"{r.choice(['xoxb', 'xoxp'])}-{num(11)}-{some(24, mixed)}", "AIza" + some(35, mixed), "glpat-" + some(20, mixed)]),
    }
    bad = {
        0: lambda: r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"arrived at {word()} . {word()}"]),
        1: lambda: r.choice([f"{num(1)} . {num(2)} . {num(1)} . {num(3)}", ". ".join(num(r.randint(1, 3)) for _ in range(4)), f"{r.randint(300, 999)}[.]{num(3)}[.]{num(3)}[.]{num(3)}"]),
        2: lambda: r.choice([f"97{r.choice('89')}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(r.randint(12, 19)), grouped(num(16), "-./_ "), " ".join(num(4) for _ in range(4))]),
        3: lambda: r.choice([f"{r.randint(1900, 2030)}-{num(4)}-{num(4)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{num(4)}/{num(4)}/{num(4)}", f"0{num(9)}", f"{num(3)} {num(4)} {num(3)}", f"{num(5)}-{num(4)}-{num(4)}"]),
        SECRET: lambda: r.choice([some(r.choice([16, 32, 40, 64]), hexes), uuid(), f"{word()}/{word()}{num(2)}/{word()}-{num(4)}", f"{word()}_{word()}_{word()}_{num(2)}", f"{word()}-{word()}-{num(4)}-{num(2)}-{num(2)}", word() + num(14)]),
    }
    x, y = [], []
    while len(y) < n:
        kind, real = r.randrange(len(NAMES)), r.random() < 0.5
        cue = r.choice(_CUES[(2, 3, 1, 0, 5)[kind]]) if real and r.random() < 0.6 else r.choice(_CUES[4]) if not real and r.random() < 0.6 else word()
        t, near = (good if real else bad)[kind](), r.random() < 0.25
        head = f"{word()} {word()} {cue}{r.choice([' ', ': ', ' is '])}"
        tail = f"{r.choice([' ', '. ', ', '])}{word()} {word()}"
        if near and kind == 2 and real:  # numbers side by side, of which the base rules see one
            head, t = f"{head}+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)} ", card()
        elif near and kind == 3 and real:
            t, tail = f"+{r.randint(1, 99)} {r.choice([f'({num(3)})', num(3)])} {num(3)}{r.choice('-. ')}{num(4)}", f" {card()}{tail}"
        elif kind == SECRET and r.random() < 0.6:  # given to a name
            quote = r.choice(["", "", "'", '"'])
            if real:
                key, t = secret(), value()
            elif r.random() < 0.7:
                key = other()
            else:
                key, t = secret(), r.choice([word() + word(), "required", f"{word()}_{word()}", f"{word()}.{word()}()"])
            head, tail = f"{word()} {key}{r.choice(['=', ': ', ' = ', ':'])}{quote}", quote + tail
        s = f"{head}{t}{tail}"
        for c in candidates(s):
            if c[1] == kind and c[0] < len(head) + len(t) and c[2] > len(head):
                exact = (c[0], c[2]) == (len(head), len(head) + len(t))
                x.append(describe(s, c))
                y.append(float(real and exact and not (kind == 2 and not luhn(_digits(t)))))
    return np.array(x), np.array(y)


@dataclass
class Model:
    trees: BoostedTrees
    thresholds: list[float]

    def added(self, s: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that overlap neither base spans (secrets may) nor better ones, by start."""
        every = candidates(s)
        some = _free([c for c in every if c[1] != SECRET], base) + [c for c in every if c[1] == SECRET]
        if not some:
            return []
        p = np.concatenate([self.trees.predict(np.array([describe(s, c) for c in some[i : i + STEP]])) for i in range(0, len(some), STEP)])
        best = sorted((-q, c) for q, c in zip(p.tolist(), some, strict=True) if q >= self.thresholds[c[1]])
        kept: list[Span] = []  # they do not overlap, so only the neighbours of a place can
        for _, c in best:
            at = bisect.bisect_left(kept, c)
            if (not at or kept[at - 1][2] <= c[0]) and (at == len(kept) or c[2] <= kept[at][0]):
                kept.insert(at, c)
        return kept


def _free(some: list[Span], taken: list[Span]) -> list[Span]:
    """Those that overlap nothing taken; taken spans are sorted by start and may overlap each other."""
    if not taken:
        return some
    starts = np.array([t[0] for t in taken])
    ends = np.maximum.accumulate(np.array([t[2] for t in taken]))
    at = np.searchsorted(starts, [c[2] for c in some], "left")
    return [c for c, k in zip(some, at.tolist(), strict=True) if not k or ends[k - 1] <= c[0]]


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Made rows and the corpus sample; a third calibrates and sets thresholds."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                if not s:
                    continue
                base = base_spans(s)
                mine = set(base)
                others = [c for c in candidates(s) if c not in mine and proven_false(s, c)]
                # what is no base span is neither yes nor no, but for what is proven false and overlaps none
                for c in sorted(mine.union(_free(others, base))):
                    where = (c[1] * 33 + min(c[0], 32)) * 17 + min(len(s) - c[2], 16)
                    rows.append((xxhash.xxh64_intdigest(s[max(0, c[0] - 32) : c[2] + 16], where) >> 1, describe(s, c), float(c in mine)))
            if rows:
                h, x, y = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"h": list(h), "x": list(x), "y": list(y)})

    def least(batches):
        """The ``sample`` rows with the least hashes, one for each hash, whatever their order of arrival."""
        best: list[tuple] = []
        for b in batches:
            once: dict[int, tuple] = {}
            for r in [*best, *zip(*(c.to_pylist() for c in b.columns), strict=True)]:
                once[r[0]] = min(once.get(r[0], r), r)
            best = heapq.nsmallest(sample, once.values())
        if best:
            yield pa.RecordBatch.from_pydict(dict(zip("hxy", map(list, zip(*best, strict=True)), strict=True)))

    schema = "h long, x array<double>, y double"
    # tasks choose among theirs, a few among those, one at last: no more than the sample is held or sent to the driver
    seen = docs.select(text).mapInArrow(frugal(run), schema).mapInArrow(least, schema).repartition(16, "h").mapInArrow(least, schema).coalesce(1).mapInArrow(least, schema).collect()
    x, y = made_rows()
    if seen:
        x, y = np.vstack([x, np.array([r["x"] for r in seen])]), np.concatenate([y, [r["y"] for r in seen]])
    turn = np.random.default_rng(5).permutation(len(y))
    cut = 2 * len(y) // 3
    a, b = turn[:cut], turn[cut:]
    trees = BoostedTrees().fit(x[a], y[a]).calibrate(x[b], y[b])
    p, thresholds = trees.predict(x[b]), []
    for k in range(len(NAMES)):
        mine = x[b, k] == 1
        order = np.argsort(-p[mine])
        q, t = p[mine][order], np.cumsum(y[b][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(t >= PRECISION)
        thresholds.append(max(float(q[good[-1]]), 0.5) if len(good) else 1.1)
    return Model(trees, thresholds)


def _join(spans: list[Span]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone and base (of the base rules), spans (all of their kinds), secrets (likewise), n_found (both)."""
    small_batches(docs.sparkSession)
    schema = docs.select(id).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base", "string").add("spans", "string").add("secrets", "string").add("n_found", "long")

    def run(batches):
        for b in batches:
            counts, base, every, secrets, total = [], [], [], [], []
            for s in b.column(1).to_pylist():
                found = base_spans(s) if s else []
                more = model.added(s, found) if s else []
                counts.append([sum(k == x[1] for x in found) for k in range(4)] if found else [0] * 4)
                base.append(_join(found))
                hidden = [c for c in more if c[1] == SECRET]
                plain = [c for c in more if c[1] != SECRET]
                every.append(_join(sorted(found + plain)) if plain else base[-1])
                secrets.append(_join(hidden))
                total.append(len(found) + len(more))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(base), pa.array(every), pa.array(secrets), pa.array(total, pa.int64())], schema.names)

    return docs.select(id, text).mapInArrow(frugal(run), schema)


def redact(s: str, model: Model) -> str:
    """The text with each span replaced by its kind; of overlapping spans, by the first one's."""
    base = base_spans(s)
    out, at = [], 0
    for a, k, b in sorted(base + model.added(s, base)):
        if a >= at:
            out += [s[at:a], f"<{NAMES[k]}>"]
        at = max(at, b)
    return "".join(out) + s[at:]


def spans_digest(found: DataFrame) -> DataFrame:
    """Replace ``base`` by its sha256."""
    return found.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).drop("base")


