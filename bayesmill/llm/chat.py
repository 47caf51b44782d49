"""Chat formatting: a small template language compiled to Python closures.

A template is text with ``{{ expression }}`` output and ``{% ... %}`` blocks:
``for name in expression`` / ``endfor``, ``if`` / ``elif`` / ``else`` /
``endif``, ``set name = expression``, and ``generation`` / ``endgeneration``,
which mark what a model is to learn.  Expressions have strings, integers, true,
false, none, names, ``a.b``, ``a['b']``, ``+``, comparisons, ``and``, ``or``,
``not``, ``in``, ``not in``, and the filters below after ``|``.  Nothing else
can be reached: fields are looked up in dictionaries only, never as attributes,
and there are no calls.  Quoted strings may hold the ends of tags.  A minus next
to a brace (``{{-``, ``-}}``, ``{%-``, ``-%}``) drops the white space of the text
on that side.  A tag that is not closed is an error; ``{{ '{{' }}`` writes one.

Compiling parses a template into a syntax tree, folds whatever is constant
(adjacent text included), and turns each node into a closure.  An operator or
filter that its values do not fit raises TemplateError when it is rendered, if
it ever is; folding leaves it as it stands.

Control strings inside texts are escaped reversibly: in every escaped text an
escape mark is put after the first character of each control string and of each
run of that character and escape marks, so no control string remains, and
removing one mark from each such run gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructType

from .workspace import frugal, small_batches

MARK = "\\"


class TemplateError(ValueError):
    pass


# -- escaping ---------------------------------------------------------------

class Escaper:
    """Keeps ``controls`` (which all begin with one same character) out of escaped texts."""

    def __init__(self, controls: tuple[str, ...]):
        heads = {c[:1] for c in controls}
        if len(heads) != 1 or MARK in heads or not all(len(c) > 1 for c in controls):
            raise TemplateError("control strings need one common first character, more than one character, and not the escape mark")
        h, self.controls = re.escape(heads.pop()), controls
        m = re.escape(MARK)
        rest = "|".join(re.escape(c[1:]) for c in controls)
        # h, any marks, then the rest of a control string: one more mark goes in, or one comes out
        self._in = re.compile(f"({h}{m}*)(?={rest})")
        self._out = re.compile(f"({h}{m}*){m}(?={rest})")

    def escape(self, s: str) -> str:
        return self._in.sub(lambda x: x[1] + MARK, s)

    def unescape(self, s: str) -> str:
        return self._out.sub(lambda x: x[1], s)


# -- parsing ----------------------------------------------------------------

_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_INSIDE = rf"((?:{_STRING}|[^\"'])*?)"
_TAG = re.compile(rf"\{{\{{(-?){_INSIDE}(-?)\}}\}}|\{{%(-?){_INSIDE}(-?)%\}}", re.S)
_OPEN = re.compile(r"\{[{%]")
_TOKEN = re.compile(rf"\s*(?:({_STRING})|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.\[\]()=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable] = {"line": lambda s: _text(s).replace(MARK, MARK * 2).replace("\n", MARK + "n"), "trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower(), "length": len}
_WORDS = {"true": True, "false": False, "none": None}


class _Parser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *texts):
        return self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in texts

    def take(self, *texts):
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text):
        if not self.take(text):
            raise TemplateError(f"expected {text!r}")

    def name(self):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3 and self.tokens[self.at][1] not in _WORDS:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def end(self):
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                left = ("not", ("in", left, self.sum()))
            else:
                left = (op, left, self.sum())
        return left

    def sum(self):
        left = self.filtered()
        while op := self.take("+", "-"):
            left = (op, left, self.filtered())
        return left

    def filtered(self):
        left = self.primary()
        while True:
            if self.take("|"):
                if (f := self.name()) not in FILTERS and f != "escape":
                    raise TemplateError(f"no filter {f!r}")
                left = ("filter", f, left)
            elif self.take("."):
                left = ("item", left, ("const", self.name()))
            elif self.take("["):
                left = ("item", left, self.expression())
                self.need("]")
            else:
                return left

    def primary(self):
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("-"):
            return ("-", ("const", 0), self.filtered())
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, t = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), t[1:-1], flags=re.S))
        if kind == 2:
            return ("const", int(t))
        if kind == 3:
            return ("const", _WORDS[t]) if t in _WORDS else ("name", t)
        raise TemplateError(f"unexpected {t!r}")


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: a list of statements."""
    pieces, at, bare = [], 0, False

    def plain(end, strip):
        t = source[at:end].lstrip() if bare else source[at:end]
        if _OPEN.search(t):
            raise TemplateError(f"a tag is not closed: {t[_OPEN.search(t).start():][:20]!r}")
        if t := t.rstrip() if strip else t:
            pieces.append(("text", t))

    for m in _TAG.finditer(source):
        out = m[2] is not None
        plain(m.start(), m[1] if out else m[4])
        pieces.append(("out", m[2]) if out else ("tag", m[5].strip()))
        at, bare = m.end(), bool(m[3] if out else m[6])
    plain(len(source), "")
    pos = 0

    def block(*ends):
        nonlocal pos
        body = []
        while pos < len(pieces):
            kind, s = pieces[pos]
            word = re.match(r"\w*", s)[0] if kind == "tag" else None
            if word in ends:
                return body
            pos += 1
            if kind == "text":
                body.append(("emit", ("const", s)))
            elif kind == "out":
                p = _Parser(s)
                body.append(("emit", p.expression()))
                p.end()
            elif word == "for":
                p = _Parser(s[3:])
                name = p.name()
                p.need("in")
                over = p.expression()
                p.end()
                inner = block("endfor")
                close("endfor")
                body.append(("for", name, over, inner))
            elif word == "if":
                arms, other = [], []
                while True:
                    p = _Parser(s.removeprefix("el")[2:])
                    test = p.expression()
                    p.end()
                    arms.append((test, block("elif", "else", "endif")))
                    s = pieces[pos][1] if pos < len(pieces) else ""
                    if not s.startswith("elif"):
                        break
                    pos += 1
                if s == "else":
                    pos += 1
                    other = block("endif")
                close("endif")
                body.append(("if", arms, other))
            elif word == "set":
                p = _Parser(s[3:])
                name = p.name()
                p.need("=")
                body.append(("set", name, p.expression()))
                p.end()
            elif word == "generation":
                inner = block("endgeneration")
                close("endgeneration")
                body.append(("generation", inner))
            else:
                raise TemplateError(f"unknown block {s!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body

    def close(word):
        nonlocal pos
        if pos >= len(pieces) or pieces[pos] != ("tag", word):
            raise TemplateError(f"missing {word}")
        pos += 1

    return block()


# -- folding and closures ---------------------------------------------------

_BINARY = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b if isinstance(b, (list, dict)) else isinstance(a, str) and a in _text(b), "-": lambda a, b: a - b,
    "+": lambda a, b: a + b if type(a) is type(b) else _text(a) + _text(b),
}


def _text(v) -> str:
    return v if isinstance(v, str) else "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def fold(e: tuple, filters: dict[str, Callable]) -> tuple:
    """The expression with every constant part worked out."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    args = [fold(x, filters) if isinstance(x, tuple) else x for x in e[1:]]
    if all(a[0] == "const" for a in args if isinstance(a, tuple)):
        try:
            return ("const", _closure((kind, *args), filters)({}))
        except TemplateError:  # for whoever renders it
            pass
    return (kind, *args)


def fold_block(body: list[tuple], filters) -> list[tuple]:
    out: list[tuple] = []
    for s in body:
        if s[0] == "emit":
            e = fold(s[1], filters)
            if e[0] == "const":
                e = ("const", _text(e[1]))
                if out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                    out[-1] = ("emit", ("const", out[-1][1][1] + e[1]))
                    continue
                if not e[1]:
                    continue
            out.append(("emit", e))
        elif s[0] == "for":
            out.append(("for", s[1], fold(s[2], filters), fold_block(s[3], filters)))
        elif s[0] == "set":
            out.append(("set", s[1], fold(s[2], filters)))
        elif s[0] == "generation":
            out.append(("generation", fold_block(s[1], filters)))
        else:
            arms, other = [], s[2]
            for test, inner in s[1]:
                test = fold(test, filters)
                if test[0] != "const":
                    arms.append((test, fold_block(inner, filters)))
                elif test[1]:
                    other = inner
                    break
            other = fold_block(other, filters)
            if arms:
                out.append(("if", arms, other))
            else:
                for x in other:
                    if out and all(y[0] == "emit" and y[1][0] == "const" for y in (out[-1], x)):
                        out[-1] = ("emit", ("const", out[-1][1][1] + x[1][1]))
                    else:
                        out.append(x)
    return out


def _guarded(name: str, f: Callable, *values):
    try:
        return f(*values)
    except (TypeError, AttributeError, ValueError) as e:
        raise TemplateError(f"{name}: {e}") from e


def _closure(e: tuple, filters) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n)
    if kind == "not":
        f = _closure(e[1], filters)
        return lambda env: not f(env)
    if kind == "filter":
        g, f = filters[e[1]], _closure(e[2], filters)
        return lambda env: _guarded(e[1], g, f(env))
    a, b = _closure(e[1], filters), _closure(e[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "item":
        def item(env):
            x, k = a(env), b(env)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, list) and isinstance(k, int) and not isinstance(k, bool):
                return x[k] if -len(x) <= k < len(x) else None
            raise TemplateError("only fields of dictionaries and places of lists can be read")
        return item
    op = _BINARY[kind]
    return lambda env: _guarded(kind, op, a(env), b(env))


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.n = 0
        self.marks: list[tuple[int, int]] = []

    def add(self, s: str) -> None:
        self.parts.append(s)
        self.n += len(s)


def _run(body: list[tuple], filters) -> Callable[[dict, _Out], None]:
    steps = []
    for s in body:
        if s[0] == "emit":
            if s[1][0] == "const":
                steps.append(lambda env, out, t=s[1][1]: out.add(t))
            else:
                steps.append(lambda env, out, f=_closure(s[1], filters): out.add(_text(f(env))))
        elif s[0] == "set":
            steps.append(lambda env, out, n=s[1], f=_closure(s[2], filters): env.__setitem__(n, f(env)))
        elif s[0] == "generation":
            def mark(env, out, f=_run(s[1], filters)):
                a = out.n
                f(env, out)
                out.marks.append((a, out.n))
            steps.append(mark)
        elif s[0] == "for":
            def loop(env, out, n=s[1], over=_closure(s[2], filters), f=_run(s[3], filters)):
                items = _guarded("for", list, over(env) or [])
                for i, x in enumerate(items):
                    f(env | {n: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)
            steps.append(loop)
        else:
            def branch(env, out, arms=[(_closure(t, filters), _run(b, filters)) for t, b in s[1]], other=_run(s[2], filters)):
                for test, f in arms:
                    if test(env):
                        return f(env, out)
                return other(env, out)
            steps.append(branch)

    def run(env, out):
        for f in steps:
            f(env, out)
    return run


class Template:
    """A compiled template.  ``render`` gives the text and the marked spans (code points, end exclusive)."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        self.escaper = Escaper(controls) if controls else None
        filters = FILTERS | {"escape": (lambda v: self.escaper.escape(_text(v))) if controls else _text}
        self.tree = fold_block(parse(source), filters)
        self._go = _run(self.tree, filters)

    def render(self, **env) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        self._go(dict(env), out)
        return "".join(out.parts), out.marks


# -- the turn format --------------------------------------------------------

START, STOP = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, STOP)
TURNS = (
    "{% for m in messages %}" + START + "{{ m.role | line | escape }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    + STOP + "\n{% endfor %}"
)


def _line(s: str) -> str:
    """The inverse of the filter ``line``."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s)


SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))


def read_turns(text: str, escaper: Escaper) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation holds."""
    out = []
    for piece in text.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        out.append((_line(escaper.unescape(role)), escaper.unescape(rest.removesuffix(STOP + "\n"))))
    return out


def format_conversations(rows: DataFrame, template: str = TURNS, controls: tuple[str, ...] = CONTROLS, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: id, formatted (string), loss (array of start/end code points).

    Turns are in order of turn, role, text, nulls first; equal rows are kept.  A
    null text or role is empty; rows without an id are one conversation with a
    null id.  Line breaks in a role are escaped, as the role ends at one.
    Only one conversation is held at a time, in the order that its task has
    sorted, so conversations that share a task need not fit in memory together.
    An empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    schema = rows.select(id).schema.add("formatted", "string").add("loss", SPANS)
    dealt = rows.select(id, turn, role, text).repartition(id).sortWithinPartitions(id, turn, role, text)

    def run(batches):
        t, kind = Template(template, controls), None

        def conversations() -> Iterator[tuple]:
            nonlocal kind
            last, turns, begun = None, [], False
            for b in batches:
                kind = b.schema.field(0).type
                for i, r, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if begun and i != last:
                        yield last, turns
                        turns = []
                    last, begun = i, True
                    turns.append({"role": r or "", "text": s or ""})
            if begun:
                yield last, turns

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for ids, found in _in_batches(conversations(), 500):
            done = [t.render(messages=m) for m in found]
            marks = [[{"start": a, "end": b} for a, b in m] for _, m in done]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([s for s, _ in done], pa.string()), pa.array(marks, span)], [id, "formatted", "loss"])

    return dealt.mapInArrow(frugal(run), schema)


def _in_batches(pairs, n):
    ids, found = [], []
    for i, x in pairs:
        ids.append(i)
        found.append(x)
        if len(ids) == n:
            yield ids, found
            ids, found = [], []
    if ids:
        yield ids, found


def digests(formatted: DataFrame, controls: tuple[str, ...] = CONTROLS, id: str = "conv_id") -> DataFrame:
    """What the formatted text says when read back: turns, and the text under the loss mask."""
    schema = formatted.select(id).schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def run(batches):
        esc = Escaper(controls)
        for b in batches:
            out = []
            for s, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns, h, loss = read_turns(s, esc), hashlib.sha256(), "".join(esc.unescape(s[m["start"] : m["end"]]) for m in marks)
                for role, text in turns:
                    h.update(f"{role}\n{text}\n".encode())
                out.append((len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], [id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id, "formatted", "loss").mapInArrow(frugal(run), schema)
