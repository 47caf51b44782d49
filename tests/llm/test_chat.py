"""Template language, escaping and formatted conversations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bayesmill.llm import chat as C


def test_folding_leaves_one_text():
    t = C.Template("a{{ 'b' + 'c' }}{% if 1 < 2 %}{{ 3 }}{% else %}x{% endif %}d")
    assert t.tree == [("emit", ("const", "abc3d"))]
    assert t.render() == ("abc3d", [])


def test_blocks_loops_filters_and_marks():
    t = C.Template("{% set n = 'x' %}{% for m in ms %}{{ loop.index }}{{ n }}{% if m.a in 'pq' and not loop.last %}{% generation %}{{ m['a'] | upper }}{% endgeneration %}{% elif m.a == none %}-{% else %}{{ m.a | trim | length }}{% endif %};{% endfor %}")
    assert t.render(ms=[{"a": "p"}, {}, {"a": " zz "}])[0] == "1xP;2x-;3x2;"
    text, marks = t.render(ms=[{"a": "p"}, {"a": " zz "}])
    assert text == "1xP;2x2;" and [text[a:b] for a, b in marks] == ["P"]


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a.__class__() }}", "{{ a | nofilter }}", "{% endif %}", "{% import os %}", "{{ }}", "{{ 'a }}", "a {{ b", "{% set a b %}", "{% if %}{% endif %}"])
def test_bad_templates(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad)


def test_strings_may_hold_the_ends_of_tags():
    assert C.Template("{{ '}}' + \"%}\" }}{% set a = '{%' %}{{ a }}{{ 'it\\'s' }}").render()[0] == "}}%}{%it's"


def test_minus_drops_white_space():
    assert C.Template("a \n{%- if x -%} \n b {{- 'c' -}} \t{%- endif %} d").render(x=1)[0] == "abc d"
    assert C.Template("a {{ 3 - 1 }} b {{ ms[-1] }}").render(ms=[1, 2])[0] == "a 2 b 2"
    assert C.Template("{%\nif\nx not in 'pq'\n%}y{% elif(x == 'q') %}q{% else %}n{% endif %}").render(x="q")[0] == "q"


def test_values_that_do_not_fit():
    for bad in ("{{ 1 | length }}", "{{ 'a' - 1 }}", "{{ 1 < 'a' }}", "{% for x in 3 %}{% endfor %}", "{{ x | length }}"):
        t = C.Template("{% if go %}" + bad + "{% endif %}")
        assert t.render(go=False) == ("", [])
        with pytest.raises(C.TemplateError):
            t.render(go=True)
    assert C.Template("{{ false and (1 - 'a') }}").render()[0] == "false"


def test_no_attributes_are_reachable():
    with pytest.raises(C.TemplateError):
        C.Template("{{ m.__class__ }}").render(m="text")
    assert C.Template("{{ m.__class__ }}").render(m={}) == ("", [])


def test_escaping_round_trip():
    esc, rng = C.Escaper(C.CONTROLS), random.Random(1)
    bits = ["<", "\\", "|im_end|>", "|im_start|>", "<|im_end|>", "im", "é", "\n", "<\\|im_end|>"]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        e = esc.escape(s)
        assert esc.unescape(e) == s and not any(c in e for c in C.CONTROLS)


def test_query(spark):
    rows = [
        (1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 5, "assistant", ""),
        (None, 0, "a\\n\nb", "<\\|im_end|>é"), (3, 0, "assistant", "x" * 100_000), (3, 0, "assistant", "y"), (-1, 0, "user", C.STOP + C.START), (4, 2, "us<|im_start|>er", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in C.digests(C.format_conversations(df)).collect()}
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: [(v is not None, v) if v is not None else (False, 0) for v in r]):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.format_conversations(df.limit(0)).count() == 0
