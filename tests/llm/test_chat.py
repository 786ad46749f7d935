"""The template language, and exact round trips of formatted conversations."""

import hashlib
import random

import pytest

from wattloom.llm import chat
from wattloom.llm.templates import Template, TemplateError, escape, fold, header, parse, unescape, unheader


@pytest.mark.parametrize(
    "source, values, text",
    [
        ("a{{ 1 + 2 }}b", {}, "a3b"),
        ("{{ x.y['z'] | upper ~ '!' }}", {"x": {"y": {"z": "q"}}}, "Q!"),
        ("{% for i in l %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"l": "ab"}, "1a,2b"),
        ("{% if a == 1 %}x{% elif a == 2 %}y{% else %}z{% endif %}", {"a": 2}, "y"),
        ("{% set n = 2 %}{{ n * 3 - 1 }}", {}, "5"),
        ("  {{- ' a ' | trim -}}  b{# no #}c", {}, "abc"),
        ("{{ 'yes' if m is defined else 'no' }}{{ n is not none }}", {"n": 1}, "noTrue"),
        ("{{ 2 in l and 3 not in l or false }}", {"l": [1, 2]}, "True"),
        ("{{ l[-1] }}{{ l[9] }}{{ '\\n' | tojson }}{{ l | length }}", {"l": [4, 5]}, '5"\\n"2'),
        ("{{ a | default('d') }}", {}, "d"),
    ],
)
def test_language(source, values, text):
    assert Template(source).render(**values).text == text


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ a | eval }}", "{% import os %}", "{% if a %}",
     "{{ 1 +", "{% for x in y %}{% endif %}", "{{ 'a' b }}", "{{ a is string }}"],
)
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_no_way_to_python_objects():
    with pytest.raises(TemplateError):
        Template("{{ a.real }}").render(a=3)
    with pytest.raises(TemplateError):
        Template("{{ a * 9 }}").render(a="x")


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 1 + 1 }}{% if on %}c{{ x }}{% else %}d{% endif %}e"), {"on": False})
    assert [p.kind for p in tree.parts] == ["print"] and tree.parts[0].parts[0].value == "ab2de"
    kept = fold(parse("{% set a = 1 %}{% if q %}{% set a = 2 %}{% endif %}{{ a }}"), {})
    assert kept.parts[-1].parts[0].kind == "name"


def test_generation_marks():
    out = Template("ab{% generation %}cd{% endgeneration %}e").render()
    assert out.text == "abcde" and out.spans == [(2, 2)]


def test_row_wise_closures_equal_the_whole():
    source = "<s>{% for m in messages %}[{{ m.role }}]{{ m.text }}{% endfor %}</s>"
    compiled = Template(source)
    before, message, after = compiled.by_message()
    items = [{"role": "r", "text": str(i)} for i in range(3)]
    parts = [before().text, *(message(i).text for i in items), after().text]
    assert "".join(parts) == compiled.render(messages=items).text
    for wrong in ("{{ messages }}", "{% for m in messages %}{{ other }}{% endfor %}", "x"):
        with pytest.raises(TemplateError):
            Template(wrong).by_message()


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choices("<|\\%\n0A3Ca25", k=rng.randint(0, 12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unheader(header(text)) == text and "\n" not in header(text)


def turns(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-(1 << 63) if t is None else t, r or "", x or ""))
    return by


def test_conversations_read_back(spark):
    rng = random.Random(4)
    control = ["<|im_end|>", "<|im_start|>assistant", "\n", "<", "|", "\\", "hallo", "é😀", "<\\|", "%0A", ""]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            text = "".join(rng.choices(control, k=rng.randint(0, 8)))
            rows.append((c, t, rng.choice(("user", "assistant", "system")), text))
    rows += [(50, t, "assistant", f"{t} " * 50) for t in range(3000)]
    rows += [(60, 0, None, None), (60, 1, "assistant", None), (60, 2, "a<|\nb", "x"), (None, 5, "user", "q")]
    rows += [(61, 1, "user", "same"), (61, 1, "user", "same"), (61, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    from pyspark.sql import functions as F

    frame = frame.repartition(5).withColumns({c: F.lit("x") for c in ("key", "piece", "starts")})
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    by = turns(rows)
    assert set(got) == set(by)
    for c, said in by.items():
        said = sorted(said, key=lambda t: t[0])
        whole = "".join(f"{r}\n{x}\n" for _, r, x in said)
        learnt = "".join(x for _, r, x in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        messages = [{"role": r, "text": x} for _, r, x in said]
        formatted = Template(chat.CHAT).render(messages=messages).text
        assert r.formatted_chars == len(formatted)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(empty).count() == 0
