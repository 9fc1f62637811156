import hashlib
import random

import pytest

from pagewright.llm import chat_template as c


def test_template_language():
    render = c.compiled("{%- if 1 + 1 == 2 and 'a' in 'abc' -%} yes {{- 'x' | upper }}{% else %}no{% endif %}{% for m in messages %}{% set k = loop.index0 + 1 %}[{{ k }}{{ m['t'] }}{{ m.missing }}{{ loop.last }}]{% endfor %}")
    assert render([{"t": "p"}, {"t": "q"}])[0] == "yesX[1pfalse][2qtrue]"
    text, mask = c.compiled("a{% generation %}{% for m in messages %}{{ m.t }}{% endfor %}{% endgeneration %}b")([{"t": "é"}, {"t": "🙂z"}])
    assert text == "aé🙂zb" and mask == [(1, 4)]


def test_constants_are_folded():
    assert c.fold(c.parse("a{{ 'b' + 'c' }}{% if not true %}d{{ x }}{% elif 2 > 1 %}e{% endif %}f")) == (c.Emit(c.Const("abcef")),)
    assert c.fold(c.parse("{% if x and (false or true) %}1{% endif %}")) == (c.If(((c.Name("x"),) and (c.Apply("and", (c.Name("x"), c.Const(True))), (c.Emit(c.Const("1")),)),)),)


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a b }}", "{{ x.__class__() }}", "{{ 'a' | system }}", "{% endfor %}", "{{ 1 + 'a' }}", "{{ }}"])
def test_wrong_templates(bad):
    with pytest.raises(c.TemplateError):
        c.compiled(bad)


def test_sandbox():
    with pytest.raises(c.TemplateError):
        c.compiled("{{ messages.__class__ }}")([])
    with pytest.raises(c.TemplateError):
        c.compiled("{{ os }}")([])
    assert c.compiled("{% for m in messages %}{{ m.__class__ }}{% endfor %}")([{"a": 1}])[0] == ""


def test_escaping_is_reversible():
    r = random.Random(2)
    parts = [*c.CONTROLS, "\\", "<", "[", "s>", "INST]", "/", "a", " ", "<\\s>", "[\\\\/INST]"]
    for _ in range(20_000):
        t = "".join(r.choices(parts, k=r.randint(0, 7)))
        e = c.escape(t)
        assert c.unescape(e) == t and not any(x in e for x in c.CONTROLS)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        pairs = [(t[3], t[5]) for t in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        d = lambda s: hashlib.sha256(s.encode()).hexdigest()
        size = 3 + sum(len(c.escape(t)) + {"user": 15, "assistant": 4}.get(r, 23 + len(c.escape(r))) for r, t in pairs)
        out.append((conv, len(pairs), d("".join(f"{r}\n{t}\n" for r, t in pairs)), len(loss), d(loss), size))
    return sorted(out, key=str)


def test_conversations(spark):
    r = random.Random(7)
    parts = [*c.CONTROLS, "\\", "<", "[", " ", "\n", "é🙂", "words", "<s", "[/"]
    rows = [(r.randint(0, 60), r.randint(0, 5), r.choice(["user", "assistant", "system", "tool", "", None, "</s>"]), r.choice([None, "", *["".join(r.choices(parts, k=r.randint(1, 9)))] * 6])) for _ in range(500)]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (70, None, "user", "x" * 1_000_000), rows[0], (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    out = c.digests(c.format_conversations(df))
    assert sorted((tuple(x) for x in out.collect()), key=str) == expected(rows)
    assert c.digests(c.format_conversations(df.limit(0))).count() == 0
