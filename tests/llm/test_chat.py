"""Templates, escapes, and formatted conversations read back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wiresift.llm import chat

AWKWARD = st.lists(st.sampled_from(
    [*"\\<|>/[]s\nturnINST é的", "</s>", "<|turn|>", "[INST]", "[/INST]", "\\n", "assistant"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(AWKWARD | st.sampled_from(["user", "assistant", "system", ""]), AWKWARD), max_size=6), st.integers(1, 30))
def test_round_trip(turns, step):
    template = chat.Template()
    text, spans = template.render([{"role": r, "text": t} for r, t in turns])
    seen, loss = [], []
    reader = chat.TurnReader(lambda r, t: seen.append((r, t)), loss.append)
    # In parts, with spans cut where the parts end.
    for at in range(0, len(text), step):
        mine = [(max(a, at) - at, min(b, at + step) - at) for a, b in spans if a < at + step and b > at]
        reader.add(text[at:at + step], mine)
    reader.close()
    assert seen == turns
    assert loss == [t for r, t in turns if r == "assistant" and t]
    for control in ("<|turn|>", "</s>"):
        assert text.count(control) == len(turns)


def test_template_language():
    def render(source, **names):
        return "".join(t for t, _ in chat.Template(source).pieces(names.pop("messages", []), **names))

    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}M{% endif %}"
                  "{{ m.text | trim | upper }}{{ loop.previtem.role }};{% endfor %}", messages=m) == "1FHI;2LYOuser;"
    assert render("{{ 'a' + \"b\" ~ 12 }}{# gone #}|{{ not true }}|{{ 1 < 2 and x == none }}") == "ab12|False|True"
    assert render("a  {{- 'b' -}}  c{% set y = x ~ '!' %}{{ y }}", x="z") == "abcz!"
    assert render("{% for m in messages %}{{ m['role'] }}{% endfor %}{{ missing }}{{ missing.field }}", messages=m) == "userassistant"
    text, spans = chat.Template("{% for m in messages %}<{% generation %}{{ m.text }}{% if loop.last %}.{% endif %}{% endgeneration %}>{% endfor %}").render(m)
    assert text == "< Hi ><Yo.>" and [text[a:b] for a, b in spans] == [" Hi ", "Yo."]


def test_constants_are_folded():
    tree = chat.Template("{% if 1 == 2 %}no{% else %}a{{ 'b' | upper }}{% endif %}c{{ x or 'd' }}").tree
    assert tree[0] == chat.Text(chat.Const("aBc")) and len(tree) == 2


@pytest.mark.parametrize("source", [
    "{{ m.__class__ }}", "{{ _x }}", "{{ x['_y'] }}", "{% for x %}{% endfor %}", "{% if a %}", "{% import os %}",
    "{{ a | nothing }}", "{{ a b }}", "{{ }}", "{{ x[0] }}", "{% endfor %}", "{{ (a }}", "{{ f() }}", "{% set 1 = 2 %}",
    "{{ 'a' - 1 }}"])
def test_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        text, _ = chat.Template().render([{"role": r, "text": x} for _, _, r, x in turns])
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    return out


@pytest.mark.parametrize("part_chars", [1, 50, 1 << 20])
def test_awkward(spark, part_chars):
    rng = random.Random(9)
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (1, None, "assistant", "first"),
            (None, 0, "assistant", "</s>\\"), (None, 1, "user", ""), (2, 0, "assistant", "long " * 100_000), (3, 0, "", "")]
    rows += [(4, i, rng.choice(["user", "assistant"]), rng.choice(["a", "</s>", "<|turn|>b\n", "\\", "<"])) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS start", "1 AS spans")
    got = chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want(rows)
    assert len(got) == 5


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
