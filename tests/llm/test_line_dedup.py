"""Line dedup against a row-at-a-time version and SQL."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, awkward, clashing, docs
from wiresift.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(rows, near_chars, max_edits):
    """{(id, text): what stays of it}"""
    first = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if line:
                place = (i is None, i or 0, pos)
                first[line] = min(first.get(line, place), place)
    long = [a for a in first if len(a) >= near_chars]
    near = {a for a in long for b in long
            if first[b] < first[a] and abs(len(a) - len(b)) <= max_edits and distance(a, b) <= max_edits}
    out = {}
    for i, text in rows:
        if text is None:
            out[i, text] = None
            continue
        stays = []
        for pos, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if line not in first or line not in near and first[line] == (i is None, i or 0, pos):
                stays.append(raw)
        out[i, text] = "\n".join(stays)
    return out


def run(spark, rows, near_chars, max_edits):
    got = line_dedup.dedup_lines(docs(spark, rows).selectExpr("*", "text AS before"), near_chars, max_edits).collect()
    return {(r.doc_id, r.before): r.text for r in got}


def edit(rng, line):
    at = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    return line[:at] + rng.choice("abé的 ") * (kind != 1) + line[at + (kind != 0):]


def test_edited_lines(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice("ab é") for _ in range(rng.choice((3, 4, 5, 8, 9, 17, 40, 63, 64, 65, 130)))) for _ in range(40)]
    rows = []
    for i in range(60):
        mine = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(lines)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                line = edit(rng, line)
            mine.append(rng.choice(("", " ", "\t")) + line)
        rows.append((rng.choice((i, i, i, None)), "\n".join(mine)))
    for near_chars, max_edits in ((1, 1), (5, 1), (4, 0)):
        assert run(spark, rows, near_chars, max_edits) == slow(rows, near_chars, max_edits)


def test_short_lines(spark):
    """Exact repeats go however short they are; short lines one edit apart stay."""
    rows = [(1, "}\n\nRead more\n  \nRead mare"), (2, " Read more\n\n}\nx"), (None, "x\ny\nShare this"), (5, "y\n}\n}")]
    assert run(spark, rows, 20, 1) == slow(rows, 20, 1) == {
        rows[0]: "}\n\nRead more\n  \nRead mare", rows[1]: "\nx", rows[2]: "Share this", rows[3]: "y"}


def test_many_lines_one_character_apart(spark):
    rows = [(i, f"this is line number {i} of a very long list") for i in range(300)]
    assert run(spark, rows, 5, 1) == slow(rows, 5, 1)


def test_shuffled_sides(spark, monkeypatch):
    from wiresift.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rng = random.Random(4)
    rows = [(i, edit(rng, "the same words in each of the lines") + f"\nown line {i} " + "z" * i) for i in range(30)]
    assert run(spark, rows, 5, 1) == slow(rows, 5, 1)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=14), st.text("ab", min_size=1, max_size=14))
def test_blocks_cover_one_edit(a, b):
    """The narrowing in Python: neighbours share a half and a block's surroundings."""
    if a == b or distance(a, b) > 1:
        return
    a, b = sorted((a, b), key=len)
    size = len(a)
    assert a[:size // 2] == b[:size // 2] or a[len(a) - size // 2:] == b[len(b) - size // 2:]
    n = max(8, int(size ** 0.5))
    width = -(-size // n)
    assert any(a[:p] == b[:p] and a[len(a) - s:] == b[len(b) - s:]
               for j in range(n) if (p := j * width) < size for s in [max(0, size - p - width)])


def test_awkward(spark):
    df = awkward(spark)
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*DOCS.names, "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = slow(rows, line_dedup.NEAR_CHARS, 0)
    assert sorted(map(repr, (r.text for r in got.collect()))) == sorted(map(repr, (want[k] for k in rows)))
    assert {r.n_lines for r in got.where("text IS NULL").collect()} == {0}
    extra = line_dedup.dedup_lines(clashing(df))
    assert extra.count() == 12 and {"fp", "doc", "half"} <= set(extra.columns)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup_lines(awkward(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
