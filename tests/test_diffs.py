"""Line diffs against a table of all common subsequences, filled cell by cell."""

import random
from functools import cache

import pytest
from quillspark.operators import diffs


def plain(before, after):
    """(op, text) by the whole table, without trimming."""
    old, new = diffs.lines(before), diffs.lines(after)

    @cache
    def common(i, j):
        if i == len(old) or j == len(new):
            return 0
        return common(i + 1, j + 1) + 1 if old[i] == new[j] else max(common(i + 1, j), common(i, j + 1))

    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append(("same", old[i]))
            i, j = i + 1, j + 1
        elif j == len(new) or i < len(old) and common(i + 1, j) >= common(i, j + 1):
            out.append(("removed", old[i]))
            i += 1
        else:
            out.append(("added", new[j]))
            j += 1
    return out


def trimmed(before, after):
    """The same for texts whose first and last common lines stand aside."""
    old, new = diffs.lines(before), diffs.lines(after)
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    middle = lambda x: "\n".join(x[head : len(x) - tail]) + "\n" * (len(x) > head + tail)
    return [("same", x) for x in old[:head]] + plain(middle(old), middle(new)) + [("same", x) for x in old[len(old) - tail :]]


@pytest.mark.parametrize("table", [1 << 20, 12, 1])
def test_against_the_whole_table(table):
    """Also where the middle is halved again and again."""
    draw = random.Random(table)
    for n in range(400):
        a, b = ("\n".join(draw.choices("abcde", k=draw.randint(0, 14))) + draw.choice(["", "\n", "\n\n"]) for _ in range(2))
        found = diffs.diff(a, b, table)
        assert [(op, text) for op, _, _, text in found] == trimmed(a, b)
        assert [o for _, o, _, _ in found if o] == list(range(1, len(diffs.lines(a)) + 1))
        assert [x for _, _, x, _ in found if x] == list(range(1, len(diffs.lines(b)) + 1))


def test_known_diffs():
    ops = lambda a, b: [(op[0], text) for op, _, _, text in diffs.diff(a, b)]
    assert ops("a\nb", "a\nb") == [("s", "a"), ("s", "b")]
    assert ops("a\nold\nc", "a\nnew\nc") == [("s", "a"), ("r", "old"), ("a", "new"), ("s", "c")]
    assert ops("", "x\r\ny\r\n") == [("a", "x"), ("a", "y")]
    shown = diffs.with_context(diffs.diff("a\nb\nc\nd\ne\nf", "a\nb\nc\nX\ne\nf"), 1)
    assert [x[0] for x in shown] == ["gap", "same", "removed", "added", "same", "gap"]


def test_large_texts_in_little_memory():
    draw = random.Random(8)
    old = [str(draw.randint(0, 400)) for _ in range(3000)]
    new = [x for x in old if draw.random() > 0.1]
    for _ in range(200):
        new.insert(draw.randint(0, len(new)), "new" + str(draw.randint(0, 9)))
    old[0], old[-1] = "first", "last"  # nothing to trim
    assert diffs.diff("\n".join(old), "\n".join(new), 1 << 12) == diffs.diff("\n".join(old), "\n".join(new), 1 << 30)


def test_rows(spark):
    rows = [(1, "a\nb\nc", "a\nB\nc", "x"), (2, "same", "same", "x"), (3, None, "n\nm", "x"), (3, None, "n\nm", "x"), (None, "gone\n", None, "x"), (4, "", None, "x")]
    pairs = spark.createDataFrame(rows, "doc_id long, before string, after string, text string")
    got = sorted(map(tuple, diffs.line_diffs(pairs, None).collect()), key=repr)
    each = [(3, 0, "added", None, 1, "n"), (3, 1, "added", None, 2, "m")]
    assert got == sorted([(1, 0, "same", 1, 1, "a"), (1, 1, "removed", 2, None, "b"), (1, 2, "added", None, 2, "B"), (1, 3, "same", 3, 3, "c"), *each, *each, (None, 0, "removed", 1, None, "gone")], key=repr)
    shown = {r.doc_id: r.diff for r in diffs.diff_texts(diffs.line_diffs(pairs.where("doc_id = 1"), 0)).collect()}
    assert shown == {1: "···\n- b\n+ B\n···"}
    assert diffs.line_diffs(pairs.limit(0)).collect() == []
