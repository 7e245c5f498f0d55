"""Line diffs of two texts, as rows.

A diff keeps a longest common subsequence of lines; where two are equally long it
removes before it adds. Common first and last lines are trimmed, and what is left is
compared by the numbers of its lines, row by row with whole-array operations. A large
middle is cut in halves: the row of table sums that meets in the middle also carries the
column through which the one chosen diff passes, so that memory stays linear in the lines
and the result is the one that the whole table would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a table that is kept whole.
TABLE = 1 << 20
ROWS = "doc_id {}, ord int, op string, old_line int, new_line int, text string"


def lines(text: str) -> list[str]:
    """Lines without their ends; a last empty one is none."""
    found = text.split("\n")
    return [x.removesuffix("\r") for x in (found[:-1] if found[-1] == "" else found)]


def _row(before: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The lengths of common subsequences from one line of the old text on, from those of the next one."""
    best = before.copy()
    np.maximum(best[:-1], np.where(equal, before[1:] + 1, 0), out=best[:-1])
    return np.maximum.accumulate(best[::-1])[::-1]


def _whole(old: np.ndarray, new: np.ndarray) -> str:
    """The diff of two middles as a letter for each line: s(ame), r(emoved), a(dded)."""
    table = np.zeros((len(old) + 1, len(new) + 1), np.int32)
    for i in range(len(old) - 1, -1, -1):
        table[i] = _row(table[i + 1], new == old[i])
    out, i, j, a, b = [], 0, 0, old.tolist(), new.tolist()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append("s")
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            out.append("r")
            i += 1
        else:
            out.append("a")
            j += 1
    return "".join(out) + "r" * (len(a) - i) + "a" * (len(b) - j)


def _crossing(old: np.ndarray, new: np.ndarray, middle: int) -> int:
    """Where in the new text the chosen diff stands when it reaches the middle of the old one."""
    m = len(new)
    row, at = np.zeros(m + 1, np.int32), np.arange(m + 1)
    for i in range(len(old) - 1, -1, -1):
        equal = new == old[i]
        next_row = _row(row, equal)
        if i < middle:
            # from an added line the diff goes on to the next that is not
            added = np.append(~equal & (row[:-1] < next_row[1:]), False)
            leaves = np.append(np.where(equal, at[1:], at[:-1]), at[-1])
            goes = np.minimum.accumulate(np.where(added, m, np.arange(m + 1))[::-1])[::-1]
            at = leaves[goes]
        row = next_row
    return int(at[0])


def _middle(old: np.ndarray, new: np.ndarray, table: int) -> str:
    if len(old) < 2 or len(new) < 1 or (len(old) + 1) * (len(new) + 1) <= table:
        return _whole(old, new)
    half = len(old) // 2
    at = _crossing(old, new, half)
    return _middle(old[:half], new[:at], table) + _middle(old[half:], new[at:], table)


def diff(before: str, after: str, table: int = TABLE) -> list[tuple[str, int | None, int | None, str]]:
    """(op, old line, new line, text) of each line, `op` one of same, removed and added; lines count from 1."""
    old, new = lines(before), lines(after)
    number: dict[str, int] = {}
    a, b = (np.fromiter((number.setdefault(x, len(number)) for x in side), np.int64, len(side)) for side in (old, new))
    least = min(len(a), len(b))
    apart = np.flatnonzero(a[:least] != b[:least])
    head = int(apart[0]) if len(apart) else least
    apart = np.flatnonzero(a[::-1][: least - head] != b[::-1][: least - head])
    tail = int(apart[0]) if len(apart) else least - head
    letters = "s" * head + _middle(a[head : len(a) - tail], b[head : len(b) - tail], table) + "s" * tail
    out, i, j = [], 0, 0
    for letter in letters:
        if letter == "s":
            i, j = i + 1, j + 1
            out.append(("same", i, j, old[i - 1]))
        elif letter == "r":
            i += 1
            out.append(("removed", i, None, old[i - 1]))
        else:
            j += 1
            out.append(("added", None, j, new[j - 1]))
    return out


def with_context(found: list[tuple], context: int) -> list[tuple]:
    """A diff with `context` lines around each change; a row `gap` stands for each stretch that is left out."""
    changed = np.array([x[0] != "same" for x in found], dtype=np.int64)
    sums = np.concatenate(([0], np.cumsum(changed)))
    at = np.arange(len(found))
    near = sums[np.minimum(at + context + 1, len(found))] > sums[np.maximum(at - context, 0)]
    out: list[tuple] = []
    for x, keep in zip(found, near.tolist(), strict=True):
        if keep:
            out.append(x)
        elif not out or out[-1][0] != "gap":
            out.append(("gap", None, None, None))
    return out


def line_diffs(pairs: DataFrame, context: int | None = 1) -> DataFrame:
    """doc_id, ord, op, old_line, new_line, text of `pairs` (doc_id, before, after): a row for each line, or only for those
    within `context` lines of a change and a `gap` for each stretch between. A null text counts as empty; texts that are equal give no rows."""
    kind = dict(pairs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, before, after in zip(range(batch.num_rows), batch.column(1), batch.column(2), strict=True):
                found = diff(before.as_py(), after.as_py())
                found = found if context is None else with_context(found, context)
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                ids = batch.column(0).take(pa.array([doc] * len(found), pa.int32()))
                rest = (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(found)), pa.int32()), *rest], names=["doc_id", "ord", "op", "old_line", "new_line", "text"])

    empty = F.lit("")
    texts = pairs.select("doc_id", F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after")).where("before <> after")
    return texts.mapInArrow(run, ROWS.format(kind))


def diff_texts(rows: DataFrame) -> DataFrame:
    """doc_id and the rows of `line_diffs` as one text, each line behind its mark."""
    mark = F.when(F.col("op") == "removed", "- ").when(F.col("op") == "added", "+ ").otherwise("  ")
    line = F.when(F.col("op") == "gap", "···").otherwise(F.concat(mark, "text"))
    by_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))  # the lines of one document
    return by_doc.select("doc_id", F.array_join("lines.line", "\n").alias("diff"))
