"""Tokens, windows around findings, listings and summaries against plain readings; long texts stay linear."""

import random
import re
import time

from pyspark.sql import functions as F
from quillspark.functions import sentences
from quillspark.operators import lint, render
from quillspark.rules.model import Options


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def plain_tokens(text):
    out, i = [], 0
    while i < len(text):
        c, j = text[i], i + 1
        if c.isspace():
            i += 1
            continue
        if c.isalpha():
            while j < len(text) and (text[j].isalnum() or text[j] in "'’-" and j + 1 < len(text) and text[j + 1].isalnum()):
                j += 1
            kind = "word"
        elif c in "0123456789":
            while j < len(text) and (text[j] in "0123456789" or text[j] in ".," and text[j + 1 : j + 2] in list("0123456789")):
                j += 1
            kind = "number"
        else:
            kind = "punct"
        out.append((i, j, kind, text[i:j]))
        i = j
    return out


def test_tokens(spark):
    draw = random.Random(2)
    texts = ["", "don't e-mail café’s 1,000.5, 3.x -a- 'b'", "🙂 中文 ß1a 1a2 ...!?", " \n\t", "a" * 5000] + ["".join(draw.choices("ab1 .,'-’é\n🙂(", k=40)) for _ in range(200)]
    got = frame(spark, *texts).select("doc_id", sentences.tokens(F.col("text")).alias("t"), sentences.sentences(F.col("text")).alias("s")).collect()
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), texts, strict=True):
        assert [tuple(t) for t in r.t] == plain_tokens(text)
    for r in got:
        for s in r.s:
            assert s.n_words == sum(k != "punct" for _, _, k, _ in plain_tokens(s.text))


def plain_window(text, a, b, context=36):
    """Over bytes, as one walks from the match outwards."""
    first, last = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    last = len(text) if last < 0 else last
    left, right = a, b
    while left > first and len(text[left:a].encode()) < context:
        left -= 1
    while right < last and len(text[b:right].encode()) < context:
        right += 1
    if left > first and " " in text[left:a]:
        left = text.index(" ", left) + 1
    if right < last and " " in text[b:right]:
        right = text.rindex(" ", b, right)
    parts, spaced = ["", "", ""], False
    for i in range(left, right):
        slot = 0 if i < a else 1 if i < b else 2
        if text[i].isspace():
            parts[slot] += "" if spaced else " "
        else:
            parts[slot] += text[i]
        spaced = text[i].isspace()
    before, match, after = parts[0].lstrip(), parts[1], parts[2].rstrip()
    match = match if len(match) <= 90 else match[:45] + "…" + match[-44:]
    lead = "…" if left > first else ""
    caret = " " * len(lead + before) + "^" * len(match) if 0 < len(match) <= 60 else None
    return lead + before + match + after + ("…" if right < last else ""), caret


def test_windows(spark):
    draw = random.Random(5)
    rows = [("", 0, 0), ("abc", 1, 1), ("x " * 60 + "\n" + "y" * 40, 119, 125), ("a  \t b", 2, 4), ("é" * 100, 50, 52), ("word " * 60, 100, 250)]
    for _ in range(400):
        text = "".join(draw.choices(["a", "bc", " ", "  ", "\n", "é", "🙂", "\t", "longerword"], [9, 5, 6, 1, 0.4, 1, 1, 0.4, 2], k=draw.randint(1, 160)))
        a, b = sorted(draw.choices(range(len(text) + 1), k=2))
        rows.append((text, a, draw.choice([b, min(len(text), a + 3)])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, a int, b int")
    for r in df.select("i", render.window(F.col("text"), F.col("a"), F.col("b")).alias("w")).collect():
        assert tuple(r.w) == plain_window(*rows[r.i]), rows[r.i]


def test_listings(spark):
    found = lint.find(frame(spark, "We utilize it.\nAll is well; so.", "All is well.", ""), options=Options(enable=("prefer-short-words", "no-semicolons")))
    got = {r.doc_id: r for r in render.listings(found, keep=(render.summary(lint.core_rules(), Options(enable=("prefer-short-words",))).alias("summary"),)).collect()}
    assert got[1].listing.split("\n")[:3] == ["1:4  suggestion  Prefer short words.  core/prefer-short-words", "    We utilize it.", "       ^^^^^^^"]
    assert got[2].listing == got[3].listing == "No findings." and got[3].summary.startswith("0 words · 0 sentences\n")
    lines = got[1].summary.split("\n")
    assert lines[0] == "7 words · 2 sentences" and re.match(r"static: 1 of \d+ run, 2 findings", lines[1]) and lines[-1] == "2 findings · 1 with a fix"


def test_documents_without_findings_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "All is well."), (2, "Well; so."), (2, "Well; so."), (3, None)], "doc_id long, text string")
    found = lint.find(docs, options=Options(enable=("no-semicolons",)))
    assert sorted((r.doc_id, r.exit_code) for r in render.exit_codes(found).collect()) == [(1, 0), (2, 1), (2, 1), (3, 0)]
    assert [r.doc_id for r in render.as_json(docs, options=Options(enable=("no-semicolons",))).collect()] == [2, 2]
    assert [r.brief.count("- line 1: Well; so.") for r in render.revision_briefs(docs, options=Options(enable=("no-semicolons",))).collect()] == [1, 1]
    assert "Exchange" not in render.exit_codes(found)._jdf.queryExecution().executedPlan().toString()


def test_long_text_with_many_findings(spark):
    """A hundred thousand words and five thousand findings take seconds, places and windows included."""
    text = "\n".join("alpha beta gamma delta epsilon zeta eta theta iota kappa; lambda mu nu xi omicron pi rho sigma tau upsilon" for _ in range(5000))
    options = Options(enable=("no-semicolons",))
    began = time.time()
    rows = render.windows(lint.find(frame(spark, text), options=options)).collect()
    fixed = lint.fixed(frame(spark, text.replace("kappa;", "utilize")), options=Options(enable=("prefer-short-words",))).first()
    assert len(rows) == 5000 and {(r.ord + 1, r.column) for r in rows} == {(r.line, 57) for r in rows}
    assert fixed.n_fixes == 5000 and time.time() - began < 90


def test_long_text_with_directives(spark):
    """Directives in a text of thousands of lines and findings."""
    lines = ["We utilize it; so."] * 3000
    lines[10], lines[20], lines[2000] = "prose-disable no-semicolons", "prose-enable", "prose-disable-next-line"
    options = Options(enable=("no-semicolons", "prefer-short-words"))
    began = time.time()
    (r,) = lint.find(frame(spark, "\n".join(lines)), options=options).collect()
    by = {n: sum(f.rule_id == n for f in r.findings) for n in ("core/no-semicolons", "core/prefer-short-words")}
    assert by == {"core/no-semicolons": 2997 - 9 - 1, "core/prefer-short-words": 2997 - 1} and time.time() - began < 60
