"""Sources: samples with the place of what is wrong, folders in the order of their paths, single files, streams of scores; means and slices."""

import io
import zipfile

import pytest
from quillspark.operators import evaluate, mining
from quillspark.rules.model import Rule, RuleSet
from quillspark.sources import readers

XML = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t> &amp; two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t><w:br/></w:r></w:p></w:body></w:document>'


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", XML)
    return out.getvalue()


def test_samples(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "a", "label": "ai", "text": "x\\ny", "word_count": 3, "split": "test", "other": 1}\n\n  \n{"id": "b", "label": "human", "text": "é"}\n')
    got = readers.read_samples(spark, str(good)).orderBy("id").collect()
    assert [(r.id, r.label, r.text, r.word_count, r.split) for r in got] == [("a", "ai", "x\ny", 3, "test"), ("b", "human", "é", None, None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a", "label": "ai", "text": "x"}\n\n{"id": "b", "label"\n{"id": "c", "label": "ai", "text": 5}\n')
    with pytest.raises(Exception, match=r'bad\.jsonl: invalid JSON: \{"id": "b", "label"'):
        readers.read_samples(spark, str(bad)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.line) for r in readers.invalid_samples(spark, str(tmp_path)).collect()] == [("bad.jsonl", 3)]


def test_corpus(spark, tmp_path):
    folder = tmp_path / "c"
    (folder / "b" / ".hidden").mkdir(parents=True)
    for name, data in {"b/z.md": b"# Head", "a.txt": "né".encode(), "b/y.docx": docx(), "b/blank.txt": b" \n", "b/x.pdf": b"%", ".dot.txt": b"no", "b/.hidden/q.txt": b"no", "A.TEXT": b"upper", "b/w.markdown": b"m"}.items():
        (folder / name).write_bytes(data)
    got = readers.read_corpus(spark, str(folder)).collect()
    assert [r.path.split("/c/")[1] for r in got] == ["A.TEXT", "a.txt", "b/w.markdown", "b/y.docx", "b/z.md"]
    by = {r.path.rsplit("/", 1)[1]: r for r in got}
    assert by["y.docx"].text == "One\t & two\n\nThree\n\n\n" and by["a.txt"].text == "né"
    assert {n: (r.register, r.markdown) for n, r in by.items()} == {"A.TEXT": ("plain-text", False), "a.txt": ("plain-text", False), "w.markdown": ("markdown", True), "y.docx": ("document", False), "z.md": ("markdown", True)}
    assert [r.text for r in readers.read_corpus(spark, str(folder / "a.txt")).collect()] == ["né"]
    with pytest.raises(ValueError, match=r"x\.pdf"):
        readers.read_corpus(spark, str(folder / "b" / "x.pdf"))


def test_means_slices_and_discipline(spark):
    rows = [("ai", "naive", 10), ("ai", "naive", 20), ("ai", "edit", 60), ("human", None, 90), ("human", "x", 70)]
    df = spark.createDataFrame(rows, "label string, prompt_style string, score int")
    assert {(r.prompt_style, r.label): (r.mean_score, r.n) for r in evaluate.class_means(df, "prompt_style").collect()}[("naive", "ai")] == (15.0, 2)
    assert sorted((r.label, r.score) for r in evaluate.combined_slice(df, "naive").collect()) == [("ai", 10), ("ai", 20), ("human", 70), ("human", 90)]
    found = spark.createDataFrame([("ai", True, True), ("human", False, True), ("human", False, False), ("human", True, True)], "label string, negated boolean, negational boolean")
    r = evaluate.verdict_discipline(found).first()
    assert (r.emitted, r.dropped_negative, r.human_kept, r.human_kept_negational, r.negation_rate, r.surviving_rate) == (4, 2, 2, 1, 0.5, 0.5)
    none = evaluate.verdict_discipline(found.limit(0)).first()
    assert (none.emitted, none.negation_rate, none.surviving_rate) == (0, 0.0, 0.0)


def test_candidates(spark):
    rows = [("a", r"\bx\b", 1, 0), ("b", r"\BX\b".replace("B", "b"), 0, 5), ("c", "y", 0, 6), ("d", r"\bX\b", 2, 0)]
    df = spark.createDataFrame(rows, "id string, pattern string, lens_ix int, ix int")
    assert {r.id for r in mining.first_of_each(df).collect()} == {"b", "c"}
    docs = spark.createDataFrame([(1, "alpha beta\n\n" + "gamma " * 400 + "\n\nalpha"), (2, None), (3, "beta")], "doc_id long, text string")
    rules = RuleSet((Rule("alpha", "phrase", patterns=("alpha",)), Rule("beta", "phrase", patterns=("beta",)), Rule("no", "phrase", patterns=("delta",), examples=(("delta", "x"),)), Rule("odd", "phrase", patterns=("omega",), examples=(("none", "x"),))))
    assert sorted(map(tuple, mining.self_firing_chunks(docs, rules).collect())) == [("core/alpha", 2, 1, 0), ("core/beta", 2, 1, 0)]
    assert {r.rule_id: r.ok for r in mining.consistent(rules, docs).collect()} == {"core/alpha": False, "core/beta": False, "core/no": True, "core/odd": False}


def test_canonical_pairs(spark):
    """Each rule flags the one text and leaves the other alone; corpora without a fitting sentence get them."""
    import re

    rules, pairs = mining.family_seeks() + mining.mark_seeks(), mining.canonical_pairs()
    for name, flags, _, _ in rules:
        bad, good = pairs[name]
        assert re.search(flags, bad) and not re.search(flags, good), name
    docs = spark.createDataFrame([(2, "We took the red, the green, and the blue one."), (1, "Short, one."), (3, None)], "doc_id long, text string")
    got = {r.name: (r.bad, r.good, r.mined) for r in mining.synthesized(docs, rules, pairs).collect()}
    assert len(got) == len(rules) and got["serial-comma"] == ("We took the red, the green and the blue one.", "We took the red, the green, and the blue one.", True)
    assert got["no-em-dash"][0] == "We took the red—the green, and the blue one." and got["no-utilize"] == (*pairs["no-utilize"], False)
    assert {r.name for r in mining.synthesized(docs, rules).collect()} == {n for n, x in got.items() if x[2]}


def test_mined_candidates(spark):
    import json

    pair = [{"bad": "b", "good": "g"}]
    rule = lambda **k: {"id": "No X!", "description": "Never x.", "examples": pair, "patterns": ["x"]} | k
    first = [rule(severity="error", patterns=["x", {"pattern": "y+", "fix": "z", "message": "m"}, " "]), rule(), rule(id="--", engine="leading", mined_from=" a memo "), rule(id="q", engine="density"), rule(id="q", severity="info")]
    second = [rule(id="no-x"), rule(id="e", examples=[]), rule(id="d", description=" . "), rule(id="p", patterns=[]), rule(id="e")]
    rows = [(0, "tone", "Here:\n```json\n" + json.dumps(first) + "\n```"), (1, "form", json.dumps(second)), (2, "none", "no list"), (3, None, None)]
    got = mining.mined_candidates(spark.createDataFrame(rows, "lens_ix int, lens string, answer string"), "m1").orderBy("lens_ix", "ix").collect()
    taken = "an id that is taken"
    assert [(r.id, r.reason) for r in got] == [
        ("no-x", None), ("no-x", taken), ("mined-3", None), ("q", "engine density is not one of phrase and leading"), ("q", None),
        ("no-x", taken), ("e", "no examples"), ("d", "no description"), ("p", "no pattern"), ("e", None),
    ]
    assert (got[0].severity, got[0].patterns, got[0].description) == ("warning", ["x", "y+"], "Never x (mined by m1, lens: tone, from your corpus sample).")
    assert got[2].description == "Never x (mined by m1, lens: tone, from a memo)." and got[4].severity == "suggestion" and got[2].engine == "leading"
