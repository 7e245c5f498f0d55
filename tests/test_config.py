"""Options by place: the nearest configuration, layered, against plain lookups and against runs with the same options for all."""

import json
import random

import pytest
from pyspark.sql import functions as F
from quillspark.operators import config, lint
from quillspark.rules.model import Options

TEXT = (
    "Perhaps we utilize it; perhaps not. We went home. We saw it. We left early. They ran far. It is red, green, and blue.\n\n"
    "Very really, in order to facilitate the majority of it, one two three four five six seven eight nine ten one two three four five six seven eight nine ten. Short one. Perhaps."
)


def files(spark, rows):
    return spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in rows], "path string, content string")


def as_options(found, base=None):
    """What a row of options says, as the run's own options."""
    if found is None:
        return base or Options()
    return Options(enable=None if found.enable is None else tuple(found.enable), disable=tuple(found.disable or ()), severity=dict(found.severity or {}), thresholds=dict(found.thresholds or {}))


def test_nearest(spark):
    draw = random.Random(3)
    names = "abc"
    folders = {"/".join(["", *draw.choices(names, k=draw.randint(1, 5))]) for _ in range(60)} | {"", "/a", "rel/b", "file:/x/a"}
    held = {f: {"disable": [], "thresholds": {"no-hedging": float(i)}} for i, f in enumerate(sorted(folders)) if draw.random() < 0.4}
    rows = []
    for f, options in held.items():
        which = draw.choice([0, 1, 2])
        rows += [(f"{f}/{config.NAMES[0]}", options)] if which != 1 else []
        rows += [(f"{f}/{config.NAMES[1]}", options if which == 1 else {"thresholds": {"no-hedging": -1.0}})] if which else []
    rows += [("/a/config.json", {}), ("/a/x.prose.config.json", {})]
    docs = [(i, f"{f}/doc{i}.txt", "clash") for i, f in enumerate([*folders, *folders])] + [(900, "/a/b/c/d/e/f/g/h.txt", "x"), (901, "bare.txt", "x"), (902, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, path string, folder string")
    got = {r.doc_id: r.options for r in config.with_options(df, config.configurations(files(spark, rows), lint.core_rules())).collect()}
    assert len(got) == len(docs)
    for i, path, _ in docs:
        at = None if path is None else path.rpartition("/")[0]
        while at is not None and at not in held:
            at = at.rpartition("/")[0] if "/" in at else None
        thresholds = got[i].thresholds if got[i] is not None else None
        assert thresholds == (None if at is None else {"core/no-hedging": held[at]["thresholds"]["no-hedging"]}), path
    assert config.with_options(df, config.configurations(files(spark, rows).limit(0), lint.core_rules())).where("options.thresholds is not null").count() == 0


def test_layers_and_names(spark):
    user = {"disable": ["no-semicolons"], "severity": {"no-hedging": "error", "prefer-short-words": "info"}, "thresholds": {"core/no-hedging": 3, "no-hedging": 9}, "markdown": True, "other": 1}
    near = {"enable": ["prefer-short-words", "unknown"], "severity": {"no-hedging": "suggestion"}, "thresholds": {"no-passive-overuse": 1.5}}
    rules = lint.core_rules()
    df = spark.range(1).select(config.layered(config.parsed(F.lit(json.dumps(user)), F.lit("u"), rules), config.parsed(F.lit(json.dumps(near)), F.lit("n"), rules)).alias("o"))
    o = df.first().o
    assert (o.enable, o.disable, o.markdown) == (["core/prefer-short-words"], ["core/no-semicolons"], True)
    assert o.severity == {"core/no-hedging": "suggestion", "core/prefer-short-words": "suggestion"} and o.thresholds == {"core/no-hedging": 3.0, "core/no-passive-overuse": 1.5}


def test_three_layers(spark):
    rules = lint.core_rules()
    text = lambda o: config.parsed(F.lit(json.dumps(o)), F.lit("x"), rules)
    docs = spark.createDataFrame([(1, "/a/x.txt"), (2, "/b/x.txt")], "doc_id long, path string")
    configured = config.configurations(files(spark, [("/a/prose.config.json", {"disable": ["no-hedging"], "thresholds": {"no-hedging": 2, "no-passive-overuse": 2}})]), rules)
    df = config.with_options(docs, configured, text({"enable": ["no-hedging"], "thresholds": {"no-hedging": 1}}), text({"thresholds": {"no-passive-overuse": 3}, "markdown": True}))
    got = {r.doc_id: (r.options.enable, r.options.disable, r.options.thresholds, r.markdown) for r in df.collect()}
    assert got[1] == (["core/no-hedging"], ["core/no-hedging"], {"core/no-hedging": 2.0, "core/no-passive-overuse": 3.0}, True)
    assert got[2] == (["core/no-hedging"], None, {"core/no-hedging": 1.0, "core/no-passive-overuse": 3.0}, True)


@pytest.mark.parametrize("content", ["{", '{"enable": 5}', "", "[]", '{"severity": {"no-hedging": "fatal"}}', '{"thresholds": {"no-hedging": "x"}}'])
def test_a_file_that_is_none(spark, content):
    with pytest.raises(Exception, match=r"a/b/prose\.config\.json: invalid configuration"):
        config.configurations(files(spark, [("a/b/prose.config.json", content)]), lint.core_rules()).collect()


def test_as_if_all_had_the_same_options(spark):
    """Findings under a document's own options are those of a run with these options: every engine, thresholds, severities."""
    each = [
        {}, {"disable": ["no-semicolons", "no-hedging"]}, {"enable": ["no-hedging", "sentence-length", "uniform-sentence-rhythm"], "severity": {"no-hedging": "error"}},
        {"thresholds": {"no-hedging": 1, "sentence-length": 5, "uniform-sentence-rhythm": 1000, "triad-overuse": 0.5}}, {"thresholds": {"no-hedging": 400, "triad-overuse": 1e9}, "severity": {"triad-overuse": "suggestion"}}, {"enable": []},
    ]
    rules = lint.core_rules()
    docs = spark.createDataFrame([(i, f"/{i}/d.txt", TEXT) for i in range(len(each))] + [(99, "/none/d.txt", TEXT)], "doc_id long, path string, text string")
    df = config.with_options(docs, config.configurations(files(spark, [(f"/{i}/prose.config.json", c) for i, c in enumerate(each)]), rules)).drop("markdown")
    got = {r.doc_id: r for r in lint.find(df).select("doc_id", "options", "findings").collect()}
    for i in [*range(len(each)), 99]:
        want = lint.find(docs.where(F.col("doc_id") == i), rules, as_options(got[i].options)).first().findings
        key = lambda f: (f.start, f.end, f.rule_id, f.severity, f.weight, f.message, f.replacement)
        assert sorted(map(key, got[i].findings), key=repr) == sorted(map(key, want), key=repr), i
    assert len(got[0].findings) > len(got[1].findings) > 0 == len(got[5].findings)


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a" / ".prose").mkdir(parents=True)
    (tmp_path / "a" / ".prose" / "config.json").write_text('{"disable": ["no-semicolons"]}')
    (tmp_path / "prose.config.json").write_text('{"disable": ["no-hedging"]}')
    (tmp_path / "a" / "other.json").write_text("{")
    found = {r.folder.rsplit("/", 1)[1]: r.options.disable for r in config.read_configurations(spark, str(tmp_path), lint.core_rules()).collect()}
    assert found == {"a": ["core/no-semicolons"], tmp_path.name: ["core/no-hedging"]}
