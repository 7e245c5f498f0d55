"""Thresholds, controls, baselines and echoes against plain counting."""

import itertools
import math
import random

from pyspark.sql import functions as F
from quillspark.operators import evaluate, sourcing

KINDS = "label string, penalty double, words int, in_slice boolean, m double, k double"


def samples(n=160):
    draw = random.Random(4)
    rows = []
    for _ in range(n):
        ai = draw.random() < 0.5
        rows.append(("ai" if ai else "human", float(draw.randint(0, 6)), draw.randint(0, 400), draw.choice([True, False, None]), draw.choice([None, round(draw.gauss(5 if ai else 6, 2), 1)]), draw.choice([None, float(draw.randint(0, 3))])))
    return [*rows, rows[0], rows[0]]


def score(penalty, words):
    return max(0, min(100, math.floor(100 * math.exp(-(penalty / max(words, 1) * 1000) / 100) + 0.5)))


def plain(rows, extra):
    """(auc, slice auc) with extra points for each row."""
    scored = [(r[0], r[3], score(r[1] + e, r[2])) for r, e in zip(rows, extra, strict=True)]
    wins = lambda ai, human: [(a < h) + 0.5 * (a == h) for a, h in itertools.product(ai, human)]
    human = [s for label, _, s in scored if label == "human"]
    out = []
    for some in ([s for label, _, s in scored if label == "ai"], [s for label, inside, s in scored if label == "ai" and inside]):
        w = wins(some, human)
        out.append(sum(w) / len(w) if w else 0.0)
    return tuple(out)


def fires(r, column, direction, t):
    v = r[column]
    return v is not None and (v > t if direction == "above" else v < t)


def test_checks(spark):
    rows = samples()
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    checks = [("m", "above", 5.0), ("k", "below", 2.0)]
    got = {r.check: r for r in evaluate.tuning_checks(df, checks).collect()}
    hits = [[fires(r, 4, "above", 5.0) for r in rows], [fires(r, 5, "below", 2.0) for r in rows]]
    want = {"base": [0] * len(rows), "always": [3] * len(rows), "m above 5": [3 * h for h in hits[0]], "k below 2": [3 * h for h in hits[1]], "combined": [3 * (a + b) for a, b in zip(*hits, strict=True)]}
    assert set(got) == set(want)
    for name, extra in want.items():
        auc, inside = plain(rows, extra)
        assert abs(got[name].auc - auc) < 1e-9 and abs(got[name].slice_auc - inside) < 1e-9
        assert got[name].fired_ai == sum(e > 0 and r[0] == "ai" for r, e in zip(rows, extra, strict=True))
        assert abs(got[name].gain - (auc - got["base"].auc)) < 1e-9
    assert got["base"].precision == 0.0
    empty = {r.check: r.auc for r in evaluate.tuning_checks(df.limit(0), checks).collect()}
    assert all(v == 0 for v in empty.values())


def test_grid(spark):
    rows = samples()
    df = spark.createDataFrame(rows, KINDS)
    shares = [i / 10 for i in range(1, 10)]
    values = sorted({r[4] for r in rows if r[4] is not None})
    found = {}
    for p in shares:
        t = values[math.floor((len(values) - 1) * p + 0.5)]
        for d in ("above", "below"):
            extra = [3 * fires(r, 4, d, t) for r in rows]
            auc, inside = plain(rows, extra)
            key = (round(auc, 9), d)
            found[key] = min(found.get(key, (1e9,)), (t, inside, sum(bool(e) and r[0] == "ai" for r, e in zip(rows, extra, strict=True))))
    want = sorted(((-a, d, *x) for (a, d), x in found.items()))[:6]
    got = [(-round(r.auc, 9), r.direction, r.value, r.slice_auc, r.fired_ai) for r in evaluate.threshold_grid(df, "m", shares).collect()]
    assert [(a, d, v, n) for a, d, v, _, n in got] == [(a, d, v, n) for a, d, v, _, n in want]


def test_baseline(spark, tmp_path):
    overall = spark.createDataFrame([(0.9,)], "auc double")
    slices = spark.createDataFrame([("na.ive", 0.8), ("x", 0.7)], "slice string, auc double")
    confusion = spark.createDataFrame([("core/a", 3, 1, 0.75), ("core/never", 0, 0, 0.0)], "rule_id string, tp int, fp int, precision double")
    rows = evaluate.baseline(overall, slices, confusion)
    want = {"overall_auc": 0.9, "slice_auc.na.ive": 0.8, "slice_auc.x": 0.7, "per_rule_precision.core/a": 0.75}
    assert {r.name: r.value for r in rows.collect()} == want
    folder = str(tmp_path / "baseline")
    for _ in range(2):
        evaluate.write_baseline(rows, folder)
    back = evaluate.read_baseline(spark, folder)
    assert {r.name: r.value for r in back.collect()} == want
    worse = rows.withColumn("value", F.col("value") - F.when(F.col("name") == "slice_auc.x", 0.04).otherwise(0.02))
    assert [r.name for r in evaluate.regressions(worse, back).collect()] == ["slice_auc.x"]
    own = tmp_path / "own.json"
    own.write_text('{\n  "overall_auc": 0.5,\n  "slice_auc": {"n": 0.4}\n}\n')
    assert {r.name: r.value for r in evaluate.read_baseline(spark, str(own)).collect()} == {"overall_auc": 0.5, "slice_auc.n": 0.4}


def plain_tokens(text):
    out = []
    for w in (text or "").split():
        while w and not (w[0].isalnum() or w[0] == "'"):
            w = w[1:]
        while w and not (w[-1].isalnum() or w[-1] == "'"):
            w = w[:-1]
        out += [w.lower()] if w else []
    return out


def test_echoes(spark):
    draw = random.Random(1)
    words = ["the", "don't", "court", "held", "U.S.", "(as", "said)", "no", "Grün", "7"]
    say = lambda k: " ".join(draw.choices(words, k=k))
    items = [(i, say(draw.randint(3, 40)) + draw.choice(["", ".", "! more"])) for i in range(12)] + [(90, None), (91, "one. two"), (92, "a b c d e f g U.S. code rest of it")]
    docs = [(i, say(draw.randint(0, 9)) + " " + " ".join((t or "").split()[a : a + draw.choice([4, 5, 6, 8, 9, 30])])) for i, ((_, t), a) in enumerate((draw.choice(items), draw.randint(0, 6)) for _ in range(150))]
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "A b, c d e f g u"), docs[0]]
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    want = set()
    for i, source in items:
        ws = plain_tokens(source)
        cut = min([(source or "").find(c) for c in ".!?" if c in (source or "")], default=len(source or ""))
        long = runs(ws, 8) | runs(plain_tokens((source or "")[:cut]), 8)
        for d, text in docs:
            mine = plain_tokens(text)
            a, b = len(long & runs(mine, 8)), len(runs(ws, 5) & runs(mine, 5))
            if a or b and len(mine) < len(ws) // 2:
                want.add((i, d, a, b))
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = [tuple(r) for r in sourcing.echoes(df(docs, "doc_id").repartition(3), df(items, "item_id")).collect()]
    assert sorted(got) == sorted(want) and (92, 903, 1, 3) in want and len(want) > 20
    texts = spark.createDataFrame([("One. Two three! ",), ("no end",), ("?x",)], "t string").select(sourcing.without_opening(F.col("t")).alias("t"), sourcing.opening(F.col("t")).alias("o"))
    assert [tuple(r) for r in texts.collect()] == [("Two three!", "One"), ("", "no end"), ("x", "")]


def test_report(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["train", "test"]), draw.choice(["ai", "human"]), draw.randint(0, 100), draw.choice(["a", "b", None]), draw.sample(["r1", "r2", "r3"], draw.randint(0, 3))) for _ in range(120)] + [("odd", "human", 50, None, ["r1", "r1"])]
    df = spark.createDataFrame(rows, "split string, label string, score int, slice string, fired array<string>").repartition(3)
    got = {(r.split, r.part, r.name): r.value for r in evaluate.report(df, ["r1", "r2", "never"], ["a", "b", "none"]).collect()}
    for split in ("train", "test", "odd"):
        mine = [r for r in rows if r[0] == split]
        human = [r[2] for r in mine if r[1] == "human"]
        for name in ("overall", "a", "b", "none"):
            ai = [r[2] for r in mine if r[1] == "ai" and name in ("overall", r[3])]
            wins = [(x < h) + 0.5 * (x == h) for x in ai for h in human]
            assert abs(got[split, "auc", name] - (sum(wins) / len(wins) if wins else 0)) < 1e-9
            mean = sum(ai) / len(ai) if ai else 0
            assert abs(got[split, "mean_score", "ai" if name == "overall" else f"ai.{name}"] - mean) < 1e-9
        assert abs(got[split, "mean_score", "human"] - sum(human) / len(human)) < 1e-9
        for rule in ("r1", "r2", "never"):
            cells = [sum((r[1] == label) and (rule in r[4]) == hit for r in mine) for label, hit in (("ai", True), ("human", True), ("ai", False), ("human", False))]
            assert [got[split, c, rule] for c in ("tp", "fp", "fn", "tn")] == cells
            assert got[split, "precision", rule] == (cells[0] / (cells[0] + cells[1]) if cells[0] + cells[1] else 0)
    assert evaluate.report(df.limit(0), ["r1"], ["a"]).collect() == []
