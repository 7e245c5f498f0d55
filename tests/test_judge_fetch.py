"""Requests to a judge that fails now and then: one more try, failures as rows, each key asked once, answers kept."""

import json
import time
from pathlib import Path

from quillspark.operators import judge
from quillspark.plans.scripted_judge import ScriptedJudge


def requests(spark, keys):
    return spark.createDataFrame([(i, k, f"# Text\n\nsome text {k}\n\n# Rules", ["core/a", "core/b"], "clash") for i, k in enumerate(keys)], "doc_id long, cache_key string, prompt string, rules array<string>, status string").drop("status").repartition(3)


def logged(folder):
    """A judge that leaves a file for each call."""

    def call(request):
        Path(folder, f"{request.cache_key}-{time.time_ns()}").touch()
        if request.cache_key == "bad":
            raise SystemError("no")
        if request.cache_key == "odd":
            return {"no": "text"}
        return 'Sure: [{"rule": "core/a", "quote": "some text"}] as asked'

    return call


def test_outcomes(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    keys = ["x", "y", "x", "bad", "odd", "z", "x"]
    first = judge.fetched(requests(spark, keys), logged(str(calls)), cache, workers=3)
    assert sorted((r.cache_key, r.status, r.tries, r.error) for r in first.collect()) == sorted(
        [(k, "fresh", 1, None) for k in ("x", "x", "x", "y", "z")] + [("bad", "failed", 2, "SystemError: no"), ("odd", "failed", 2, "the answer holds no list of findings")]
    )
    count = lambda k: len(list(calls.glob(f"{k}-*")))
    assert [count(k) for k in ("x", "y", "z", "bad", "odd")] == [1, 1, 1, 2, 2]
    first.collect()  # outcomes are read from the cache, nothing is asked again
    assert count("x") == 1 and count("bad") == 2
    second = judge.fetched(requests(spark, [*keys, "new"]), logged(str(calls)), cache)
    assert sorted((r.cache_key, r.status) for r in second.collect()) == sorted([(k, "cached") for k in ("x", "x", "x", "y", "z")] + [("bad", "failed"), ("odd", "failed"), ("new", "fresh")])
    assert count("x") == 1 and count("new") == 1 and count("bad") == 4
    parsed = judge.parsed_answers(second.where("answer is not null").select("cache_key", "answer").distinct()).collect()
    assert {(r.cache_key, r.rule, r.quote) for r in parsed} == {(k, "core/a", "some text") for k in ("x", "y", "z", "new")}
    assert judge.fetched(requests(spark, []), logged(str(calls)), cache).collect() == []


def test_one_request():
    request = judge.Request("p\n\nq", ("core/a",), "1abc")
    assert judge.asked(ScriptedJudge(), request)[1:] == (None, 2)
    assert judge.asked(ScriptedJudge(), judge.Request("p\n\nq", ("core/a",), "0abc")) == (None, "TimeoutError: no answer", 2)
    answer, error, tries = judge.asked(ScriptedJudge(), judge.Request("p\n\nq r\n\n", ("core/a",), "2abc"))
    assert json.loads(answer.strip("`json\n"))[0]["quote"] == "q r" and (error, tries) == (None, 2)
    assert judge.asked(lambda r: "[1, 2]", request)[0] is None and judge.asked(lambda r: None, request)[0] is None
