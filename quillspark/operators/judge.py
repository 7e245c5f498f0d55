"""Rules that a language model judges, as tables: requests out, findings in.

Requests are rows with a cache key; answers come back as rows with that key, from a
cache or from a function that tasks call, are parsed, checked against the text and gated.
No model is part of this package.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import PROSE
from ..functions.text import let, match_spans, over
from ..rules.model import Rule
from .lint import score_of

CONTEXT_CHARS, VERSION, FLOOR = 1200, "3", 0.6
FUZZY_CHARS, FUZZY_LEAST = 400, 0.9
ANSWER = "array<struct<rule:string,quote:string,explanation:string,confidence:double,suggested_rewrite:string>>"
# Phrases of a verdict that takes its finding back.
NEGATIONS = (
    "does not violate", "do not violate", "doesn't violate", "not a violation", "not violated", "no violation", "does not flag", "do not flag", "doesn't flag",
    "nothing to flag", "no issues found", "no problems found", "complies with the rule",
)
# Words, between blanks, of an explanation that still reads as a pass.
BROAD = (
    "does not flag", "do not flag", "doesn t flag", "nothing to flag", "does not violate", "do not violate", "doesn t violate", "not violate", "not violated", "no violation", "no violations",
    "not a violation", "complies", "compliant", "satisfies", "adheres", "conforms", "no issue", "no issues", "no problem", "no problems", "is acceptable", "is fine",
)


def chunks(parsed: DataFrame, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Adds `chunks`: neighbouring blocks together up to `context_chars` characters of their own; a block is never cut.
    Headings, quotes, code, and whatever stands between blocks but white space, end a chunk. `parsed` has `blocks` and `__t`."""
    kind = "struct<done:array<struct<start:int,end:int,size:int>>,open:struct<start:int,end:int,size:int>>"
    none = F.lit(None).cast("struct<start:int,end:int,size:int>")

    def closed(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    def step(acc: Column, b: Column) -> Column:
        size = b["end"] - b["start"]
        last = acc["open"]
        gap = F.substr(F.col("__t"), last["end"] + 1, b["start"] - last["end"])
        joins = F.coalesce((last["size"] + size <= context_chars) & ~gap.rlike(r"(?U)\S"), F.lit(False))
        wider = F.struct(last["start"].alias("start"), b["end"].alias("end"), (last["size"] + size).alias("size"))
        alone = F.struct(b["start"].alias("start"), b["end"].alias("end"), size.alias("size"))
        on = F.struct(F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"), F.when(joins, wider).otherwise(alone).alias("open")).cast(kind)
        return F.when(b["kind"].isin(*PROSE), on).otherwise(F.struct(closed(acc).alias("done"), none.alias("open")).cast(kind))

    zero = F.struct(F.array().alias("done"), none.alias("open")).cast(kind)
    return parsed.withColumn("chunks", F.aggregate("blocks", zero, step, closed))


def requests(parsed: DataFrame, rules: Sequence[Rule], context_chars: int = CONTEXT_CHARS, per_rule: bool | None = None, model: str = "none") -> DataFrame:
    """One row per chunk (and rule, where chunks are large), with its rules, prompt and cache key.
    Rules of document granularity take the whole text."""
    spark = parsed.sparkSession
    single = context_chars > CONTEXT_CHARS if per_rule is None else per_rule
    small = [r for r in rules if r.engine == "inferential" and r.granularity != "document"]
    whole = [r for r in rules if r.engine == "inferential" and r.granularity == "document"]
    groups = [(unit, g) for unit, some in (("chunk", small), ("document", whole)) if some for g in ([[r] for r in some] if single else [some])]
    table = spark.createDataFrame([(unit, i, [r.id for r in g], "\n\n".join(f"## {r.id}\n{r.rubric or r.says()}" for r in g)) for i, (unit, g) in enumerate(groups)], "unit string, group_ix int, rules array<string>, rubric string")
    one = F.struct(F.lit(0).alias("start"), F.length("__t").alias("end"))
    units = F.concat(
        F.transform("chunks", lambda c, i: F.struct(F.lit("chunk").alias("unit"), i.alias("unit_ix"), c["start"].alias("start"), c["end"].alias("end"))),
        F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("unit_ix"), one["start"].alias("start"), one["end"].alias("end"))),
    )
    df = chunks(parsed, context_chars).select("doc_id", "__t", F.explode(units).alias("u")).select("doc_id", F.expr("substring(__t, u.start + 1, u.end - u.start)").alias("chunk_text"), "u.*")
    df = df.where("chunk_text <> ''").join(F.broadcast(table), "unit")  # a row for each rule at most
    key = F.sha2(F.concat(F.col("chunk_text"), F.sha2(F.col("rubric").cast("binary"), 256), F.lit(VERSION)).cast("binary"), 256)
    prompt = F.concat_ws("\n\n", F.lit("# Text"), F.col("chunk_text"), F.lit("# Rules"), F.col("rubric"))
    return df.select("doc_id", "unit", "unit_ix", "group_ix", "start", "end", "chunk_text", "rules", prompt.alias("prompt"), F.concat(key, F.lit(":"), F.lit(model)).alias("cache_key"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The requests without an answer in `cache` (cache_key), each key once."""
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


OUTCOME = "cache_key string, answer string, error string, tries int, run string"


@dataclass(frozen=True)
class Request:
    """What a judge is asked: a prompt, the rules that it may name, and the key of the answer."""

    prompt: str
    rules: tuple[str, ...]
    cache_key: str


def _is_answer(answer: object) -> bool:
    """Whether an answer holds a list of objects, once what surrounds its outermost brackets is gone."""
    found = re.search(r"\[.*\]", answer, re.S) if isinstance(answer, str) else None
    try:
        return found is not None and all(isinstance(x, dict) for x in json.loads(found[0]))
    except ValueError:
        return False


def asked(judge: Callable[[Request], str], request: Request, tries: int = 2) -> tuple[str | None, str | None, int]:
    """(answer, error, tries) of a judge; a second try for one that raises or gives no list, and then an error. Nothing that a judge does ends the job."""
    error = ""
    for n in range(1, tries + 1):
        try:
            answer = judge(request)
            if _is_answer(answer):
                return answer, None, n
            error = "the answer holds no list of findings"
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException as e:
            error = f"{type(e).__name__}: {e}"
    return None, error, tries


def answers_of(wanted: DataFrame, judge: Callable[[Request], str], run: str = "", workers: int = 1) -> DataFrame:
    """(cache_key, answer, error, tries, run) of each distinct key of `wanted` (cache_key, prompt, rules), from a function that
    tasks call, `workers` requests of a task at a time. The function is pickled; a task that runs again asks again."""

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                requests = [Request(p, tuple(r), k) for k, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                found = list(pool.map(partial(asked, judge), requests))
                columns = [[r.cache_key for r in requests], *([f[i] for f in found] for i in range(3)), [run] * len(found)]
                types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in OUTCOME.split(", ")])

    return wanted.select("cache_key", "prompt", "rules").dropDuplicates(["cache_key"]).mapInArrow(called, OUTCOME)


def fetched(wanted: DataFrame, judge: Callable[[Request], str], cache: str, workers: int = 1) -> DataFrame:
    """`wanted` with what became of each request: `status` (cached, fresh or failed), `error`, `tries`, `answer`.

    Only keys that the cache (a folder that driver and executors share) has no answer for are asked, each once; outcomes
    are appended to the cache before anything reads them, so a judge is not asked again for the sake of a later step.
    A failed request has no answer and no findings, and is asked again by the next run."""
    spark, run = wanted.sparkSession, uuid.uuid4().hex
    spark.createDataFrame([], OUTCOME).coalesce(1).write.mode("append").parquet(cache)  # so that a first run finds a table
    answers_of(cache_misses(wanted, read_answers(spark, cache)), judge, run, workers).write.mode("append").parquet(cache)
    own = _outcomes(spark, cache).where(F.col("run") == run)
    fresh = own.select("cache_key", F.when(F.col("answer").isNull(), "failed").otherwise("fresh").alias("status"), "error", "tries", "answer")
    known = read_answers(spark, cache, without=run).select("cache_key", F.lit("cached").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries"), "answer")
    return wanted.join(fresh.unionByName(known), "cache_key", "left")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(folder)


def write_answers(answers: DataFrame, folder: str) -> None:
    """Adds answers (cache_key, answer) to the cache: a table that readers join on the key."""
    none = F.lit(None).cast("string")
    answers.select("cache_key", "answer", none.alias("error"), F.lit(0).alias("tries"), none.alias("run")).write.mode("append").parquet(folder)


def read_answers(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    """The cached answers, of several for a key the least; those of the run `without` do not count."""
    found = _outcomes(spark, folder).where("answer is not null")
    if without is not None:
        found = found.where(~F.col("run").eqNullSafe(without))
    return found.groupBy("cache_key").agg(F.min("answer").alias("answer"))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(cache_key, ord, rule, quote, explanation, confidence, suggested_rewrite) from answers (cache_key, answer).
    A fence around the list goes, or else what surrounds the outermost brackets; rule and quote are required."""
    inner = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    found = answers.select("cache_key", F.posexplode_outer(F.from_json(inner, ANSWER)).alias("ord", "f"))
    found = found.where("f.rule is not null and f.quote is not null and f.quote <> ''")
    confidence = F.coalesce(F.col("f.confidence"), F.lit(0.5))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(confidence, F.lit(0.0))))
    return found.select("cache_key", "ord", "f.rule", "f.quote", F.coalesce("f.explanation", F.lit("")).alias("explanation"), clamped.alias("confidence"), "f.suggested_rewrite")


def _rule_words(rule: Column) -> Column:
    """A rule's name in words: its id without the package."""
    return F.lower(F.replace(F.substring_index(rule, "/", -1), F.lit("-"), F.lit(" ")))


def _any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, phrase if isinstance(phrase, Column) else F.lit(phrase))
    return out


def denied(explanation: Column, rule: Column) -> Column:
    """Whether an explanation takes its finding back, in general or by its rule's name ("no empty hedge")."""
    low, name = F.lower(explanation), _rule_words(rule)
    named = (F.trim(name) != "") & _any(low, (F.concat(F.lit(x), name) for x in ("no ", "not a ", "not an ")))
    return _any(low, NEGATIONS) | named


def negational(explanation: Column, rule: Column) -> Column:
    """Whether an explanation reads as a pass at all: wider than `denied`, to count what that misses."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(explanation), r"[^\p{IsAlphabetic}\p{N}]+", " ")), F.lit(" "))
    name = _rule_words(rule)
    out = _any(words, (f" {p} " for p in BROAD))
    for thing in (name, F.substring_index(name, " ", -1)):
        named = _any(words, (F.concat(F.lit(f" {x} "), thing, F.lit(" ")) for x in ("no", "not a", "not an", "not", "does not", "doesn t")))
        out = out | ((F.trim(thing) != "") & named)
    return out


def _place(text: Column, quote: Column) -> Column:
    """The offset of a quote: its first exact place, else of the stretches of its length the most similar one.

    Of k + 1 parts of the quote, k edits leave one as it is, at most k characters off its place: only
    stretches around such parts are compared."""
    exact = F.position(quote, text) - 1
    n, k = F.length(quote), F.floor(F.length(quote) * (1 - FUZZY_LEAST) + 1e-9).cast("int")
    size = F.greatest(F.lit(1), F.floor(n / (k + 1))).cast("int")

    def around(i: Column) -> Column:
        part = F.substr(quote, i * size + 1, size)
        literal = F.regexp_replace(part, r"([^\p{L}\p{N}\s])", r"\\$1")
        near = lambda last: lambda s: F.sequence(F.greatest(F.lit(0), s["start"] - i * size - k - size), F.greatest(F.lit(0), F.least(last, s["start"] - i * size + k + size)))
        return F.when(F.contains(text, part), let(F.length(text) - n, lambda last: over(match_spans(text, literal), near(last)))).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(over(F.sequence(F.lit(0), k), around))
    # more than k edits are too many, and not counted to the end: -1
    windows = F.transform(starts, lambda i: F.struct(F.call_function("levenshtein", F.substr(text, i + 1, n), quote, k).alias("far"), i.alias("at")))
    best = F.array_min(F.filter(windows, lambda w: w["far"] >= 0))["at"]
    return F.when(exact >= 0, exact).when((n <= FUZZY_CHARS) & (n <= F.length(text)), best)


def grounded(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Findings of `parsed_answers` on their requests, with status: `grounded` (and a span), `foreign` or `not found`."""
    df = findings.join(wanted.select("doc_id", "cache_key", "chunk_text", "rules", F.col("start").alias("base")), "cache_key")
    foreign = ~F.array_contains("rules", F.col("rule"))
    df = df.withColumn("at", F.when(~foreign, _place(F.col("chunk_text"), F.col("quote"))))
    status = F.when(foreign, "foreign").when(F.col("at").isNull(), "not found").when(denied(F.col("explanation"), F.col("rule")), "denied").otherwise("grounded")
    start = F.col("base") + F.col("at")
    return df.select("doc_id", "cache_key", "ord", "rule", "quote", "explanation", "confidence", "suggested_rewrite", status.alias("status"), start.alias("start"), (start + F.length("quote")).alias("end"))


def gated(findings: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Findings of at least the least confidence (none counts as 0); an error becomes a warning."""
    kept = findings.where(F.coalesce("confidence", F.lit(0.0)) >= floor)
    return kept.withColumn("severity", F.when(F.col("severity") == "error", "warning").otherwise(F.col("severity")))


def judge_stats(checked: DataFrame, wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Per document: chunks, cache hits, failed chunks, grounded and discarded findings, those discarded by rule, the first failed chunk."""
    hits = wanted.join(cache.select("cache_key", F.lit(1).alias("hit")).dropDuplicates(["cache_key"]), "cache_key", "left")
    failed = F.when(F.col("hit").isNull(), F.struct("start", "unit_ix", "cache_key"))
    by_doc = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("hit").alias("cache_hits"), F.min(failed)["cache_key"].alias("first_failure"))
    by_rule = checked.groupBy("doc_id", "rule").agg(F.count_if(F.col("status") == "grounded").alias("good"), F.count_if(F.col("status") != "grounded").alias("bad"))
    found = by_rule.groupBy("doc_id").agg(F.sum("good").alias("grounded"), F.sum("bad").alias("discarded"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("bad") > 0, F.struct("rule", "bad"))))).alias("hallucinated"))
    return by_doc.join(found, "doc_id", "left").fillna(0, ["grounded", "discarded"]).withColumn("chunks_failed", F.col("chunks") - F.col("cache_hits"))


def judged_scores(scores: DataFrame, judged: DataFrame, rules: Sequence[Rule], floor: float = FLOOR) -> DataFrame:
    """Scores of `lint_scores` (doc_id, word_count, sentence_count, penalty) with what a judge found.

    judged: doc_id, rule, status and confidence, as `grounded` returns them. Findings that stand in the
    text and pass the gate count with their confidence; penalties are summed before they meet the scores."""
    spark = scores.sparkSession
    known = spark.createDataFrame([(r.id, r.severity, r.intent) for r in rules], "rule string, severity string, intent string")
    kept = gated(judged.where("status = 'grounded'").join(F.broadcast(known), "rule"), floor)  # a row per rule
    points = F.when(F.col("severity") == "warning", 3).otherwise(1)
    added = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_judged"), F.sum(F.when(F.col("intent") == "detection", points * F.col("confidence")).otherwise(0.0)).alias("added"))
    df = scores.join(added, "doc_id", "left").fillna(0, ["n_judged", "added"]).withColumn("penalty", F.col("penalty") + F.col("added"))
    return df.select("doc_id", "word_count", "n_judged", "penalty", score_of(F.col("penalty"), F.col("word_count")).alias("score"))
