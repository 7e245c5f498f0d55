"""The registered queries of the analysis engine, each over its whole table, and their SQL."""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentences
from ..functions.text import java, once
from ..operators import config, diffs, evaluate, judge, lint, mining, render, review, sourcing
from ..rules.model import Options, Rule, RuleSet
from ..sources.scratch import cut, shared_folder
from .diff_sql import line_diff_sql
from .finding_sql import finding_sql, findings, judged_sql
from .lint_corpus import lint_corpus, lint_sql, quoted
from .example_sql import example_sql
from .passage_sql import passage_sql
from .place_corpus import USER, place_corpus, place_sql
from .scripted_judge import ScriptedJudge, scratch_folder
from .sentence_sql import SENTENCE_SQL
from .tuning_sql import checks_sql, grid_sql
from .view_sql import TOKENS, brief_sql, listing_sql, window_sql
from .word_corpus import edit_sql, review_sql, word_corpus

CORE = lint.core_rules()
INFERENTIAL = [r for r in CORE.rules if r.engine == "inferential"]
DENSITY = [r for r in CORE.rules if r.engine == "density"]
#: Rules whose matches SQL can count: phrases without context, and rates.
COUNTED = [r for r in CORE.rules if r.engine in ("phrase", "density") and not r.allow_context and r.name != "no-not-only"]
SIMPLE = Options(enable=tuple(r.id for r in COUNTED), directive="nothing")
SOME = Options(disable=("no-semicolons", "core/prefer-short-words"), severity={"no-en-dash": "suggestion"}, thresholds={"no-hedging": 1.0})
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def _re2(pattern: str) -> str:
    """A pattern for the other dialect, where words are those of all of Unicode only if spelled out."""
    pattern = pattern.replace(r"(?:ed|en)\b", rf"(?:ed|en)(?:[^{W[1:-1]}]|$)")
    pattern = pattern.replace(r"(?i)\b(?:is|", rf"(?i)(?:^|[^{W[1:-1]}])(?:is|")
    return pattern.replace(r"\b\w+(?:\s+\w+){0,3}", r"\w+(?:\s+\w+){0,3}").replace(r"\w", W)


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lint.parse(lint_corpus(spark, sf), sentences_too=False).select("doc_id", F.col("words").cast("long").alias("word_count"), F.size("blocks").cast("long").alias("n_blocks"))


def phrase_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of each phrase rule over the corpus."""
    df = lint.hit_counts(lint_corpus(spark, sf), [r for r in COUNTED if r.engine == "phrase"]).select("doc_id", F.inline("counts"))
    by_rule = df.groupBy("doc_id", "rule_id").agg(F.sum("n").alias("n")).groupBy("rule_id").agg(F.sum("n").alias("n_hits"), F.count_if(F.col("n") > 0).alias("n_docs"))
    every = spark.createDataFrame([(r.id,) for r in COUNTED if r.engine == "phrase"], "rule_id string")
    return every.join(by_rule, "rule_id", "left").fillna(0)


def density_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Each rate rule on each document that has a match: count, rate, whether it fires and with what weight."""
    df = lint.parse(lint_corpus(spark, sf), sentences_too=False)
    each = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(float(r.threshold)).alias("thr"), lint.density_count(r.pairs()[0][0]).cast("long").alias("n")) for r in DENSITY))
    df = df.select("doc_id", F.greatest(F.col("words"), F.lit(1)).alias("w"), F.inline(each)).where("n > 0")
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") - F.col("thr") * F.col("w") / 1000)).cast("long")
    return df.select("doc_id", "rule_id", "n", F.round(F.col("n") / F.col("w") * 1000, 6).alias("rate"), (F.col("n") / F.col("w") * 1000 > F.col("thr")).alias("fires"), weight.alias("weight"))


def simple_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under the rules whose matches SQL can count."""
    df = lint.lint_scores(lint_corpus(spark, sf), options=SIMPLE, keep=("doc_id", "lang", "source"))
    return df.select("doc_id", "lang", "source", F.col("word_count").cast("long").alias("word_count"), F.col("penalty").cast("long").alias("penalty"), F.col("score").cast("long").alias("score"), F.array_join(F.array_sort("fired_rules"), ",").alias("fired"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under all rules, with directives."""
    df = lint.lint_scores(lint_corpus(spark, sf), keep=("doc_id", "lang", "source"))
    return df.withColumn("fired_rules", F.array_join(F.array_sort("fired_rules"), ","))


def all_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return lint.diagnostics(lint_corpus(spark, sf))


def fixed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lint.fixed(lint_corpus(spark, sf))


def line_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """What the fixes change, line by line, with a line of context on either side."""
    fixed = lint.fixed(lint_corpus(spark, sf), keep=("__t",))
    return diffs.line_diffs(fixed.select("doc_id", F.col("__t").alias("before"), F.col("fixed_text").alias("after"))).fillna(0, ["old_line", "new_line"])


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return review.edits(lint.find(review.projected(word_corpus(spark, sf))))


def word_edits(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of Word documents as tracked changes and comments, and the runs in which they begin and end."""
    df = _edits(spark, sf).select("doc_id", F.inline("edits"))
    return df.select("doc_id", "id", "kind", "start", "end", F.col("first.run").alias("first_run"), F.col("last.run").alias("last_run"), "replacement")


def word_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed Word documents: what was marked, and the texts with all changes accepted and with all rejected."""
    how = review.Review()
    df = review.reviewed(_edits(spark, sf), how).select("doc_id", "applied", "annotated", "skipped", "reviewed_xml")
    df = once(df, yes=review.accepted(F.col("reviewed_xml"), how.author), no=review.rejected(F.col("reviewed_xml"), how.author))
    digest = lambda xml: F.md5(review.said(F.col(xml)).cast("binary"))
    df = once(df, accepted_md5=digest("yes"))
    # most parts have comments only: both are the same then
    return df.select("doc_id", "applied", "annotated", "skipped", "accepted_md5", F.when(F.col("yes") == F.col("no"), F.col("accepted_md5")).otherwise(digest("no")).alias("rejected_md5"))


def configured_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under the options that hold where each document lies."""
    docs, files = place_corpus(spark, sf)
    configured = config.configurations(files, CORE)
    user = config.parsed(F.lit(json.dumps(USER)), F.lit("user"), CORE)
    level = F.when(F.col("path").rlike("^/corpus/[^/]+/[^/]*[02468]/"), 3).when(F.col("lang") != "de", 2).otherwise(1)
    df = config.with_options(docs, configured, user).withColumn("level", level).drop("markdown")
    df = lint.lint_scores(df, options=SIMPLE, keep=("doc_id", "level"))
    return df.select("doc_id", "level", "penalty", "score", F.array_join(F.array_sort("fired_rules"), ",").alias("fired_rules"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words, numbers and marks of each sentence, with their places in the document."""
    df = lint.parse(lint_corpus(spark, sf)).select("doc_id", F.posexplode("sents").alias("sentence", "s"))
    df = df.select("doc_id", "sentence", F.col("s.start").alias("at"), F.posexplode(sentences.tokens(F.col("s.text"))).alias("ord", "t"))
    return df.select("doc_id", "sentence", "ord", "t.kind", (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end"), "t.text")


def finding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return render.windows(lint.find(lint_corpus(spark, sf)))


def finding_listings(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader gets to see of each document: a summary and its findings."""
    found = lint.find(lint_corpus(spark, sf))
    return render.listings(found, keep=(render.summary(CORE).alias("summary"),))


def _by_option(options: Options, spark: SparkSession, sf: str) -> DataFrame:
    df = lint.lint_scores(lint_corpus(spark, sf), options=options)
    return df.withColumn("fired_rules", F.array_join(F.array_sort("fired_rules"), ","))


def sentence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences and document metrics."""
    df = lint.parse(lint_corpus(spark, sf))
    names = {"variance": "sentence-length-variance", "autocorrelation": "cadence-autocorrelation", "opener_density": "repeated-opener-density", "triads": "triad-density", "pairs": "paired-adjective-rate"}
    return df.select("doc_id", F.size("sents").alias("n_sentences"), F.size(F.filter("sents", lambda s: s["is_citation"])).alias("n_citations"), *(F.round(lint.document_metric(m), 6).alias(n) for n, m in names.items()))


def _one_rule(name: str, spark: SparkSession, sf: str) -> DataFrame:
    df = lint.diagnostics(lint_corpus(spark, sf), options=Options(enable=(name,)))
    return df.select("doc_id", "ord", "start", "end", "line", "column", "message", "excerpt")


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_histogram(simple_scores(spark, sf))


def score_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return simple_scores(spark, sf).groupBy("source", "lang").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Scored documents with a label: quality stands for authorship, so only the arithmetic means anything."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"))
    return cut(simple_scores(spark, sf).join(labels, "doc_id"))  # measures read it several times


def splits(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return df.select("conv_id", "turns", evaluate.split_of(F.col("conv_id").cast("string")).alias("split"))


def rule_confusion(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf).withColumn("fired", F.filter(F.split("fired", ","), lambda x: x != ""))
    df = evaluate.rule_confusion(samples, [r.id for r in COUNTED])
    return df.select("rule_id", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def auc_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf).withColumn("value", 100 - F.col("score"))
    one = evaluate.auc(samples).select(F.lit("all").alias("slice"), "auc", "n_pos", "n_neg")
    return one.unionByName(evaluate.auc(samples, by=("lang",)).withColumnRenamed("lang", "slice")).withColumn("auc", F.round("auc", 6))


def regressions(spark: SparkSession, sf: str) -> DataFrame:
    """Languages whose AUC lies more than the tolerance below that of all."""
    df = auc_by_lang(spark, sf)
    every = df.where("slice = 'all'").select(F.col("auc").alias("value"))
    baseline = df.where("slice <> 'all'").select(F.col("slice").alias("name")).crossJoin(every)  # one row
    found = evaluate.regressions(df.select(F.col("slice").alias("name"), F.col("auc").alias("value")), baseline)
    return found


def dimension_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.dimension_counts(spark.read.parquet(f"{sf}/documents.parquet"), ("lang", "source"))


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The best thresholds of sentence length variance on labelled documents."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"))
    docs = lint_corpus(spark, sf).join(labels, "doc_id")
    df = lint.find(docs, options=SIMPLE)
    df = df.select("label", lint.penalty().alias("penalty"), "words", (F.col("lang") == "en").alias("in_slice"), F.round(lint.document_metric("sentence-length-variance"), 6).alias("metric"))
    return _rounded(evaluate.threshold_grid(df, "metric", [i / 100 for i in range(1, 100)]), "auc", "slice_auc")


CHECKS = [("variance", "below", 60.0), ("triads", "above", 2.0), ("variance", "above", 20.0)]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def tuning_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What thresholds of two metrics gain on labelled documents, one by one and together, beside a flag that always fires."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"))
    df = lint.find(lint_corpus(spark, sf).join(labels, "doc_id"), options=SIMPLE)
    metrics = {"variance": "sentence-length-variance", "triads": "triad-density"}
    df = df.select("label", lint.penalty().alias("penalty"), "words", (F.col("lang") == "en").alias("in_slice"), *(F.round(lint.document_metric(m), 6).alias(c) for c, m in metrics.items()))
    return _rounded(evaluate.tuning_checks(df, CHECKS), "auc", "slice_auc", "gain", "precision")


def gate_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """All that a regression gate compares, written and read back."""
    samples = _samples(spark, sf).withColumn("value", 100 - F.col("score")).withColumn("fired", F.filter(F.split("fired", ","), lambda x: x != ""))
    slices = evaluate.auc(samples, by=("lang",)).withColumnRenamed("lang", "slice")
    rows = evaluate.baseline(evaluate.auc(samples), slices, evaluate.rule_confusion(samples, [r.id for r in COUNTED]))
    folder = f"{shared_folder(spark)}/baselines/{uuid.uuid4().hex}"
    evaluate.write_baseline(rows, folder)
    return _rounded(evaluate.read_baseline(spark, folder), "value")


LANGUAGES = ["de", "en", "es", "xx"]


def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """All measures of labelled documents, by split and by language as slices."""
    samples = _samples(spark, sf).withColumn("fired", F.filter(F.split("fired", ","), lambda x: x != ""))
    samples = samples.withColumn("split", evaluate.split_of(F.col("doc_id").cast("string"))).withColumn("slice", F.col("lang"))
    return _rounded(evaluate.report(samples, [r.id for r in COUNTED], LANGUAGES), "value")


def seed_echoes(spark: SparkSession, sf: str) -> DataFrame:
    return sourcing.echoes(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def judged_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of countable rules and of the scripted judge as one list for each document."""
    found = lint.merged(lint.find(lint_corpus(spark, sf), options=SIMPLE, late=True), _judged(spark, sf), CORE)
    return lint.diagnostics(None, found=found).where("tier = 'inferential'").select("doc_id", "ord", "rule_id", "severity", "start", "end", "line", "column", "message", "confidence")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return judge.requests(lint.parse(lint_corpus(spark, sf), sentences_too=False), INFERENTIAL)


def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("doc_id", "unit", "unit_ix", "start", "end", "cache_key", F.array_join("rules", ",").alias("rules"))


def judge_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each request to a scripted judge: when first asked, and by a second run over the same cache."""
    asked, cache = _asked(spark, sf), scratch_folder(spark)
    runs = [judge.fetched(asked, ScriptedJudge(), cache, workers=4).select("doc_id", "unit", "unit_ix", F.lit(n).alias("run"), "status", F.col("tries"), F.col("error").isNotNull().alias("has_error")) for n in (1, 2)]
    return runs[0].unionByName(runs[1])


def judge_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("doc_id", "cache_key", "ord", "rule", "status", "start", "end", "confidence").fillna(-1, ["start", "end"])


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """A scripted judge: quotes of chunks, exact, altered and foreign, through parsing, grounding and the gate."""
    asked = _asked(spark, sf)
    quote = F.regexp_extract("chunk_text", r"(?U)^\S+(?:\s+\S+){0,5}", 0)
    altered = F.concat(F.substring(quote, 1, 1), F.lit("#"), F.expr("substring(regexp_extract(chunk_text, '(?U)^\\\\S+(?:\\\\s+\\\\S+){0,5}', 0), 3)"))

    def one(q, rule: str, explanation: str, confidence: float):
        return F.struct(F.lit(rule).alias("rule"), q.alias("quote"), F.lit(explanation).alias("explanation"), F.lit(confidence).alias("confidence"))

    rows = F.array(one(quote, INFERENTIAL[0].id, "vague", 0.9), one(altered, INFERENTIAL[-1].id, "padded", 0.7), one(quote, "other/rule", "", 0.9), one(F.lit("not in the text at all"), INFERENTIAL[0].id, "", 1.5), one(quote, INFERENTIAL[0].id, "This does not violate it.", 0.8))
    answers = asked.dropDuplicates(["cache_key"]).select("cache_key", F.concat(F.lit("```json\n"), F.to_json(rows), F.lit("\n```")).alias("answer"))
    return judge.grounded(judge.parsed_answers(answers), asked)


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return mining.corpus_stats(lint_corpus(spark, sf)).withColumn("mean_sentence", F.round("mean_sentence", 6))


def absences(spark: SparkSession, sf: str) -> DataFrame:
    return mining.absences(corpus_stats(spark, sf))


def top_openers(spark: SparkSession, sf: str) -> DataFrame:
    return mining.top_openers(lint_corpus(spark, sf))


def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    df = mining.paragraph_chunks(lint_corpus(spark, sf))
    return df.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.octet_length("chunk").cast("long").alias("n_bytes"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def recent_passages(spark: SparkSession, sf: str) -> DataFrame:
    return mining.recency_sample(lint_corpus(spark, sf).withColumn("age", F.col("doc_id")), "age").select("doc_id", "passage", F.col("running").cast("long").alias("running"))


def self_firing(spark: SparkSession, sf: str) -> DataFrame:
    return mining.self_firing(lint_corpus(spark, sf), RuleSet(tuple(r for r in CORE.rules if r.engine in ("phrase", "leading"))))


def self_firing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return mining.self_firing_chunks(lint_corpus(spark, sf), CORE, SIMPLE)


def stratified_passages(spark: SparkSession, sf: str) -> DataFrame:
    """A report: passages spread over the newest documents, within a budget of bytes."""
    df = mining.spread_sample(lint_corpus(spark, sf).withColumn("age", F.col("doc_id")), "age")
    return df.select("doc_id", F.col("slot").cast("int").alias("slot"), "passage", F.col("running").cast("long").alias("running"))


def mined_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples for rules that speak for what the corpus writes, where it does."""
    return mining.synthesized(lint_corpus(spark, sf), mining.family_seeks())


def mined_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Examples for all rules that a corpus' absences suggest, from the corpus where it has one."""
    return mining.synthesized(lint_corpus(spark, sf), mining.family_seeks() + mining.mark_seeks(), mining.canonical_pairs())


def judged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under the countable rules with the findings of the scripted judge."""
    scores = lint.lint_scores(lint_corpus(spark, sf), options=SIMPLE)
    return judge.judged_scores(scores, judge_findings(spark, sf), INFERENTIAL).withColumn("penalty", F.round("penalty", 6))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", sourcing.clean_lines(sourcing.html_text(F.col("html"))).alias("text"))


def page_passages(spark: SparkSession, sf: str) -> DataFrame:
    return page_texts(spark, sf).select("page_id", F.posexplode(sourcing.passages(F.col("text"), 20, 100)).alias("ix", "passage"))


def benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return sourcing.verbatim_overlap(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    df = render.coverage(lint.find(lint_corpus(spark, sf)).select(F.explode("findings").alias("f")).select("f.rule_id"), render.rules_table(spark, CORE))
    return df.withColumn("skipped", F.array_join("skipped", ","))


def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    return render.exit_codes(lint.find(lint_corpus(spark, sf)), 3)


def revision_briefs(spark: SparkSession, sf: str) -> DataFrame:
    return render.revision_briefs(lint_corpus(spark, sf))


QUERIES = {f.__name__: f for f in (
    scores, word_counts, phrase_hits, density_rates, simple_scores, all_diagnostics, fixed_texts, line_diffs, word_edits, word_reviews, configured_scores, tokens, finding_windows, finding_listings, sentence_metrics, score_histogram, score_by_source, splits, rule_confusion, auc_by_lang,
    regressions, dimension_counts, thresholds, tuning_checks, gate_baseline, corpus_report, judge_requests, judge_outcomes, judge_findings, corpus_stats, absences, top_openers, paragraph_chunks, recent_passages, stratified_passages, self_firing, self_firing_chunks, mined_examples, mined_pairs, judged_scores, judged_diagnostics, page_texts, page_passages,
    benchmark_overlap, seed_echoes, rule_coverage, exit_codes, revision_briefs,
)} | {
    "leading_hits": partial(_by_option, Options(enable=tuple(r.id for r in CORE.rules if r.engine == "leading"))),
    "opener_runs": partial(_one_rule, "no-repetitive-openers"), "long_sentences": partial(_one_rule, "sentence-length"), "uniform_rhythm": partial(_one_rule, "uniform-sentence-rhythm"), "triad_overuse": partial(_one_rule, "triad-overuse"), "dash_context": partial(_one_rule, "no-en-dash"),
    "some_disabled": partial(_by_option, SOME),
}


def _read(p: str) -> str:
    """A block as its pattern reads it: where a word's end is matched as the character behind it, each such character stands twice."""
    return f"regexp_replace(b, '([^{W[1:-1]}])', '\\1\\1', 'g')" if r"(?:ed|en)\b" in p else "b"


def _counts(r: Rule) -> str:
    each = " + ".join(f"coalesce(list_sum(list_transform(bs, lambda b: len(regexp_extract_all({_read(p)}, {quoted(_re2(p))})))), 0)" for p, _ in r.pairs())
    return f"({each})::BIGINT"


_WORDS = quoted(f"{W}(?:[{W[1:-1]}'’-]*{W})?")
_PARSED = f"""WITH {lint_sql()}, parsed AS (SELECT *, len(regexp_extract_all(text, {_WORDS}))::BIGINT AS word_count, list_filter(regexp_split_to_array(text, '\\n(?:[^\\S\\n]*\\n)+'), lambda b: regexp_matches(b, '\\S')) AS bs FROM lint)"""


def _rows(rules: list[Rule]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {quoted(r.id)} AS rule_id, {quoted(r.engine)} AS engine, {quoted(r.intent)} AS intent, { {'error': 5, 'warning': 3, 'suggestion': 1}[r.severity] } AS points, {float(r.threshold or 0)}::DOUBLE AS thr, greatest(word_count, 1) AS w, {_counts(r)} AS n FROM parsed" for r in rules)


_SCORED = f"""{_PARSED}, hits AS ({_rows(COUNTED)}),
fired AS (SELECT *, CASE WHEN engine = 'density' THEN greatest(1, ceil(n - thr * w / 1000))::BIGINT ELSE n END AS weight FROM hits WHERE n > 0 AND (engine = 'phrase' OR n / w * 1000 > thr)),
sums AS (SELECT doc_id, sum(CASE WHEN intent = 'detection' THEN points * weight ELSE 0 END)::BIGINT AS penalty, string_agg(rule_id, ',' ORDER BY rule_id) AS fired FROM fired GROUP BY doc_id),
simple AS (SELECT doc_id, lang, source, word_count, coalesce(penalty, 0)::BIGINT AS penalty, least(100, greatest(0, round(100 * exp(-(coalesce(penalty, 0) / greatest(word_count, 1) * 1000) / 100))))::BIGINT AS score, coalesce(fired, '') AS fired FROM parsed LEFT JOIN sums USING (doc_id)),
samples AS (SELECT simple.*, CASE WHEN quality = 1 THEN 'human' ELSE 'ai' END AS label FROM simple JOIN labels USING (doc_id))"""
_AUC = "coalesce(round(sum(CASE WHEN a.score < h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 6), 0)::DOUBLE"
_SLICES = f"""{_SCORED}, slices AS (SELECT 'all' AS slice, label, score FROM samples UNION ALL SELECT lang, label, score FROM samples),
aucs AS (SELECT slice, {_AUC} AS auc FROM (SELECT * FROM slices WHERE label = 'ai') a JOIN (SELECT * FROM slices WHERE label = 'human') h USING (slice) GROUP BY slice),
result AS (SELECT slice, coalesce(auc, 0)::DOUBLE AS auc, count_if(label = 'ai')::BIGINT AS n_pos, count_if(label = 'human')::BIGINT AS n_neg FROM slices LEFT JOIN aucs USING (slice) GROUP BY slice, auc)"""
_RUNS = "list_distinct(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')))"

_PAGE = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _name in sourcing.DROPPED:
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<{_name}\\b[^>]*>.*?(?:</{_name}\\s*>|\\z)', ' ', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '(?i)</?(?:{sourcing.BREAKING})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name in sorted(sourcing.ENTITIES, key=lambda e: e == "&amp;"):
    _PAGE = f"replace({_PAGE}, {quoted(_name)}, {quoted(sourcing.ENTITIES[_name])})"
_NOISE = r"^[0-9]+$|^(?:[0-9]+\s+){0,4}[0-9]+$|(?i)^(?:page\s+[0-9]+.*|table of contents|opinion)$"

_TOKENS = "list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '[\\s\\p{{Z}}]+'), lambda w: lower(regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}'']+', ''), '[^\\p{{L}}\\p{{N}}'']+$', ''))), lambda w: w <> '')"


def _windows(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


OUTCOMES = """WITH asked AS ({asked}), runs AS (SELECT *, unnest([1, 2]) AS run, cache_key[1] AS c FROM asked)
    SELECT doc_id, unit, unit_ix, run::INT AS run, CASE WHEN c = '0' THEN 'failed' WHEN run = 1 THEN 'fresh' ELSE 'cached' END AS status, CASE WHEN c = '0' OR run = 1 AND c IN ('1', '2') THEN 2 WHEN run = 1 THEN 1 ELSE 0 END::INT AS tries, c = '0' AS has_error FROM runs"""
ORACLE_SQL = {
    "page_texts": f"""WITH bare AS (SELECT page_id, {_PAGE} AS t FROM pages),
        lines AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')) AS ls FROM bare),
        joined AS (SELECT page_id, coalesce(array_to_string(list_filter(ls, lambda x: x <> '' AND NOT regexp_matches(x, {quoted(_NOISE)})), ' '), '') AS j FROM lines)
        SELECT page_id, regexp_replace(array_to_string(list_transform(string_split(j, ' '), lambda w: CASE WHEN regexp_matches(w, '^\\[[0-9]+\\]$') THEN '' ELSE w END), ' '), ' {{2,}}', ' ', 'g') AS text FROM joined""",
    "word_counts": f"{_PARSED} SELECT doc_id, word_count, len(bs)::BIGINT AS n_blocks FROM parsed",
    "phrase_hits": f"{_PARSED}, hits AS ({_rows([r for r in COUNTED if r.engine == 'phrase'])}) SELECT rule_id, sum(n)::BIGINT AS n_hits, count_if(n > 0)::BIGINT AS n_docs FROM hits GROUP BY rule_id",
    "density_rates": f"{_PARSED}, hits AS ({_rows(DENSITY)}) SELECT doc_id, rule_id, n, round(n / w * 1000, 6) AS rate, n / w * 1000 > thr AS fires, greatest(1, ceil(n - thr * w / 1000))::BIGINT AS weight FROM hits WHERE n > 0",
    "simple_scores": f"{_SCORED} SELECT * FROM simple",
    "score_histogram": f"""{_SCORED} SELECT CASE WHEN b = 10 THEN '100' ELSE (b * 10) || '-' || (b * 10 + 9) END AS bucket, count(doc_id)::BIGINT AS n FROM range(11) r(b) LEFT JOIN simple ON score // 10 = b GROUP BY b""",
    "score_by_source": f"{_SCORED} SELECT source, lang, round(avg(score), 6) AS mean_score, min(score) AS worst, count(*)::BIGINT AS n FROM simple GROUP BY source, lang",
    "splits": "SELECT conv_id, count(*)::BIGINT AS turns, CASE WHEN ('0x' || sha256(conv_id::VARCHAR)[1:4])::INTEGER % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM conversations GROUP BY conv_id",
    "rule_confusion": f"""{_SCORED}, rules AS (SELECT DISTINCT rule_id FROM hits), totals AS (SELECT count_if(label = 'ai') AS p, count_if(label = 'human') AS m FROM samples),
        cells AS (SELECT rule_id, count_if(label = 'ai') AS tp, count_if(label = 'human') AS fp FROM fired JOIN samples USING (doc_id) GROUP BY rule_id),
        full_ AS (SELECT rule_id, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, (p - coalesce(tp, 0))::BIGINT AS fn, (m - coalesce(fp, 0))::BIGINT AS tn FROM rules LEFT JOIN cells USING (rule_id), totals),
        rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM full_)
        SELECT rule_id, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END, 6) AS f1 FROM rates""",
    "auc_by_lang": f"{_SLICES} SELECT * FROM result",
    "regressions": f"{_SLICES} SELECT r.slice AS name, e.auc AS baseline, r.auc AS current FROM result r, (SELECT auc FROM result WHERE slice = 'all') e WHERE r.slice <> 'all' AND r.auc < e.auc - 0.03",
    "dimension_counts": "SELECT 'lang' AS dimension, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY source",
    "paragraph_chunks": f"""WITH RECURSIVE {lint_sql()}, parts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(regexp_replace(p, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')), lambda p: p <> '') AS ps FROM lint),
        packed AS (SELECT doc_id, 1 AS i, 0::BIGINT AS chunk_ix, ps[1] AS chunk, ps FROM parts WHERE len(ps) > 0
        UNION ALL SELECT doc_id, i + 1, CASE WHEN strlen(chunk) + 2 + strlen(ps[i + 1]) <= 2000 THEN chunk_ix ELSE chunk_ix + 1 END, CASE WHEN strlen(chunk) + 2 + strlen(ps[i + 1]) <= 2000 THEN chunk || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END, ps FROM packed WHERE i < len(ps))
        SELECT doc_id, chunk_ix, max(strlen(chunk))::BIGINT AS n_bytes, md5(arg_max(chunk, i)) AS chunk_md5 FROM packed GROUP BY doc_id, chunk_ix""",
    "recent_passages": f"""WITH {lint_sql()}, newest AS (SELECT doc_id, substring(text, 1, 900) AS passage FROM lint WHERE text <> '' ORDER BY doc_id DESC LIMIT 28)
        SELECT * FROM (SELECT doc_id, passage, sum(strlen(passage)) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM newest) WHERE running <= 16000""",
    "gate_baseline": f"""{_SLICES}, totals AS (SELECT count_if(label = 'ai') AS p FROM samples), cells AS (SELECT rule_id, count_if(label = 'ai') AS tp, count(*) AS n FROM fired JOIN samples USING (doc_id) GROUP BY rule_id)
        SELECT CASE WHEN slice = 'all' THEN 'overall_auc' ELSE 'slice_auc.' || slice END AS name, auc AS value FROM result UNION ALL SELECT 'per_rule_precision.' || rule_id, round(tp / n, 6) FROM cells""",
    "corpus_report": f"""{_SCORED}, cut AS (SELECT *, CASE WHEN ('0x' || sha256(doc_id::VARCHAR)[1:4])::INTEGER % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM samples), slices(name) AS (VALUES ('overall'), {", ".join(f"('{x}')" for x in LANGUAGES)}),
        aucs AS (SELECT a.split, s.name, sum(CASE WHEN a.score < h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END) / count(*) AS value FROM cut a JOIN cut h ON h.split = a.split AND h.label = 'human' AND a.label = 'ai' JOIN slices s ON s.name IN ('overall', a.lang) GROUP BY a.split, s.name),
        seen AS (SELECT DISTINCT split, s.name FROM cut c JOIN slices s ON c.label = 'human' OR s.name IN ('overall', c.lang)),
        kinds AS (SELECT DISTINCT split, n.name, n.label, n.lang FROM cut, (VALUES ('human', 'human', NULL), ('ai', 'ai', NULL), {", ".join(f"('ai.{x}', 'ai', '{x}')" for x in LANGUAGES)}) AS n(name, label, lang)),
        cells AS (SELECT k.split, k.rule_id, count_if(label = 'ai' AND hit) AS tp, count_if(label = 'human' AND hit) AS fp, count_if(label = 'ai' AND NOT hit) AS fn, count_if(label = 'human' AND NOT hit) AS tn FROM (SELECT c.split, c.label, r.rule_id, f.doc_id IS NOT NULL AS hit FROM cut c CROSS JOIN (SELECT DISTINCT rule_id FROM hits) r LEFT JOIN fired f ON f.doc_id = c.doc_id AND f.rule_id = r.rule_id) k GROUP BY k.split, k.rule_id),
        rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r FROM cells)
        SELECT split, 'auc' AS part, name, round(coalesce(value, 0), 6)::DOUBLE AS value FROM seen LEFT JOIN aucs USING (split, name)
        UNION ALL SELECT k.split, 'mean_score', k.name, round(coalesce(avg(score), 0), 6) FROM kinds k LEFT JOIN cut c ON c.split = k.split AND c.label = k.label AND (k.lang IS NULL OR c.lang = k.lang) GROUP BY k.split, k.name
        UNION ALL SELECT split, unnest(['precision', 'recall', 'f1', 'tp', 'fp', 'fn', 'tn']), rule_id, round(unnest([p, r, coalesce(2 * p * r / nullif(p + r, 0), 0), tp, fp, fn, tn]), 6)::DOUBLE FROM rates""",
    "seed_echoes": f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS ws FROM documents), b AS (SELECT item_id, {_TOKENS.format("text")} AS ws, {_TOKENS.format("regexp_extract(text, '^[^.!?]*')")} AS os FROM benchmark),
        runs AS (SELECT DISTINCT item_id, size, n, run FROM (SELECT item_id, len(ws) AS size, 8 AS n, unnest(list_distinct({_windows("ws", 8)} || {_windows("os", 8)})) AS run FROM b UNION ALL SELECT item_id, len(ws), 5, unnest(list_distinct({_windows("ws", 5)})) FROM b)),
        held AS (SELECT DISTINCT doc_id, size, run FROM (SELECT doc_id, len(ws) AS size, unnest({_windows("ws", 8)} || {_windows("ws", 5)}) AS run FROM d))
        SELECT item_id, doc_id, count_if(n = 8)::BIGINT AS long_runs, count_if(n = 5)::BIGINT AS short_runs FROM held h JOIN runs r USING (run) GROUP BY item_id, doc_id HAVING count_if(n = 8) > 0 OR (count_if(n = 5) > 0 AND max(h.size) < max(r.size) // 2)""",
    "benchmark_overlap": f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM benchmark)
        SELECT item_id, doc_id, count(*)::BIGINT AS runs FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM d) JOIN (SELECT item_id, unnest({_RUNS}) AS run FROM b) USING (run) GROUP BY item_id, doc_id""",
} | SENTENCE_SQL | finding_sql(CORE, SOME)
ORACLE_SQL |= example_sql(mining.family_seeks(), mining.mark_seeks(), mining.canonical_pairs())
ORACLE_SQL |= passage_sql(ORACLE_SQL, COUNTED, _rows, _WORDS, INFERENTIAL)
_SPANS = f"""SELECT j.doc_id, j.start, j."end" AS stop, j.rule, 0, 1, CASE j.ord WHEN 0 THEN 'vague' ELSE 'padded' END, NULL FROM ({ORACLE_SQL["judge_findings"]}) j
    WHERE j.status = 'grounded' AND j.confidence >= 0.6 AND exists(SELECT 1 FROM blocks k WHERE k.doc_id = j.doc_id AND k.bstart <= j.start AND j."end" <= k.bstart + length(k.btext))"""
ORACLE_SQL |= {"judged_diagnostics": judged_sql(CORE, SIMPLE, {CORE.rules.index(r): r for r in INFERENTIAL}, _SPANS)}
ORACLE_SQL |= {"line_diffs": line_diff_sql(ORACLE_SQL["fixed_texts"]), "word_edits": edit_sql(findings(CORE)), "word_reviews": review_sql(findings(CORE)), "configured_scores": place_sql(_PARSED, _rows(COUNTED)), "thresholds": grid_sql(ORACLE_SQL["simple_scores"], ORACLE_SQL["sentence_metrics"]), "tuning_checks": checks_sql(ORACLE_SQL["simple_scores"], ORACLE_SQL["sentence_metrics"], CHECKS), "revision_briefs": brief_sql(ORACLE_SQL["all_diagnostics"]), "tokens": TOKENS, "judge_outcomes": OUTCOMES.format(asked=ORACLE_SQL["judge_requests"]), "finding_windows": window_sql(CORE), "finding_listings": listing_sql(CORE)}
