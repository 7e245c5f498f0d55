"""Measures of rules and scores over labelled samples.

Samples are aggregated before anything is compared: a score has at most 101
values, so that ranks and thresholds work on histograms, not on pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules.model import RuleSet
from ..sources.scratch import cut
from .lint import find, score_of

TRAIN_SHARE, TOLERANCE = 70, 0.03


def split_of(key: Column, explicit: Column | None = None) -> Column:
    """`train` or `test` by a hash of the key; an explicit split wins."""
    bucket = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 4), 16, 10).cast("int") % 100
    by_hash = F.when(bucket < TRAIN_SHARE, "train").otherwise("test")
    return by_hash if explicit is None else F.coalesce(explicit, by_hash)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def rule_confusion(samples: DataFrame, rules: list[str]) -> DataFrame:
    """For each rule tp, fp, fn, tn, precision, recall, f1. samples: label (`ai` is positive), fired (array of rule ids)."""
    spark = samples.sparkSession
    totals = samples.agg(F.count_if(F.col("label") == "ai").alias("n_pos"), F.count_if(F.col("label") == "human").alias("n_neg"))
    hits = (
        samples.select("label", F.explode(F.array_distinct("fired")).alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count_if(F.col("label") == "ai").alias("tp"), F.count_if(F.col("label") == "human").alias("fp"))
    )
    every = spark.createDataFrame([(r,) for r in rules], "rule_id string")
    df = every.join(hits, "rule_id", "left").fillna(0, ["tp", "fp"]).crossJoin(F.broadcast(totals))  # one row of totals
    df = df.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"precision": precision, "recall": recall})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return df.select("rule_id", "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"))


def auc(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """P(ai > human) + P(equal) / 2 of `value`, 0 where a class is empty. samples: label, value and `by`."""
    n = F.when(F.col("label") == "ai", F.lit(1)).otherwise(0)
    counts = samples.groupBy(*by, value).agg(F.sum(n).alias("pos"), F.sum(1 - n).alias("neg"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    wins = counts.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    sums = wins.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*by, F.coalesce(ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")), F.lit(0.0)).alias("auc"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


def score_histogram(scores: DataFrame) -> DataFrame:
    """Counts in the buckets 0-9 to 90-99 and 100; empty ones stay."""
    counts = scores.groupBy(F.floor(F.col("score") / 10).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    all_ = scores.sparkSession.range(11).select(F.col("id").cast("int").alias("b"))
    name = F.when(F.col("b") == 10, "100").otherwise(F.concat((F.col("b") * 10).cast("string"), F.lit("-"), (F.col("b") * 10 + 9).cast("string")))
    return all_.join(counts, "b", "left").select(name.alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def dimension_counts(samples: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Rows for each value of each dimension, from one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return samples.select(pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def class_means(samples: DataFrame, by: str) -> DataFrame:
    return samples.groupBy(by, "label").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Of measures (name, value) in both tables those that fell by more than the tolerance."""
    both = baseline.select("name", F.col("value").alias("baseline")).join(current.select("name", F.col("value").alias("current")), "name")
    return both.where(F.col("current") < F.col("baseline") - tolerance)


def quantiles(samples: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles (index round((n - 1) * p)) of all values: share, value. A column n counts equal rows.

    Ranks come from counts per distinct value; a running sum within 64 ranges of values and
    the totals of the ranges before keep any task from sorting all of them.
    """
    spark = samples.sparkSession
    n = F.sum(F.col("n")) if "n" in samples.columns else F.count(F.lit(1))
    counts = samples.where(F.col(value).isNotNull()).groupBy(value).agg(n.alias("n"))
    # cuts are numbers, so that a recomputed task deals its rows as before
    cuts = counts.agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)]).alias("c")).first().c or []
    parts = counts.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0))
    inside = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 64 rows
    ranked = parts.withColumn("upto", F.sum("n").over(inside)).join(before.drop("size"), "part").withColumn("upto", F.col("upto") + F.col("before"))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = spark.createDataFrame([(float(p),) for p in shares], "share double").crossJoin(F.broadcast(total)).withColumn("at", F.round((F.col("total") - 1) * F.col("share")).cast("long"))
    hit = ranked.crossJoin(F.broadcast(wanted)).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))  # shares: a fixed list
    return hit.select("share", F.col(value).alias("value"))


def report(samples: DataFrame, rules: list[str], slices: list[str]) -> DataFrame:
    """(split, part, name, value) of all measures of a corpus by its split. samples: split, label, score, slice (of machine-written ones), fired (array of rule ids).

    Parts: `auc` over all and of each slice (its machine-written samples against all human ones), `mean_score` by label and slice (0 where there are none),
    and for each rule `precision`, `recall`, `f1`, `tp`, `fp`, `fn`, `tn`. Splits without samples have no rows."""
    human = F.col("label") == "human"
    inside = F.when(human, F.array(*map(F.lit, ("overall", *slices)))).otherwise(F.array_compact(F.array(F.lit("overall"), F.when(F.col("slice").isin(*slices), F.col("slice")))))
    each = cut(samples.groupBy("split", "label", "score", "slice").agg(F.count(F.lit(1)).alias("n")).select("split", "label", "score", "n", F.explode(inside).alias("name")))
    counted = each.groupBy("split", "name", (100 - F.col("score")).alias("value")).agg(F.sum(F.when(F.col("label") == "ai", F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == "human", F.col("n")).otherwise(0)).alias("neg"))
    below = Window.partitionBy("split", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    won = counted.withColumn("won", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)).groupBy("split", "name").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    aucs = won.select("split", F.lit("auc").alias("part"), "name", ratio(F.col("won"), F.col("pos") * F.col("neg")).alias("value"))
    label = F.when(F.col("name") == "overall", F.col("label")).when(F.col("label") == "ai", F.concat(F.lit("ai."), "name"))
    means = each.groupBy("split", label.alias("name")).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("value")).where("name is not null")
    names = samples.sparkSession.createDataFrame([(n,) for n in ("human", "ai", *(f"ai.{x}" for x in slices))], "name string")
    splits = samples.select("split").distinct()
    means = splits.crossJoin(F.broadcast(names)).join(means, ["split", "name"], "left").select("split", F.lit("mean_score").alias("part"), "name", F.coalesce("value", F.lit(0.0)).alias("value"))  # a fixed list
    totals = samples.groupBy("split").agg(F.count_if(F.col("label") == "ai").alias("p"), F.count_if(human).alias("m"))
    hits = samples.select("split", "label", F.explode(F.array_distinct("fired")).alias("name")).groupBy("split", "name").agg(F.count_if(F.col("label") == "ai").alias("tp"), F.count_if(human).alias("fp"))
    every = samples.sparkSession.createDataFrame([(r,) for r in rules], "name string")
    cells = totals.crossJoin(F.broadcast(every)).join(hits, ["split", "name"], "left").fillna(0, ["tp", "fp"]).withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("m") - F.col("fp")})  # a row for each rule
    cells = cells.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    cells = cells.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    parts = ("precision", "recall", "f1", "tp", "fp", "fn", "tn")
    by_rule = cells.select("split", F.inline(F.array(*(F.struct(F.lit(c).alias("part"), F.col("name").alias("name"), F.col(c).cast("double").alias("value")) for c in parts))))
    return aucs.unionByName(means).unionByName(by_rule)


#: Points of a flag that is tried.
POINTS = 3


def _cells(samples: DataFrame, *columns: str) -> DataFrame:
    """Equal rows of samples (label, penalty, words, in_slice where there, and `columns`) counted, as a table of its own."""
    samples = samples if "in_slice" in samples.columns else samples.withColumn("in_slice", F.lit(True))
    return cut(samples.groupBy("label", "penalty", "words", F.coalesce("in_slice", F.lit(False)).alias("in_slice"), *columns).agg(F.count(F.lit(1)).alias("n")))


def _measured(tried: DataFrame, by: list[str]) -> DataFrame:
    """AUC of rows (label, penalty, words, in_slice, n, extra, fired) for each `by`: over all, and with the positive ones of the slice alone; fired counts."""
    sums = lambda *on: F.sum(F.when(on[0] if len(on) == 1 else on[0] & on[1], F.col("n")).otherwise(0))
    ai, human = F.col("label") == "ai", F.col("label") == "human"
    scored = tried.withColumn("score", score_of(F.col("penalty") + F.col("extra"), F.col("words")))
    counts = scored.groupBy(*by, "score").agg(sums(ai).alias("pos"), sums(ai, F.col("in_slice")).alias("pos_in"), sums(human).alias("neg"), sums(ai, F.col("fired")).alias("fired_ai"), sums(human, F.col("fired")).alias("fired_human"))
    above = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    won = F.coalesce(F.sum("neg").over(above), F.lit(0)) + F.col("neg") / 2
    counts = counts.withColumn("won", won)
    done = counts.groupBy(*by).agg(*(F.sum(F.col(c) * F.col("won")).alias(f"w_{c}") for c in ("pos", "pos_in")), *(F.sum(c).alias(c) for c in ("pos", "pos_in", "neg", "fired_ai", "fired_human")))
    return done.select(*by, ratio(F.col("w_pos"), F.col("pos") * F.col("neg")).alias("auc"), ratio(F.col("w_pos_in"), F.col("pos_in") * F.col("neg")).alias("slice_auc"), "fired_ai", "fired_human")


def _fires(value: Column, direction: Column, threshold: Column) -> Column:
    return F.coalesce(F.when(direction == "above", value > threshold).otherwise(value < threshold), F.lit(False))


def threshold_grid(samples: DataFrame, metric: str, shares: list[float], points: int = POINTS, top: int = 6) -> DataFrame:
    """The `top` thresholds of a metric (value, direction, auc, slice_auc, fired_ai, fired_human), above or below, by the AUC of the score with `points` more
    where they fire. Thresholds are nearest-rank quantiles of the distinct values; of those of one direction with equal AUC the least counts.
    samples: label, penalty, words, the metric, and in_slice, the rows of a slice, if there."""
    cells = _cells(samples, metric)
    grid = quantiles(cells.select(metric).distinct(), metric, shares).select("value").distinct().withColumn("direction", F.explode(F.array(F.lit("above"), F.lit("below"))))
    tried = cells.crossJoin(F.broadcast(grid))  # at most two rows for each of a fixed list of shares
    fired = _fires(F.col(metric), F.col("direction"), F.col("value"))
    done = _measured(tried.withColumn("fired", fired).withColumn("extra", F.when(fired, points).otherwise(0)), ["value", "direction"])
    first = done.groupBy("auc", "direction").agg(F.min(F.struct("value", "slice_auc", "fired_ai", "fired_human")).alias("x"))
    return first.select("x.value", "direction", "auc", "x.slice_auc", "x.fired_ai", "x.fired_human").orderBy(F.desc("auc"), "direction", "value").limit(top)


def tuning_checks(samples: DataFrame, checks: list[tuple[str, str, float]], points: int = POINTS) -> DataFrame:
    """AUC, slice_auc, gain over the base, and fired counts with their precision of the score as it is (`base`), with a flag that always fires (`always`:
    what a flag gains by the length of texts alone), with each of `checks` (metric, direction, threshold), and with all of them (`combined`, fired by any)."""
    cells = _cells(samples, *dict.fromkeys(m for m, _, _ in checks))
    hits = {f"{m} {d} {t:g}": _fires(F.col(m), F.lit(d), F.lit(float(t))) for m, d, t in checks}
    both = F.lit(0)
    for hit in hits.values():
        both = both + hit.cast("int")
    tries = {"base": (F.lit(0), F.lit(False)), "always": (F.lit(points), F.lit(True))} | {k: (F.when(h, points).otherwise(0), h) for k, h in hits.items()} | {"combined": (both * points, both > 0)}
    each = F.array(*(F.struct(F.lit(k).alias("check"), extra.cast("int").alias("extra"), fired.alias("fired")) for k, (extra, fired) in tries.items()))
    done = _measured(cells.select("label", "penalty", "words", "in_slice", "n", F.inline(each)), ["check"])
    base = done.where("check = 'base'").select(F.col("auc").alias("base"))
    df = done.crossJoin(F.broadcast(base))  # one row
    return df.select("check", "auc", "slice_auc", (F.col("auc") - F.col("base")).alias("gain"), "fired_ai", "fired_human", ratio(F.col("fired_ai"), F.col("fired_ai") + F.col("fired_human")).alias("precision"))


def precision_map(confusion: DataFrame) -> DataFrame:
    """(rule_id, precision) of the rules that fired at all, of the rows of `rule_confusion`."""
    return confusion.where("tp + fp > 0").select("rule_id", "precision")


def baseline(overall: DataFrame, slices: DataFrame, confusion: DataFrame) -> DataFrame:
    """(name, value) of all that a gate compares: overall_auc, slice_auc.*, per_rule_precision.*. overall: auc; slices: slice, auc; confusion: as `rule_confusion` gives it."""
    named = lambda df, name, value: df.select(name.alias("name"), F.col(value).cast("double").alias("value"))
    rows = named(overall, F.lit("overall_auc"), "auc").unionByName(named(slices, F.concat(F.lit("slice_auc."), "slice"), "auc"))
    return rows.unionByName(named(precision_map(confusion), F.concat(F.lit("per_rule_precision."), "rule_id"), "precision"))


def baseline_json(rows: DataFrame) -> DataFrame:
    """`baseline` as one JSON object: a row for each rule and slice meets in it, no samples."""
    group, name = F.substring_index("name", ".", 1), F.expr("substring(name, length(substring_index(name, '.', 1)) + 2)")
    pairs = lambda g: F.map_from_entries(F.array_sort(F.collect_list(F.when(group == g, F.struct(name, "value")))))
    return rows.agg(F.to_json(F.struct(F.max(F.when(group == "overall_auc", F.col("value"))).alias("overall_auc"), pairs("slice_auc").alias("slice_auc"), pairs("per_rule_precision").alias("per_rule_precision"))).alias("value"))


def write_baseline(rows: DataFrame, folder: str) -> None:
    """Writes `baseline` to a folder as a text file, in place of what was there."""
    baseline_json(rows).coalesce(1).write.mode("overwrite").text(folder)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a baseline that was written, or of any JSON file of that form."""
    form = "overall_auc double, slice_auc map<string,double>, per_rule_precision map<string,double>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", form, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    pairs = lambda c: F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,double>"))), lambda e: F.struct(F.concat(F.lit(f"{c}."), e["key"]).alias("name"), e["value"].alias("value")))
    first = F.array(F.struct(F.lit("overall_auc").alias("name"), F.col("overall_auc").alias("value")))
    return one.select(F.inline(F.concat(first, pairs("slice_auc"), pairs("per_rule_precision")))).where("value is not null")


def verdict_discipline(findings: DataFrame) -> DataFrame:
    """How often a judge's findings deny themselves. findings: label, negated (by the strict guard), negational (broad)."""
    kept = ~F.col("negated")
    n = findings.agg(
        F.count(F.lit(1)).alias("emitted"), F.count_if("negated").alias("dropped_negative"),
        F.count_if(kept & (F.col("label") == "human")).alias("human_kept"), F.count_if(kept & (F.col("label") == "human") & F.col("negational")).alias("human_kept_negational"),
    )
    return n.withColumns({"negation_rate": ratio(F.col("dropped_negative"), F.col("emitted")), "surviving_rate": ratio(F.col("human_kept_negational"), F.col("human_kept"))})


def rule_tests(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """(rule_id, example_ix, kind, text, fired, ok): whether each rule flags its bad examples and leaves its good ones alone."""
    rows = [(r.id, i, kind, text) for r in rules.rules if r.engine != "inferential" for i, pair in enumerate(r.examples) for kind, text in zip(("bad", "good"), pair, strict=True)]
    examples = spark.createDataFrame(rows, "rule_id string, example_ix int, kind string, text string")
    fired = F.exists("findings", lambda f: f["rule_id"] == F.col("rule_id"))
    return find(examples, rules).select("rule_id", "example_ix", "kind", "text", fired.alias("fired"), (fired == (F.col("kind") == "bad")).alias("ok"))


def combined_slice(samples: DataFrame, style: str) -> DataFrame:
    """All human samples and the machine-written ones of one style: the rows of a slice's AUC."""
    return samples.where((F.col("label") == "human") | (F.col("prompt_style") == style))
