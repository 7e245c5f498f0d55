"""Scores of documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lint import lint_scores
from ..rules.model import Options, RuleSet


def stream_scores(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores of a streaming table: a projection without state, as on a batch."""
    return lint_scores(docs, rules, options, keep)


def score_monitor(scores: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean score and number of documents per window of event time; later rows than the watermark are not waited for."""
    return scores.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "mean_score", "n")
