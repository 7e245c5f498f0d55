"""Results for readers: coverage of the rules, exit codes, revision briefs, JSON, windows around findings, listings, summaries.

What concerns one document is made from the findings in its row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..rules.model import Options, RuleSet
from .lint import find, fixable, penalty, placed, reach, score_of

OPENING = "Revise the text below. Change only what the points name; keep its meaning."
CLOSING = "Return the revised text only."


def rules_table(spark: SparkSession, rules: RuleSet, options: Options = Options()) -> DataFrame:
    """One row per rule, in order, with whether the options run it."""
    on = {r.id: r for r in rules.chosen(options)}
    rows = [(i, r.id, r.engine, r.tier, on.get(r.id, r).severity, r.intent, r.scope, r.id in on, len(r.pairs()), sum(f is not None for _, f in r.pairs())) for i, r in enumerate(rules.rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, engine string, tier string, severity string, intent string, scope string, enabled boolean, n_patterns int, n_fixes int")


def coverage(found: DataFrame, table: DataFrame) -> DataFrame:
    """Per tier: rules, rules that ran, findings. found: rule_id."""
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    runs = F.col("enabled") & (F.col("tier") != "inferential")
    return table.join(F.broadcast(counts), "rule_id", "left").groupBy("tier").agg(  # at most a row per rule
        F.count(F.lit(1)).alias("total"), F.count_if(runs).alias("ran"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.array_sort(F.collect_list(F.when(~runs, F.col("rule_id")))).alias("skipped")
    )


def exit_codes(found: DataFrame, max_warnings: int = 0) -> DataFrame:
    """1 for documents with an error or too many warnings. found: rows of `find`."""
    warnings = F.size(F.filter("findings", lambda f: f["severity"] == "warning"))
    bad = F.exists("findings", lambda f: f["severity"] == "error") | (warnings > max_warnings)
    return found.select("doc_id", F.when(bad, 1).otherwise(0).alias("exit_code"))


def revision_briefs(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options()) -> DataFrame:
    """A brief for each document with findings: a section per rule, by its first finding."""
    df = placed(find(docs, rules, options)).where(F.size("findings") > 0)
    line = lambda f: F.concat(F.lit("- line "), f["line"].cast("string"), F.lit(": "), f["excerpt"], F.when(f["replacement"].isNotNull(), F.concat(F.lit(" -> "), f["replacement"])).otherwise(""))
    section = lambda rule: F.concat(F.lit("## "), rule, F.lit("\n"), F.array_join(F.transform(F.filter("placed", lambda f: f["rule_id"] == rule), line), "\n"))
    sections = F.transform(F.array_distinct(F.transform("placed", lambda f: f["rule_id"])), section)
    return df.select("doc_id", F.concat_ws("\n\n", F.lit(OPENING), F.array_join(sections, "\n\n"), F.lit(CLOSING)).alias("brief"))


def as_json(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options()) -> DataFrame:
    """doc_id and its findings as a JSON list; documents without findings have no row."""
    return placed(find(docs, rules, options)).where(F.size("findings") > 0).select("doc_id", F.to_json("placed").alias("json"))


# Bytes of context on either side of a match, the longest match that is shown whole, and the longest that is underlined.
CONTEXT, LONGEST, UNDERLINED = 36, 90, 60
_BLANKS = r"(?U)\s+"


def _elided(text: Column, most: int = LONGEST) -> Column:
    """A text of more than `most` characters with an ellipsis for its middle."""
    head = most // 2
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit("…"), F.right(text, F.lit(most - head - 1)))).otherwise(text)


def window(text: Column, start: Column, end: Column, context: int = CONTEXT) -> Column:
    """(window, caret): a match in one line with `context` bytes on either side, cut at blanks, and a line of carets under it (null under none or a long one)."""
    first = F.substring_index(F.substr(text, F.greatest(F.lit(1), start - context), F.least(F.lit(context + 1), start)), "\n", -1)
    last = F.substring_index(F.substr(text, end + 1, F.lit(context + 1)), "\n", 1)

    def written(z: Column) -> Column:
        cut_first, cut_last = F.length(z["left"]) < F.length(z["first"]), F.length(z["right"]) < F.length(z["last"])
        left = F.when(cut_first & z["left"].contains(" "), F.substr(z["left"], F.position(F.lit(" "), z["left"]) + 1)).otherwise(z["left"])
        right = F.when(cut_last & z["right"].contains(" "), F.regexp_replace(z["right"], r"(?s) [^ ]*\z", "")).otherwise(z["right"])
        # blanks of the whole window as one, each run where it begins
        spaced = F.regexp_like(left, F.lit(r"(?Us)\s\z"))
        match = F.when(spaced, F.regexp_replace(z["match"], r"(?U)^\s+", "")).otherwise(z["match"])
        spaced = F.when(z["match"] == "", spaced).otherwise(F.regexp_like(z["match"], F.lit(r"(?Us)\s\z")))
        right = F.when(spaced, F.regexp_replace(right, r"(?U)^\s+", "")).otherwise(right)
        before, after = F.regexp_replace(F.regexp_replace(left, _BLANKS, " "), "^ +", ""), F.regexp_replace(F.regexp_replace(right, _BLANKS, " "), " +\\z", "")
        lead, trail = F.when(cut_first, "…").otherwise(""), F.when(cut_last, "…").otherwise("")

        def shown(match: Column) -> Column:
            size = F.length(match)
            caret = F.when((size > 0) & (size <= UNDERLINED), F.concat(F.repeat(F.lit(" "), F.length(lead) + F.length(before)), F.repeat(F.lit("^"), size)))
            return F.struct(F.concat(lead, before, match, after, trail).alias("window"), caret.alias("caret"))

        return let(_elided(F.regexp_replace(match, _BLANKS, " ")), shown)

    sides = lambda z: F.struct(reach(z["first"], F.lit(context), F.right).alias("left"), z["first"].alias("first"), z["match"].alias("match"), z["last"].alias("last"), reach(z["last"], F.lit(context), F.left).alias("right"))
    return let(let(F.struct(first.alias("first"), F.substr(text, start + 1, end - start).alias("match"), last.alias("last")), sides), written)


def windows(found: DataFrame) -> DataFrame:
    """A row for each finding of the rows of `find`: doc_id, ord, rule_id, line, column, message, window, caret."""
    df = placed(found)
    return df.select("doc_id", F.inline(F.transform("placed", lambda f: F.struct(f["ord"].alias("ord"), f["rule_id"].alias("rule_id"), f["line"].alias("line"), f["column"].alias("column"), f["message"].alias("message"), window(F.col("__t"), f["start"], f["end"]).alias("w"))))).select("doc_id", "ord", "rule_id", "line", "column", "message", "w.*")


def listings(found: DataFrame, keep: tuple[Column | str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep` and its findings as text, one after the other: place, severity, rule, message, window and carets."""
    df = placed(found)

    def entry(f: Column) -> Column:
        head = F.concat(f["line"].cast("string"), F.lit(":"), f["column"].cast("string"), F.lit("  "), f["severity"], F.lit("  "), f["message"], F.lit("  "), f["rule_id"])
        return let(window(F.col("__t"), f["start"], f["end"]), lambda w: F.concat_ws("\n    ", head, w["window"], w["caret"]))

    return df.select("doc_id", *keep, F.when(F.size("findings") == 0, "No findings.").otherwise(F.array_join(F.transform("placed", entry), "\n")).alias("listing"))


def _plural(n: Column, one: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.lit(one), F.when(n != 1, "s").otherwise(""))


def _of_tier(tier: str):
    return lambda f: f["tier"] == tier


def summary(rules: RuleSet, options: Options = Options()) -> Column:
    """A summary of a row of `find`: words and sentences, each tier's rules and findings, the score and what it rests on, how many findings have a fix."""
    on = rules.chosen(options)
    lines = [F.concat(_plural(F.col("words"), "word"), F.lit(" · "), _plural(F.col("n_sentences"), "sentence"))]
    for tier in ("static", "statistical", "inferential"):
        all_, ran = (sum(r.tier == tier for r in x) for x in (rules.rules, on))
        if all_:
            judged = tier == "inferential"
            run = f"0 of {all_} run" if judged else f"{ran} run" if ran == all_ else f"{ran} of {all_} run"
            n = F.size(F.filter("findings", _of_tier(tier)))
            lines.append(F.concat(F.lit(f"{tier}: {run}, "), _plural(n, "finding")))
    score = score_of(penalty(), F.col("words"))
    basis = "" if not any(r.tier == "inferential" for r in rules.rules) else " (without a judge)"
    lines.append(F.concat(F.lit("score "), score.cast("string"), F.lit(f"/100{basis}")))
    n, fixes = F.size("findings"), fixable(F.col("findings"))
    lines.append(F.when(n == 0, "No findings.").otherwise(F.concat(_plural(n, "finding"), F.when(fixes > 0, F.concat(F.lit(" · "), F.format_number(fixes, 0), F.lit(" with a fix"))).otherwise(""))))
    return F.concat_ws("\n", *lines)
