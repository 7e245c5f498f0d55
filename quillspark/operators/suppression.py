"""Directives in a text that switch rules off for a line, a stretch of lines or the file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, offsets
from ..rules.model import RuleSet

_WHAT = "struct<all:boolean,ids:array<string>>"
#: Directives in the order in which a line is searched for them.
KEYWORDS = ("disable-file", "disable-next-line", "disable", "enable")


def _named(rest: Column, names: Column) -> Column:
    """What the words behind a keyword switch: everything if there are none, else the rules that are known."""
    bare = F.regexp_replace(rest, r"-->|\*/|,", " ")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    ids = F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), F.try_element_at(names, F.lower(w))))
    return F.struct((F.size(words) == 0).alias("all"), F.array_distinct(F.filter(ids, lambda i: i.isNotNull())).alias("ids")).cast(_WHAT)


def directives(text: Column, rules: RuleSet, prefix: str) -> Column:
    """For each line (from 1): line, keyword (null without one), what."""
    known = {r.id: r.id for r in rules.rules} | {r.name: rules.resolve(r.name) for r in rules.rules if rules.resolve(r.name)}
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")

    def one(line: Column, i: Column) -> Column:
        keyword, rest = F.lit(None).cast("string"), F.lit("")
        for k in reversed(KEYWORDS):
            has = line.rlike(f"(?i){prefix}-{k}")
            keyword = F.when(has, F.lit(k)).otherwise(keyword)
            rest = F.when(has, F.regexp_extract(line, f"(?is){prefix}-{k}(.*)", 1)).otherwise(rest)
        blank = ~line.rlike(r"(?U)\S")
        return F.struct((i + 1).alias("line"), keyword.alias("keyword"), _named(rest, names).alias("what"), blank.alias("blank"))

    return F.transform(F.split(text, "\n", -1), one)


def allowed(findings: Column, text: Column, rules: RuleSet, prefix: str = "prose") -> Column:
    """The findings that no directive suppresses, by the line of their start."""
    state = f"struct<active:{_WHAT},file:{_WHAT},coming:{_WHAT},lines:array<{_WHAT}>>"
    nothing = F.struct(F.lit(False).alias("all"), F.array().cast("array<string>").alias("ids")).cast(_WHAT)
    zero = F.struct(nothing.alias("active"), nothing.alias("file"), nothing.alias("coming"), F.array().cast(f"array<{_WHAT}>").alias("lines")).cast(state)

    def both(a: Column, b: Column) -> Column:
        return F.struct((a["all"] | b["all"]).alias("all"), F.array_union(a["ids"], b["ids"]).alias("ids")).cast(_WHAT)

    def step(acc: Column, d: Column) -> Column:
        k, what = d["keyword"], d["what"]
        # to enable some rules also ends a suppression of all
        left = F.when(what["all"], nothing).otherwise(F.struct(F.lit(False).alias("all"), F.array_except(acc["active"]["ids"], what["ids"]).alias("ids")).cast(_WHAT))
        active = F.when(k == "disable", both(acc["active"], what)).when(k == "enable", left).otherwise(acc["active"])
        here = F.when(d["blank"], active).otherwise(both(active, acc["coming"]))
        here = F.struct((here["all"] | k.isNotNull()).alias("all"), here["ids"].alias("ids")).cast(_WHAT)
        waiting = F.when(d["blank"], acc["coming"]).otherwise(nothing)
        coming = F.when(k == "disable-next-line", both(waiting, what)).otherwise(waiting)
        file = F.when(k == "disable-file", both(acc["file"], what)).otherwise(acc["file"])
        return F.struct(active.alias("active"), file.alias("file"), coming.alias("coming"), F.array_append(acc["lines"], here).alias("lines")).cast(state)

    def holds(what: Column, rule: Column) -> Column:
        return what["all"] | F.array_contains(what["ids"], rule)

    def within(starts: Column) -> Column:
        """`starts`: where each line begins, so that a finding's line is a count."""
        line = lambda f: F.size(F.filter(starts, lambda s: s <= f["start"]))
        kept = lambda acc: F.filter(findings, lambda f: ~(holds(acc["file"], f["rule_id"]) | holds(F.element_at(acc["lines"], line(f)), f["rule_id"])))
        return F.aggregate(directives(text, rules, prefix), zero, step, kept)

    begins = offsets(F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1))
    return F.when(text.rlike(f"(?i){prefix}-(?:disable|enable)"), let(begins, within)).otherwise(findings)
