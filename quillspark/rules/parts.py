"""Rules with patterns as rows: what the engines read, and which literals a pattern cannot match without."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import java
from .model import Rule

PART = (
    "array<struct<kind:string,rule_ix:int,part_ix:int,pattern:string,probe:string,scope:string,context:string,window:int,fix:string,expands:boolean,match_case:boolean,"
    "counts:string,threshold:double,rule_id:string,severity:string,tier:string,intent:string,message:string>>"
)
#: Letters that a pattern without regard to case takes for ASCII ones, although their lower case is another.
FOLDED = {"ſ": "s", "\u212a": "k", "İ": "i", "ı": "i"}
#: A comma is searched for, and only there the letter before it; the letter beyond U+FFFF has the search backwards go by code points.
_BEHIND_WORD = r"(?<=(?:\w|\x{10400}),)"
#: Patterns with equal matches, and patterns with as many, that do not go back over words; the ones they stand for are the rules' own.
_QUICK = {
    # between letters no word begins, which is told at less cost than a word's edge
    r"(?i)\w+,\s+\w+(?:\s+\w+){0,3}\s+(?:and|or)\s+\w+": r"(?<![a-z])(?i)\b\w++,\s++\w++(?:\s++\w++){0,3}\s++(?:and|or)\s++\w++",
    r"(?i)\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b": r"(?=[iawbIAWBıİ])(?i)\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b",
}
_AS_MANY = {
    # of the words before a comma a match needs one letter, which no match before it holds, since no other match ends within a word
    r"(?i)\b\w+(?:\s+\w+){0,3},\s+\w+(?:\s+\w+){0,3},\s+and\s+\w+": rf"(?i),{_BEHIND_WORD}(?<!\G,)\s++\w++(?:\s++\w++){{0,3}}+,\s++and\s++\w++",
}
#: Patterns that match in every text in which these do, and cheaper ones.
_PROBES = {r"(?i)\w+,\s+\w+(?:\s+\w+){0,3}\s+(?:and|or)\s+\w+": rf"(?i),{_BEHIND_WORD}\s++\w++(?:\s++\w++){{0,3}}\s++(?:and|or)\s++\w++"}
_AS_ONE = {_parser.SUBPATTERN, _parser.ATOMIC_GROUP}
_REPEATS = {_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT}


def quick(pattern: str) -> str:
    """A pattern with the same matches as this one, quicker where one is known: where it begins at a word's edge, the letter behind is looked at first."""
    return _QUICK[pattern] if pattern in _QUICK else _led(pattern)


def _firsts(items) -> set[str] | None:
    """The characters that a match may begin with; None where they are not known or none are needed."""
    for op, value in items:
        if op is _parser.AT:
            continue
        if op is _parser.LITERAL:
            return {chr(value)}
        if op is _parser.IN:
            return {chr(x) for _, x in value} if all(o is _parser.LITERAL for o, _ in value) else None
        if op in _AS_ONE:
            return _firsts(value[-1] if isinstance(value, tuple) else value)
        if op in _REPEATS and value[0] > 0:
            return _firsts(value[2])
        if op is _parser.BRANCH:
            each = [_firsts(x) for x in value[1]]
            return None if None in each else set().union(*each)
        return None
    return None


def _led(pattern: str) -> str:
    """A pattern behind a look at its first letter, which costs less than a word's edge: for those that begin at one, in letters of ASCII and without regard to case."""
    if not re.match(r"\(\?i\)(?:\(\?:)?\\b", pattern):
        return pattern
    try:
        firsts = _firsts(_parser.parse(pattern))
    except (re.error, OverflowError):  # a construct of the other dialect
        return pattern
    if not firsts or not all(c.isascii() and c.isalpha() for c in firsts):
        return pattern
    low = {c.lower() for c in firsts}
    seen = sorted(low | {c.upper() for c in low} | {rare for rare, c in FOLDED.items() if c in low})
    return f"(?=[{''.join(seen)}])" + (f"(?i)(?:{pattern[4:]})" if "|" in pattern else pattern)


def probe(pattern: str) -> str:
    """A pattern that tells at less cost which texts this one may match."""
    return _PROBES.get(pattern) or quick(pattern)


def counting(pattern: str) -> str:
    """A pattern with as many matches in any text as this one."""
    return _AS_MANY.get(pattern, quick(pattern))


def folded(text: Column) -> Column:
    """A text in lower case, in which the literals of `needed` are looked up."""
    rare = reduce(or_, (text.contains(c) for c in FOLDED))  # few texts hold any, and a translation takes each character apart
    rare = (F.octet_length(text) != F.length(text)) & rare
    return F.lower(F.when(rare, F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))).otherwise(text))


#: Runs shorter than this are in most texts, and looked up only where nothing else is known.
TELLING = 3
#: One of some literals, each with whether it must stand as a whole word and with the run of characters that holds it.
Need = frozenset[tuple[str, bool, str]]


#: Spellings of a word that are looked up one by one.
SPELLINGS = 8


#: Where these match, no word goes on.
_ENDS = {_parser.AT_BOUNDARY, _parser.AT_BEGINNING, _parser.AT_BEGINNING_STRING, _parser.AT_END, _parser.AT_END_STRING}


def _is_edge(op, value) -> bool:
    """Whether a word ends where this stands: at a word's edge, or at characters that are in no word."""
    if op is _parser.LITERAL:
        return not re.match(r"\w", chr(value))
    if op is _parser.IN:
        return all(x == _parser.CATEGORY_SPACE if o is _parser.CATEGORY else o is _parser.LITERAL and not re.match(r"\w", chr(x)) for o, x in value)
    if op in _REPEATS:
        return value[0] > 0 and len(value[2]) == 1 and _is_edge(*value[2][0])
    return op is _parser.AT and value in _ENDS


def _may_lack(op, value) -> bool:
    """Whether this is nothing or characters that are in no word."""
    return op in _REPEATS and len(value[2]) == 1 and _is_edge(*value[2][0])


def _spelled(op, value) -> list[str] | None:
    """All that this matches, if it is letters only and little enough."""
    if op is _parser.LITERAL:
        return [chr(value)]
    if op is _parser.IN:
        return [chr(x) for _, x in value] if all(o is _parser.LITERAL and re.match(r"\w", chr(x)) for o, x in value) else None
    if op in _REPEATS and tuple(value[:2]) == (0, 1):
        inner = _words_of(value[2])
        return None if inner is None else ["", *inner]
    if op is _parser.BRANCH:
        each = [_words_of(x) for x in value[1]]
        return None if None in each else [s for x in each for s in x]
    if op in _AS_ONE:
        return _words_of(value[-1] if isinstance(value, tuple) else value)
    return None


def _words_of(items) -> list[str] | None:
    out = [""]
    for op, value in items:
        each = _spelled(op, value)
        if each is None or len(out) * len(each) > SPELLINGS:
            return None
        out = [a + b for a in out for b in each]
    return out


def _whole_words(run: str, opened: bool, closed: bool) -> list[str]:
    return [m[0] for m in re.finditer(r"\w+", run) if (m.start() > 0 or opened) and (m.end() < len(run) or closed)]


def _needs(items, left: bool = False, right: bool = False) -> list[Need]:
    """Of each of these needs every match holds a literal; empty where nothing is known.
    `left` and `right` say whether a word's edge lies before and behind the items."""
    found: list[Need] = []
    items = list(items)
    before, behind = [left], [right]  # whether a word's edge lies on the left of each item and the end, and on their right
    for item in items:
        before.append(_is_edge(*item) or _may_lack(*item) and before[-1])
    for item in reversed(items):
        behind.insert(0, _is_edge(*item) or _may_lack(*item) and behind[0])
    run, opened, past = "", False, 0
    for n, (op, value) in enumerate([*items, (None, None)]):
        if n < past:
            continue
        if op is _parser.LITERAL:
            opened = opened if run else before[n]
            run += chr(value)
            continue
        if run:
            # what may follow the run up to a word's edge makes a few whole words of it
            past = next((j for j in range(n, len(items) + 1) if j == len(items) or _spelled(*items[j]) is None), n)
            ends = _words_of(items[n:past]) if past > n and behind[past] else None
            each = [(run + end, _whole_words(run + end, opened, True)) for end in ends or ()]
            if each and all(words for _, words in each):
                found.append(frozenset((max(words, key=len), True, spelling) for spelling, words in each))
                run = ""
                continue
            past = 0
            whole = _whole_words(run, opened, behind[n])
            found.append(frozenset(((max(whole, key=len), True, run),)) if whole else frozenset(((run, False, run),)))
            run = ""
        if op in _AS_ONE:
            found += _needs(value[-1] if isinstance(value, tuple) else value, before[n], behind[n + 1])
        elif op in _REPEATS and value[0] > 0:
            found += _needs(value[2])
        elif op is _parser.BRANCH:
            each = [_strongest(_needs(x, before[n], behind[n + 1])) for x in value[1]]
            if None not in each:
                found.append(frozenset().union(*each))
    return found


def _strength(need: Need) -> tuple[int, int]:
    return min(len(run) for _, _, run in need), -len(need)


def _strongest(found: list[Need]) -> Need | None:
    return max(found, key=_strength, default=None)


def needed(pattern: str) -> tuple[Need, ...] | None:
    """Needs in lower case, of each of which every text with a match holds a literal; None where nothing is known."""
    try:
        found = _needs(_parser.parse(pattern))
    except (re.error, OverflowError):  # a construct of the other dialect
        return None
    low = lambda s: "".join(FOLDED.get(c, c) for c in s).lower()
    found = sorted(set(found), key=lambda x: (*(-k for k in _strength(x)), sorted(x)))
    found = found[:1] + [need for need in found[1:] if _strength(need)[0] >= TELLING]
    found.sort(key=lambda x: not all(whole for _, whole, _ in x))  # words are looked up at less cost than the text is searched
    return tuple(frozenset((low(s), whole, low(run)) for s, whole, run in need) for need in found) or None


def held(pattern: str) -> list[str]:
    """Runs of characters one of which every match of a pattern holds; none where they are not known."""
    try:
        found = _strongest(_needs(_parser.parse(pattern)))
    except (re.error, OverflowError):  # a construct of the other dialect
        found = None
    return sorted({run for _, _, run in found}) if found and "(?i" not in pattern else []


def parts(rules: list[Rule]) -> list[dict]:
    """A row for each pattern of phrase rules, and for each rate or leading rule; rule_ix is the place in `rules`."""
    out = []
    for ix, r in enumerate(rules):
        base = {"kind": r.engine, "rule_ix": ix, "scope": r.scope, "rule_id": r.id, "severity": r.severity, "tier": r.tier, "intent": r.intent, "message": r.says()}
        if r.engine == "phrase":
            context = (java(r.allow_context[0]), r.allow_context[1]) if r.allow_context else (None, None)
            for n, (pattern, fix) in enumerate(r.pairs()):
                expands = n in r.templates
                out.append(base | {"part_ix": n, "message": r.says(n), "pattern": java(quick(pattern)), "probe": java(probe(pattern)), "needs": needed(pattern), "context": context[0], "window": context[1], "fix": r.java_template(fix) if expands else fix, "expands": expands, "match_case": r.match_case})
        elif r.engine == "density":
            pattern = r.pairs()[0][0]
            out.append(base | {"part_ix": 0, "pattern": java(quick(pattern)), "counts": java(counting(pattern)), "needs": needed(pattern), "threshold": float(r.threshold)})
        elif r.engine == "leading":
            each = [p for p, _ in r.pairs()]
            needs = [needed(p) for p in each]
            either = None if None in needs else (frozenset().union(*(n[0] for n in needs)),)
            any_ = "|".join(f"(?:{p})" for p in each)
            out.append(base | {"part_ix": 0, "pattern": java(f"(?i)^(?:{any_})"), "needs": either})
    return out


def as_literal(rows: list[dict]) -> Column:
    """The rows as an array."""
    return F.from_json(F.lit(json.dumps([{k: v for k, v in r.items() if k != "needs"} for r in rows])), PART)


def _text(literal: str) -> str:
    return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keywords(rows: list[dict], low: Column) -> Column:
    """Of the whole words that the rows need those in a text with this lower case."""
    wanted = sorted({s for r in rows for need in r["needs"] or () for s, whole, _ in need if whole})
    if not wanted:
        return F.array().cast("array<string>")
    return F.array_intersect(F.expr(f"array({', '.join(map(_text, wanted))})"), F.split(low, r"(?U)[^\w]+"))


NEEDS = "array<array<array<struct<s:string,whole:boolean,run:string>>>>"


def candidates(rows: list[dict], low: str, words: str) -> Column:
    """Places (from 1) of the rows that a text may match, by the columns of its lower case and its `keywords`.

    Rows that need a whole word are reached by the words that a text has; the others are tried one by one."""
    keys = {i: next((need for need in r["needs"] or () if all(whole for _, whole, _ in need)), None) for i, r in enumerate(rows, 1)}
    by_word: dict[str, list[int]] = {}
    for i, need in keys.items():
        for s in sorted({s for s, _, _ in need or ()}):
            by_word.setdefault(s, []).append(i)
    tried = _tried([(i, r) for i, r in enumerate(rows, 1) if keys[i] is None], low, words)
    if not by_word:
        return tried
    needs = F.from_json(F.lit(json.dumps([[[{"s": s, "whole": whole, "run": run if run != s or not whole else None} for s, whole, run in sorted(need)] for need in r["needs"]] if keys[i] else [] for i, r in enumerate(rows, 1)])), NEEDS)
    places = F.from_json(F.lit(json.dumps(by_word)), "map<string,array<int>>")
    known = lambda x: ~x["whole"] | F.array_contains(words, x["s"])
    holds = lambda x: known(x) & (x["run"].isNull() | F.contains(F.col(low), x["run"]))
    all_ = lambda i, holds: F.forall(F.element_at(needs, i), lambda need: F.exists(need, holds))
    reached = F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(places[w], F.array().cast("array<int>")))))
    # the text is searched only where no word is missing
    return F.concat(F.filter(reached, lambda i: all_(i, known) & all_(i, holds)), tried)


def _tried(rows: list[tuple[int, dict]], low: str, words: str) -> Column:

    def may(r: dict) -> str:
        def one(s: str, whole: bool, run: str) -> str:
            known = [f"array_contains({words}, {_text(s)})"] * whole + [f"contains({low}, {_text(run)})"] * (run != s or not whole)
            return " AND ".join(known)

        return " AND ".join(f"({' OR '.join(one(*x) for x in sorted(need))})" for need in r["needs"])

    # as one text: some hundred expressions, each a call to the JVM
    each = [str(i) if r["needs"] is None else f"CASE WHEN {may(r)} THEN {i} END" for i, r in rows]
    return F.expr(f"array_compact(array({', '.join(each)}))") if each else F.array().cast("array<int>")
