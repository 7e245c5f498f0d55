"""Operator 9: licence notices and identifiers by Aho-Corasick, expressions by shunting-yard.

One automaton holds the notice phrases and the identifier tag. A text becomes
its lower-case words joined by single spaces, so that a phrase matches exactly
where its words stand consecutively. Behind each identifier tag the raw text
holds an expression (`MIT OR (Apache-2.0 AND BSD-3-Clause)`); a shunting-yard
parser turns it into postfix and evaluates it: the licences that it names, those
that hold whatever a reader chooses (`required`), in how many ways one may choose
(`choices`), and the exceptions that go with licences. Nothing is multiplied out,
so nested choices of any number take linear time.

One pass over each partition, no shuffle; texts are handled one at a time.

Defined results: a null text counts as empty; a text without words or notices
has nulls for its places, empty labels and score 0; a malformed expression
contributes the licences it names but no score, requirement or choice of its own;
of several expressions in a text all hold; repeated rows give
repeated results; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of the method's own, with their labels and how sure each is.
OWN = {
    "licensed under the mit license": ("mit", 0.95),
    "released under the mit license": ("mit", 0.95),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd license": ("bsd", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.95),
    "licensed under cc by sa": ("cc-by-sa", 0.95),
    "all rights reserved": ("proprietary", 0.6),
}
TAG = "spdx license identifier"
BASE_SURE, TAG_SURE = 0.7, 1.0
FAMILIES = ("mit", "apache", "agpl", "lgpl", "gpl", "bsd", "mpl", "cc-by-nc", "cc-by-sa", "cc-by", "cc0", "isc", "unlicense")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns what is no word character into spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[^\s()]+")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *OWN, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def postfix(expression: str) -> list[str] | None:
    """The shunting-yard order of an expression; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append("(")
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(word)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: licences it names, those that hold in each of its `choices`, and exceptions (licence, exception)."""

    named: frozenset[str] = frozenset()
    required: frozenset[str] = frozenset()
    choices: int = 1
    exceptions: frozenset[tuple[str, str]] = field(default=frozenset())

    def also(self, other: Terms) -> Terms:
        return Terms(self.named | other.named, self.required | other.required, self.choices * other.choices, self.exceptions | other.exceptions)

    def otherwise(self, other: Terms) -> Terms:
        return Terms(self.named | other.named, self.required & other.required, self.choices + other.choices, self.exceptions | other.exceptions)

    def excepting(self, other: Terms) -> Terms:
        pairs = {(x, e) for x in self.named for e in other.named}
        return Terms(self.named, self.required, self.choices, self.exceptions | pairs)


def evaluate(expression: str) -> Terms | None:
    """The terms of an expression; None if it is malformed."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[Terms] = []
    for token in order:
        if token not in _RANK:
            stack.append(Terms(frozenset((token,)), frozenset((token,))))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left.otherwise(right) if token == "or" else left.also(right) if token == "and" else left.excepting(right))
    return stack[0]


def family(name: str) -> str:
    """The label of a licence identifier."""
    bare = name.removesuffix("+")
    return next((f for f in FAMILIES if bare.startswith(f)), bare)


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, required, choices, exceptions) of a text."""
    words = text.encode("utf-8").translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base_labels: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    rest, at, word, tagged = 1.0, 0, 0, False
    every = Terms()
    own: dict[int, str] = {}  # of the method's phrases that start at one place the longest
    for end, phrase in automaton().iter(joined):
        if phrase in BASE:
            begin = end - len(phrase) - 1
            if begin >= at:
                word += joined.count(" ", at, begin)
            else:
                word -= joined.count(" ", begin, at)
            at = begin
            starts.append(word)
            base_labels.add(BASE[phrase])
            rest *= 1 - BASE_SURE
        elif phrase == TAG:
            tagged = True
        else:
            begin = end - len(phrase) - 1
            own[begin] = max(own.get(begin, ""), phrase, key=len)
    for label, sure in map(OWN.__getitem__, own.values()):
        labels.add(label)
        rest *= 1 - sure
    if tagged:
        for expression in _TAG_LINE.findall(text):
            bare = expression.strip().removesuffix("*/").removesuffix("-->").strip()
            terms = evaluate(bare)
            if terms is None:
                labels.update(f for f in (family(x.lower()) for x in _TOKEN.findall(bare)) if f in FAMILIES)
            else:
                labels.update(map(family, terms.named))
                every = every.also(terms)
                rest *= 1 - TAG_SURE
    labels |= base_labels
    first, last = (min(starts), max(starts)) if starts else (None, None)
    listed = lambda x: ",".join(sorted(set(x)))
    own_terms = (listed(every.required), min(every.choices, MOST_CHOICES), listed(f"{x} with {e}" for x, e in every.exceptions))
    return len(words), len(starts), first, last, listed(base_labels), listed(labels), 1 - rest, *own_terms


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, choices long, exceptions string"
#: The largest number that the column `choices` holds.
MOST_CHOICES = (1 << 63) - 1


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text) with its notices and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = [scan(x.as_py() or "") for x in batch.column(1)]
            columns = [[row[i] for row in found] for i in range(10)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
