"""Sentences of a block, as array expressions.

Whether a text splits at a full stop depends on a few characters on either side
only, so one pattern with bounded look-behind says where, and a text is cut in
one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match_spans, pieces

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    "v. vs. id. ibid. no. nos. fed. r. civ. crim. p. proc. evid. cir. ct. cl. u.s. s. ed. l. rev. stat. reg. sec. art. para. pp. seq. "
    "e.g. i.e. etc. cf. inc. corp. ltd. co. mr. mrs. ms. dr. prof. hon. "
    "jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec."
).split()
# Words and numbers, reporter citations, case names, signals.
WORD = r"\p{IsAlphabetic}[\p{IsAlphabetic}\p{N}]*(?:['’-][\p{IsAlphabetic}\p{N}]+)*+"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*+"
REPORTER = r"(?U)\d+\s+[A-Z][A-Za-z.]{0,15}\s+\d+"
CASE = r"[A-Z][\w.'’-]*\s+vs?\.\s+[A-Z]"
SIGNAL = rf"""(?Us)^[\s"“‘']*(?:See also|See|But see|Cf\.|Accord|E\.g\.,)(?=\s).*?{CASE}"""
_GLUED = r"(?<![\p{IsAlphabetic}\p{N}.()'’-])"
_ABBREVIATION = "(?i:" + "|".join(sorted((a[:-1].replace(".", r"\.") for a in ABBREVIATIONS), key=lambda a: (-len(a), a))) + ")"
_ORDINAL = r"[0-9]{1,18}(?i:d|st|nd|rd|th)"
_ITEM = r"(?<=^|\n)[^\S\n]{0,32}\(?(?:[0-9]{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,3})\)?"
#: Behind a full stop alone that belongs to an abbreviation, an initial, an ordinal or a numbered item.
_BLOCKED = rf"(?:(?<={_GLUED}(?:{_ABBREVIATION}|[A-Z]|{_ORDINAL})\.)|(?<={_ITEM}\.))(?![.!?])"
#: Behind what none of these is: another mark than a full stop, or a word longer than any of them. It saves nearly all searches backwards.
_FREE = r"(?<=[!?])|(?<=[a-z]{5}\.)"
#: Begins with the stop and what follows it, so that few characters meet the look-behind.
BOUNDARY = rf"""(?U)[.!?](?=[.!?"'”’)\]\s])(?<![.!?][.!?])(?=[.!?]*+["'”’)\]]*+\s++[\p{{IsUppercase}}0-9"“‘'(])(?:{_FREE}|(?!{_BLOCKED}))[.!?]*+["'”’)\]]*+"""


def sentences(block: Column) -> Column:
    """array of (start, end, text, n_words, opener, is_citation) of a block's text."""

    def piece(z: Column) -> Column:
        return F.struct(
            z["start"].alias("start"),
            z["end"].alias("end"),
            z["text"].alias("text"),
            F.regexp_count(z["text"], F.lit(f"{WORD}|{NUMBER}")).alias("n_words"),
            F.nullif(F.lower(F.regexp_extract(z["text"], WORD, 0)), F.lit("")).alias("opener"),
            (z["text"].rlike(SIGNAL) | z["text"].rlike(REPORTER)).alias("is_citation"),
        )

    return F.transform(pieces(block, BOUNDARY), piece)


#: Words, numbers, and every other character that is no blank.
TOKEN = rf"{WORD}|{NUMBER}|(?U:\S)"


def tokens(text: Column) -> Column:
    """array of (start, end, kind, text) of a text's tokens; kinds: word, number, punct."""
    kind = lambda t: F.when(t.rlike(r"^\p{IsAlphabetic}"), "word").when(t.rlike("^[0-9]"), "number").otherwise("punct")
    return F.transform(match_spans(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s["text"]).alias("kind"), s["text"].alias("text")))
