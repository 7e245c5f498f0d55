"""Findings as a review of WordprocessingML: tracked changes and comments.

Everything is an expression over the document part (XML text) in its row. A text is
projected from the part together with the places of its runs; candidates (fixes, then
findings without one) are given to runs, and a fix whose words lie in one run and overlap no
earlier fix becomes a tracked change, every other one a comment over the words as they are.
Runs that hold more than one text, or lie in a revision already, are left alone, and with
them both ends of a comment that begins or ends there. A run with edits is cut at all places
where one begins or ends, and written stretch by stretch; so comments may nest, cross and
reach over runs.

Offsets count code points of the projected text. Elements are known by their local names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, offsets, once

# Elements of the format, first identifiers.
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
FIRST_REVISION = 900_000


def _tag(names: str) -> str:
    """The opening tag of an element that is not empty."""
    return rf"<(?:\w+:)?(?:{names})(?:\s[^>]*)?(?<!/)>"


def _empty(names: str) -> str:
    return rf"<(?:\w+:)?(?:{names})(?:\s[^>]*)?/>"


def _close(names: str) -> str:
    return rf"</(?:\w+:)?(?:{names})\s*>"


TEXT = rf"{_tag('t')}.*?{_close('t')}|{_empty('t')}"
#: The same elements, each character of a text looked at once.
_TEXT = rf"{_tag('t')}[^<]*+(?:(?!{_close('t')})<[^<]*+)*+{_close('t')}|{_empty('t')}"
UNIT = rf"(?s)(?=<)(?:{_TEXT}|{_close('p')}|{_empty('tab|br|cr')})"
#: The same places: what stands in a text that holds no tag, and of all else one tag (of an empty text its last, of one with tags its first).
PLAIN_UNIT = rf"(?s)(?=</?+(?:\w++:)?+(?:t|p|tab|br|cr)[\s/>])(?:{_tag('t')}(?=[^<]*+{_close('t')})|(?={_TEXT}|{_close('p')}|{_empty('tab|br|cr')}))(<[^>]*+>|[^<]*+)"
RUN = rf"(?s){_tag('r')}.*?{_close('r')}"
PROPERTIES = rf"(?:{_empty('rPr')}|{_tag('rPr')}.*{_close('rPr')})"
#: A run of one text and, before it, properties at most.
SIMPLE = rf"(?s)^{_tag('r')}\s*{PROPERTIES}?\s*(?:{_tag('t')}[^<]*{_close('t')}|{_empty('t')})\s*{_close('r')}\z"
#: Of these, the ones without properties: no other text stands in them.
BARE = rf"(?s)^{_tag('r')}\s*(?:{_tag('t')}[^<]*+{_close('t')}|{_empty('t')})\s*{_close('r')}\z"
#: Stands for the next revision's number; a noncharacter, which no XML holds.
NEXT = "﷑"


@dataclass(frozen=True)
class Review:
    """Who reviews and when (null: no date), whether fixes that may be wrong are made, and whether findings without a fix become comments."""

    author: str = "review"
    date: str | None = None
    maybe: bool = True
    annotate: bool = True

    def initials(self) -> str:
        return "".join(w[0] for w in self.author.split()).upper() or "R"


def now() -> Column:
    """The time as the format writes it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _character(reference: Column) -> Column:
    """The character of a numeric reference."""
    base16 = F.regexp_extract(reference, "(?i)^&#x([0-9a-f]+);", 1)
    code = F.when(base16 != "", base16).otherwise(F.conv(F.regexp_extract(reference, "^&#([0-9]+);", 1), 10, 16))
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")


def unescaped(text: Column) -> Column:
    def numbers(z: Column) -> Column:
        between, found = F.split(z, "&#[xX]?[0-9a-fA-F]{1,6};", -1), F.regexp_extract_all(z, F.lit("&#[xX]?[0-9a-fA-F]{1,6};"), F.lit(0))
        return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, r: F.concat(b, _character(r))), ""), F.element_at(between, -1))

    def names(z: Column) -> Column:
        for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
            z = F.replace(z, F.lit(entity), F.lit(raw))
        return z

    whole = F.when(text.contains("&#"), let(text, numbers)).otherwise(text)
    return F.when(text.contains("&"), names(whole)).otherwise(text)


def _inner(element: Column) -> Column:
    """The text of an element, character data included."""
    # most hold no tag but their own; an element that is empty has nothing behind its tag
    plain = F.substr(F.substring_index(element, "<", 2), F.instr(element, ">") + 1)
    bare = F.when(F.substring_index(element, "<", 3) == element, plain).otherwise(F.regexp_extract(element, r"(?s)\A<[^>]*>(.*)<[^>]*>\z", 1))
    return let(bare, lambda z: F.when(z.contains("<![CDATA["), F.regexp_replace(z, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")).otherwise(unescaped(z)))


def _said(xml: Column) -> Column:
    """What each unit of a part says, and whether it is a text."""
    piece = lambda is_text, said: F.struct(is_text.alias("is_text"), said.alias("said"))
    sign = lambda u: F.when(u.startswith("</"), "\n\n").when(u.rlike(r"^<(?:\w+:)?tab[\s/>]"), "\t").otherwise("\n")

    def plain(u: Column) -> Column:
        return F.when(~u.startswith("<"), piece(F.lit(True), unescaped(u))).otherwise(let(u.rlike(r"^</?(?:\w+:)?t[\s/>]"), lambda empty: piece(empty, F.when(empty, "").otherwise(sign(u)))))

    def whole(u: Column) -> Column:
        is_text = u.rlike(r"^<(?:\w+:)?t[\s/>]")
        return piece(is_text, F.when(is_text, _inner(u)).otherwise(sign(u)))

    opens = lambda u: u.startswith("<") & ~u.startswith("</") & ~u.endswith("/>")
    slowly = F.transform(F.regexp_extract_all(xml, F.lit(UNIT), F.lit(0)), whole)
    return let(F.regexp_extract_all(xml, F.lit(PLAIN_UNIT), F.lit(1)), lambda all_: F.when(F.exists(all_, opens), slowly).otherwise(F.transform(all_, plain)))


def said(xml: Column) -> Column:
    """The text of a document part alone. A null part is empty."""
    return F.array_join(F.transform(_said(F.coalesce(xml, F.lit(""))), lambda p: p["said"]), "")


def _projection(xml: Column) -> Column:
    def placed(z: Column) -> Column:
        at = offsets(F.transform(z, lambda p: F.length(p["said"])))
        spans = F.zip_with(z, F.slice(at, F.lit(1), F.size(z)), lambda p, o: F.struct(p["is_text"].alias("is_text"), o.alias("start"), (o + F.length(p["said"])).alias("end")))
        runs = F.transform(F.filter(spans, lambda s: s["is_text"]), lambda s, i: F.struct(i.alias("run"), s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.array_join(F.transform(z, lambda p: p["said"]), "").alias("text"), runs.alias("runs"))

    return let(_said(xml), placed)


def projected(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds `text`, the text of a document part, and `runs`, the places (start, end) of its texts in order. A null part is empty."""
    return once(docs, __p=_projection(F.coalesce(F.col(xml), F.lit("")))).withColumns({"text": F.col("__p.text"), "runs": F.col("__p.runs")}).drop("__p")


def _first(runs: Column, fits) -> Column:
    return F.get(F.filter(runs, fits), F.lit(0))


#: Of so many runs one is known by its beginning, so that a place is looked up among few.
STRIDE = 16


def _about(runs: Column, heads: Column, before) -> Column:
    """The runs that may hold a place: the last one that begins `before` it is among them. `heads`: where every `STRIDE`-th run begins."""
    return let(F.size(F.filter(heads, before)), lambda k: F.slice(runs, F.greatest(k - 1, F.lit(0)) * STRIDE + 1, F.lit(STRIDE)))


def edits(found: DataFrame, review: Review = Review(), first_comment: Column | None = None) -> DataFrame:
    """Adds to the rows of `find` with `runs`: `edits`, in order (id, start, end, replacement, message, kind, first, last), `n_lost`, the
    candidates that no run holds, and `n_maybe`, the tracked changes whose fix may be wrong. Kinds: redline, comment, split (a comment from one run to another)."""
    f = F.col("findings")
    usable = lambda x: x["replacement"].isNotNull() & (F.lit(review.maybe) | (x["tier"] != "inferential"))
    bounded = lambda x: (x["start"] <= x["end"]) & (x["end"] <= F.col("__size"))
    as_one = lambda fix: lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("ord"), (x["replacement"] if fix else F.lit(None).cast("string")).alias("replacement"), x["message"].alias("message"), ((x["tier"] == "inferential") & F.lit(fix)).alias("maybe"))
    # places in the list of findings break ties
    rewrites = F.array_sort(F.transform(F.filter(f, lambda x: usable(x) & bounded(x)), as_one(True)))
    notes = F.array_sort(F.transform(F.filter(f, lambda x: ~usable(x) & bounded(x) & (x["start"] < x["end"])), as_one(False)))
    heads = F.transform(F.filter("runs", lambda r, i: i % STRIDE == 0), lambda r: r["start"])
    df = once(found, __size=F.length("__t"), __heads=heads)
    df = once(df, __c=F.concat(rewrites, notes) if review.annotate else rewrites)

    def located(c: Column) -> Column:
        point = c["start"] == c["end"]
        at = _first(F.col("runs"), lambda r: (c["start"] >= r["start"]) & (c["end"] <= r["end"]))
        first = F.when(point, at).otherwise(_first(_about(F.col("runs"), F.col("__heads"), lambda s: s <= c["start"]), lambda r: (r["start"] <= c["start"]) & (c["start"] < r["end"])))
        last = F.when(point, at).otherwise(_first(_about(F.col("runs"), F.col("__heads"), lambda s: s < c["end"]), lambda r: (r["start"] < c["end"]) & (c["end"] <= r["end"])))
        return F.struct(c.alias("c"), first.alias("first"), last.alias("last"))

    df = once(df, __l=F.filter(F.transform("__c", located), lambda z: z["first"].isNotNull() & z["last"].isNotNull()))
    start = F.struct(F.lit(0).alias("guard"), F.array().cast("array<boolean>").alias("out"))

    def chosen(acc: Column, z: Column) -> Column:
        wins = z["c"]["replacement"].isNotNull() & (z["first"]["run"] == z["last"]["run"]) & (z["c"]["start"] >= acc["guard"])
        return F.struct(F.when(wins, z["c"]["end"]).otherwise(acc["guard"]).alias("guard"), F.array_append(acc["out"], wins).alias("out"))

    df = once(df, __w=F.aggregate("__l", start, chosen, lambda acc: acc["out"]))
    base = F.lit(1) if first_comment is None else first_comment

    def edit(z: Column, i: Column) -> Column:
        wins, c = F.get(F.col("__w"), i), z["c"]
        kind = F.when(wins, "redline").when(z["first"]["run"] == z["last"]["run"], "comment").otherwise("split")
        return F.struct((base + i).cast("int").alias("id"), c["start"].alias("start"), c["end"].alias("end"), F.when(wins, c["replacement"]).alias("replacement"), c["message"].alias("message"), kind.alias("kind"), z["first"].alias("first"), z["last"].alias("last"), c["maybe"].alias("maybe"))

    lost = (F.size("__c") - F.size("__l")).alias("n_lost")
    df = once(df, edits=F.transform("__l", edit)).withColumn("n_lost", lost)
    return df.withColumn("n_maybe", F.size(F.filter("edits", lambda e: (e["kind"] == "redline") & e["maybe"]))).drop("__size", "__heads", "__c", "__l", "__w")


PIECE = "array<struct<run:int,start:int,end:int,id:int,replacement:string,message:string,opens:boolean,closes:boolean>>"


def _pieces(all_: Column) -> Column:
    """An edit as what it does in each run."""

    def of(e: Column) -> Column:
        one = lambda run, start, end, opens, closes: F.struct(run["run"].alias("run"), start.cast("int").alias("start"), end.cast("int").alias("end"), e["id"].alias("id"), e["replacement"].alias("replacement"), e["message"].alias("message"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
        a, b = e["first"], e["last"]
        two = F.array(one(a, e["start"] - a["start"], a["end"] - a["start"], True, False), one(b, F.lit(0), e["end"] - b["start"], False, True))
        return F.when(e["kind"] == "split", two).otherwise(F.array(one(a, e["start"] - a["start"], e["end"] - a["start"], True, True)))

    return F.flatten(F.transform(all_, of)).cast(PIECE)


def _sweep(run: Column, pieces: Column, review: Review) -> Column:
    """A run cut at its edits' ends."""
    date = "" if review.date is None else f' w:date="{review.date}"'
    author = review.author.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    properties = F.regexp_extract(run, rf"(?s)^<[^>]*>\s*({PROPERTIES})", 1)
    text = let(F.regexp_extract(run, f"(?s){TEXT}", 0), _inner)

    def written(z: Column) -> Column:
        said = lambda tag, t: F.concat(F.lit("<w:r>"), z["properties"], F.lit(f'<w:{tag} xml:space="preserve">'), escaped(t), F.lit(f"</w:{tag}></w:r>"))
        revised = lambda kind, tag, t: F.concat(F.lit(f'<w:{kind} w:id="{NEXT}" w:author="{author}"{date}>'), said(tag, t), F.lit(f"</w:{kind}>"))
        mark = lambda kind, p: F.concat(F.lit(f'<w:{kind} w:id="'), p["id"].cast("string"), F.lit('"/>'))
        opened = lambda p: mark("commentRangeStart", p)
        closed = lambda p: F.concat(F.when(F.coalesce(p["replacement"], F.lit("")) != "", revised("ins", "t", p["replacement"])).otherwise(""), mark("commentRangeEnd", p), F.lit("<w:r>"), z["properties"], mark("commentReference", p), F.lit("</w:r>"))
        joined = lambda some, make: F.array_join(F.transform(some, make), "")
        ps = z["pieces"]
        ends = F.concat(F.array(F.lit(0), F.length(z["text"])), F.transform(F.filter(ps, lambda p: p["opens"]), lambda p: p["start"]), F.transform(F.filter(ps, lambda p: p["closes"]), lambda p: p["end"]))

        def stretch(cuts: Column, o: Column, i: Column) -> Column:
            point = lambda p: p["opens"] & p["closes"] & (p["start"] == o) & (p["end"] == o)
            till = F.coalesce(F.get(cuts, i + 1), o)
            between = F.substr(z["text"], o + 1, till - o)
            gone = F.exists(ps, lambda p: p["replacement"].isNotNull() & (p["start"] <= o) & (till <= p["end"]))
            return F.concat(
                joined(F.filter(ps, lambda p: p["closes"] & (p["end"] == o) & ~(p["opens"] & (p["start"] == o))), closed),
                joined(F.filter(ps, point), lambda p: F.concat(opened(p), closed(p))),
                joined(F.filter(ps, lambda p: p["opens"] & (p["start"] == o) & ~(p["closes"] & (p["end"] == o))), opened),
                F.when(till == o, "").when(gone, revised("del", "delText", between)).otherwise(said("t", between)),
            )

        return let(F.array_sort(F.array_distinct(ends)), lambda cuts: F.array_join(F.transform(cuts, lambda o, i: stretch(cuts, o, i)), ""))

    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["id"] - b["id"])
    return let(F.struct(properties.alias("properties"), text.alias("text"), F.array_sort(pieces, order).alias("pieces")), written)


def _numbered(xml: Column) -> Column:
    return let(F.split(xml, NEXT, -1), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat((i - 1 + FIRST_REVISION).cast("string"), p))), ""))


def reviewed(edited: DataFrame, review: Review = Review(), xml: str = "xml", existing: str | None = None) -> DataFrame:
    """Adds to the rows of `edits`: `reviewed_xml`, the part with tracked changes and comments; `comments_xml`, the part of comments (with those of
    the column `existing`; null without any); and the counts `applied`, `maybe_applied`, `annotated`, `skipped`."""
    xml = F.coalesce(F.col(xml), F.lit(""))
    read = F.when(F.size("edits") > 0, xml).otherwise("")  # a part without edits stays as it is
    df = once(edited, __runs=F.regexp_extract_all(read, F.lit(RUN), F.lit(0)), __gaps=F.split(read, RUN, -1), __pieces=_pieces(F.col("edits")))
    one = lambda r, bare: F.struct(F.when(bare, 1).otherwise(F.regexp_count(r, F.lit(f"(?s){TEXT}"))).alias("n"), (bare | r.rlike(SIMPLE)).alias("simple"))
    texts = F.transform("__runs", lambda r: let(r.rlike(BARE), lambda bare: one(r, bare)))
    deeper = F.transform("__gaps", lambda g: F.when(g == "", 0).otherwise(F.regexp_count(g, F.lit(_tag("ins|del"))) - F.regexp_count(g, F.lit(_close("ins|del")))))
    df = once(df, __texts=texts)
    df = once(df, __from=offsets(F.transform("__texts", lambda t: t["n"])), __deep=offsets(deeper))
    described = F.transform("__texts", lambda t, k: F.struct(F.get(F.col("__from"), k).alias("from"), (F.get(F.col("__from"), k) + t["n"]).alias("till"), ((F.get(F.col("__deep"), k + 1) == 0) & t["simple"]).alias("simple")))
    df = once(df, __described=described)
    df = once(df, __closed=F.filter("__described", lambda d: ~d["simple"] & (d["from"] < d["till"])))
    void = F.array_distinct(F.transform(F.filter("__pieces", lambda p: F.exists("__closed", lambda d: (d["from"] <= p["run"]) & (p["run"] < d["till"]))), lambda p: p["id"]))
    df = once(df, __void=void)
    df = once(df, __left=F.filter("__pieces", lambda p: ~F.array_contains("__void", p["id"])))
    mine = lambda k: F.filter("__left", lambda p: p["run"] == F.get(F.col("__described"), k)["from"])
    df = once(df, __changed=F.array_distinct(F.transform("__left", lambda p: p["run"])))
    new_runs = F.transform("__runs", lambda r, k: F.when(F.array_contains("__changed", F.get(F.col("__described"), k)["from"]) & F.get(F.col("__described"), k)["simple"], _sweep(r, mine(k), review)).otherwise(r))
    whole = F.concat(F.element_at("__gaps", 1), F.array_join(F.zip_with(new_runs, F.slice("__gaps", F.lit(2), F.size("__runs")), lambda r, g: F.concat(r, g)), ""))
    # comments stand in the order in which they close
    ends = F.filter("__left", lambda p: p["closes"])
    closing = F.array_sort(F.transform(ends, lambda p: F.struct(p["run"].alias("run"), p["end"].alias("end"), (p["opens"] & (p["start"] == p["end"])).alias("point"), F.when(p["opens"], p["start"]).otherwise(0).alias("start"), p["id"].alias("id"), p["message"].alias("message"), p["replacement"].alias("replacement"))))
    df = once(df, reviewed_xml=_numbered(F.when(F.size("__left") > 0, whole).otherwise(xml)), __closing=closing)
    date = "" if review.date is None else f' w:date="{review.date}"'
    quoted = review.author.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    block = lambda c: F.concat(F.lit('<w:comment w:id="'), c["id"].cast("string"), F.lit(f'" w:author="{quoted}" w:initials="{review.initials()}"{date}><w:p><w:r><w:t xml:space="preserve">'), escaped(c["message"]), F.lit("</w:t></w:r></w:p></w:comment>"))
    blocks = F.array_join(F.transform("__closing", block), "")
    fresh = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:comments xmlns:w="{NAMESPACE}">'), blocks, F.lit("</w:comments>"))
    if existing is not None:
        head = F.substring_index(existing, "</w:comments>", 1)
        fresh = F.when(F.col(existing).contains("</w:comments>"), F.concat(head, blocks, F.substr(existing, F.length(head) + 1))).otherwise(fresh)
    notes = F.size(F.filter("__closing", lambda c: c["replacement"].isNull()))
    applied = F.size("__closing") - notes
    counts = {"applied": applied, "maybe_applied": F.least(F.col("n_maybe"), applied), "annotated": notes, "skipped": F.col("n_lost") + F.size("__void")}
    df = df.withColumn("comments_xml", F.when(F.size("__closing") > 0, fresh)).withColumns(counts)
    return df.drop("__runs", "__gaps", "__pieces", "__texts", "__from", "__deep", "__described", "__closed", "__void", "__left", "__changed", "__closing")


def _revision(kind: str, author: str) -> str:
    import re

    author = author.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    return rf'(?s)<w:{kind} [^>]*w:author="{re.escape(author)}"[^>]*>(.*?)</w:{kind}>'


def _without(xml: Column, kind: str, author: str, kept: str) -> Column:
    """A part without an author's revisions of a kind, of whose contents `kept` stays."""
    return let(xml, lambda z: F.when(z.contains(f"<w:{kind} "), F.regexp_replace(z, _revision(kind, author), kept)).otherwise(z))


def accepted(xml: Column, author: str) -> Column:
    """A part with all changes of an author accepted."""
    return _without(_without(xml, "del", author, ""), "ins", author, "$1")


def rejected(xml: Column, author: str) -> Column:
    """A part with all changes of an author rejected."""
    back = _without(_without(xml, "ins", author, ""), "del", author, "$1")
    return let(back, lambda z: F.when(z.contains("w:delText"), F.regexp_replace(z, r"(</?w:)delText\b", "$1t")).otherwise(z))


def max_comment(xml: Column) -> Column:
    """The largest number of a comment in a part of comments, 0 without."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r'<w:comment [^>]*?w:id="(\d+)"'), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(found), F.lit(0))
