"""Blocks of Markdown text, as one array expression over its lines.

A fold over the lines keeps what is open: a paragraph with its kind, a fence, a
table or raw HTML, and how far the texts of the open list items are indented, one within
the other. A line first goes to the innermost item that it is indented for; the
markers of quotes and items are taken off what is left by one pattern, and what follows
them decides. Tables, raw HTML and breaks give no block; code keeps its fences.
Definitions of link references at a block's beginning are no text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, offsets

BLOCK = "array<struct<start:int,end:int,kind:string>>"
PROSE = ("paragraph", "item")
_STATE = f"struct<kind:string,start:int,end:int,fence:string,skip:string,indents:array<int>,out:{BLOCK}>"
_ITEM = r"(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]+|$)"
_BREAK = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
# Elements that open raw HTML.
_HTML = (
    r"(?i)^ {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    r"h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|pre|script|search|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$))"
)
_MARKS = rf"^(?: {{0,3}}(?:>[ ]?|{_ITEM}))*"
#: The definition of a link reference: a label, a destination and perhaps a title, at the latest on the lines after it.
_LABEL = r"\[(?=[^\]]*[^\s\]])[^\[\]\\]*(?:\\.[^\[\]\\]*)*\]:"
_TARGET = r"[ \t]*\n?(?: {0,3}>[ ]?)*[ \t]*(?:<[^<>\n\\]*(?:\\.[^<>\n\\]*)*>|(?!<)[^\s\x00-\x1f]+)"
_TITLE = r"""(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|\([^()\\]*(?:\\.[^()\\]*)*\))(?=[ \t]*(?:\n|\z)))?"""
_DEFINITIONS = rf"(?s)^(?:(?: {{0,3}}>[ ]?)*[ \t]*{_LABEL}{_TARGET}{_TITLE}[ \t]*(?:\n|\z))+"
_ROW = r"^ {0,3}(?=.*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"


def _lines(text: Column) -> Column:
    """array of (at, quotes, marks, rest, next) of the lines: the quote marks of a line, all its marks, and what follows them."""

    def marked(raw: Column) -> Column:
        at = offsets(F.transform(raw, lambda x: F.length(x) + 1))

        def one(x: Column, o: Column) -> Column:
            line = F.regexp_replace(x, r"\r$", "")
            quotes = F.regexp_extract(line, r"^(?: {0,3}>[ ]?)*", 0)
            inner = F.substr(line, F.length(quotes) + 1)
            marks = F.when(inner.rlike(_BREAK), quotes).otherwise(F.regexp_extract(line, _MARKS, 0))
            return F.struct(o.alias("at"), marks.alias("marks"), F.substr(line, F.length(marks) + 1).alias("rest"), F.length(line).alias("size"))

        return F.zip_with(raw, at, one)

    return let(F.split(text, "\n", -1), marked)


def markdown_blocks(text: Column) -> Column:
    """array of (start, end, kind): kind is heading, paragraph, item, quote or code."""
    nothing = F.lit(None).cast("string")
    zero = F.struct(nothing.alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), nothing.alias("fence"), nothing.alias("skip"), F.array().cast("array<int>").alias("indents"), F.array().cast(BLOCK).alias("out")).cast(_STATE)

    def state(kind: Column, start: Column, end: Column, fence: Column, skip: Column, indents: Column, out: Column) -> Column:
        return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), fence.alias("fence"), skip.alias("skip"), indents.alias("indents"), out.alias("out")).cast(_STATE)

    def block(start: Column, end: Column, kind: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["kind"].isNotNull() & (acc["end"] > acc["start"]), F.array_append(acc["out"], block(acc["start"], acc["end"], acc["kind"]))).otherwise(acc["out"])

    def within(acc: Column, x: Column) -> Column:
        """A line as the innermost open item that it is indented for sees it: at, marks, shift (where its text begins), rest, size, row, open (those items)."""
        own = x["marks"] == ""
        lead = F.when(own, F.length(x["rest"]) - F.length(F.regexp_replace(x["rest"], r"^ +", ""))).otherwise(F.length(F.regexp_extract(x["marks"], "^ *", 0)))

        def seen(z: Column) -> Column:
            rest = F.substr(x["rest"], z["depth"] + 1)
            more = F.when(~rest.rlike(_BREAK), F.regexp_extract(rest, _MARKS, 0)).otherwise("")
            inner = F.when(own & (z["depth"] > 0), more).otherwise("")
            return let(inner, lambda m: F.struct(
                x["at"].alias("at"), F.when(own, m).otherwise(x["marks"]).alias("marks"), F.when(own, z["depth"] + F.length(m)).otherwise(F.length(x["marks"])).alias("shift"),
                F.when(own, F.substr(rest, F.length(m) + 1)).otherwise(x["rest"]).alias("rest"), x["size"].alias("size"), x["row"].alias("row"), z["open"].alias("open"),
            ))

        usable = F.filter(acc["indents"], lambda i: i <= lead)
        return let(usable, lambda u: let(F.struct(u.alias("open"), F.when(own, F.coalesce(F.array_max(u), F.lit(0))).otherwise(0).alias("depth")), seen))

    def step(acc: Column, x: Column) -> Column:
        rest = x["rest"]
        lead = F.length(rest) - F.length(F.regexp_replace(rest, r"^[ \t]+", ""))
        body = x["at"] + x["shift"] + lead
        end = x["at"] + x["shift"] + F.length(F.regexp_replace(rest, r"(?U)\s+$", ""))
        whole = x["at"] + x["size"]
        blank = ~rest.rlike(r"(?U)\S")
        fence = F.nullif(F.regexp_extract(rest, r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1), F.lit(""))
        closing = F.regexp_extract(rest, r"^ {0,3}(`{3,}|~{3,})[ \t]*$", 1)
        closes = F.startswith(closing, acc["fence"])
        item = x["marks"].rlike(rf"{_ITEM}[ \t]*$") & ~x["marks"].rlike(r">[ ]?$")
        quote = x["marks"].rlike(r">[ ]?$")
        # a numbered item that is not the first does not break into a paragraph
        number = F.regexp_extract(x["marks"], r"^ {0,3}([0-9]{1,9})[.)]", 1)
        running = acc["kind"].isNotNull() & (acc["kind"] != "code")
        late = running & (acc["kind"] == "paragraph") & (number != "") & (number != "1")
        starts = item & ~late
        inside = (F.size(x["open"]) > 0) & (x["marks"] == "")
        # where an item's text begins, further text of it is indented as far
        indents = F.when(starts, F.array_append(x["open"], x["shift"])).when(running & (x["marks"] == "") & ~inside, acc["indents"]).otherwise(x["open"])
        kind = F.when(starts, "item").when(quote, "quote").when(inside, "item").otherwise("paragraph")
        far = lead >= 4
        heading = F.regexp_extract(rest, r"^ {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$", 1)
        is_heading = rest.rlike(r"^ {0,3}#{1,6}(?:[ \t]|$)")
        title = x["at"] + x["shift"] + F.length(F.regexp_extract(rest, r"^ {0,3}#{1,6}[ \t]*", 0))
        out = flushed(acc)
        none = F.lit(None).cast("string")
        closed = state(none, F.lit(0), F.lit(0), none, none, indents, out)
        in_fence = F.when(closes, state(none, F.lit(0), F.lit(0), none, none, acc["indents"], F.array_append(acc["out"], block(acc["start"], whole, F.lit("code"))))).otherwise(
            state(F.lit("code"), acc["start"], whole, acc["fence"], none, acc["indents"], acc["out"])
        )
        at_blank = F.when(acc["kind"] == "code", acc).otherwise(state(none, F.lit(0), F.lit(0), none, none, acc["indents"], out))
        more_code = state(F.lit("code"), acc["start"], whole, none, none, acc["indents"], acc["out"])
        new_code = state(F.lit("code"), x["at"] + x["shift"], whole, none, none, acc["indents"], out)
        goes_on = running & ~starts & ~(quote & (acc["kind"] != "quote"))
        text_on = F.when(goes_on, state(acc["kind"], acc["start"], end, none, none, acc["indents"], acc["out"])).otherwise(state(kind, body, end, none, none, indents, out))
        return (
            F.when(acc["fence"].isNotNull(), in_fence)
            .when(blank & ~starts, at_blank)
            .when(acc["skip"].isNotNull(), acc)
            .when(far & (acc["kind"] == "code"), more_code)
            .when(far & ~running, new_code)
            .when(fence.isNotNull(), state(F.lit("code"), body, whole, fence, none, indents, out))
            .when(is_heading, state(none, F.lit(0), F.lit(0), none, none, indents, F.when(heading != "", F.array_append(out, block(title, title + F.length(heading), F.lit("heading")))).otherwise(out)))
            .when(running & ~starts & rest.rlike(r"^ {0,3}(?:=+|-+)[ \t]*$"), state(none, F.lit(0), F.lit(0), none, none, acc["indents"], F.array_append(acc["out"], block(acc["start"], acc["end"], F.lit("heading")))))
            .when(rest.rlike(_BREAK), closed)
            .when(rest.rlike(_HTML), state(none, F.lit(0), F.lit(0), none, F.lit("html"), indents, out))
            .when(~running & F.contains(rest, F.lit("|")) & x["row"], state(none, F.lit(0), F.lit(0), none, F.lit("table"), indents, out))
            .otherwise(text_on)
        )

    def folded(lines: Column) -> Column:
        with_next = F.transform(lines, lambda x, i: F.struct(x["at"].alias("at"), x["marks"].alias("marks"), x["rest"].alias("rest"), x["size"].alias("size"), F.coalesce(F.get(lines, i + 1)["rest"].rlike(_ROW), F.lit(False)).alias("row")))
        return F.aggregate(with_next, zero, lambda acc, x: let(acc, lambda a: let(within(a, x), lambda y: step(a, y))), flushed)

    def undefined(b: Column) -> Column:
        """A block behind the definitions that it begins with, as an array, empty if nothing is left."""
        said = F.substr(text, b["start"] + 1, b["end"] - b["start"])
        head = F.length(F.regexp_extract(said, _DEFINITIONS, 0))

        def left(n: Column) -> Column:
            more = n + F.length(F.regexp_extract(F.substr(said, n + 1), r"(?U)^(?: {0,3}>[ ]?)*\s*", 0))
            return F.when(n == 0, F.array(b)).when(more >= b["end"] - b["start"], F.array().cast(BLOCK)).otherwise(F.array(block(b["start"] + more, b["end"], b["kind"])))

        return F.when(b["kind"].isin("paragraph", "item", "quote"), let(head, left)).otherwise(F.array(b)).cast(BLOCK)

    found = let(_lines(text), folded)
    return F.when(text.contains("]:"), F.flatten(F.transform(found, undefined))).otherwise(found)
