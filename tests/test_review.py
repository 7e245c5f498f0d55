"""Reviews of Word documents: edits against a plain choice, changes accepted and rejected, packages part by part."""

import io
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from quillspark.operators import lint, review
from quillspark.operators.review import NAMESPACE, Review
from quillspark.plans.word_corpus import word_xml
from quillspark.sources import packages
from quillspark.sources.readers import word_text

HEAD, TAIL = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>', "</w:body></w:document>"
RELATIONS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="styles" Target="styles.xml"/></Relationships>'
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'


def t(text):
    text = text.replace("&", "&amp;").replace("<", "&lt;")
    return f'<w:t xml:space="preserve">{text}</w:t>'


def r(text, before=""):
    return f"<w:r>{before}{t(text)}</w:r>"


def parts(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, xml string")
    edits = review.edits(lint.find(review.projected(df)), Review(**how))
    return edits, review.reviewed(edits, Review(**how))


def test_projection(spark):
    known = [
        (r("Hello") + r(" world"), "Hello world", [(0, 5), (5, 11)]),
        ("<w:r><w:tab/><w:t>a</w:t><w:br/><w:t>b</w:t><w:cr/></w:r>", "\ta\nb\n", [(1, 2), (3, 4)]),
        ("<w:r><w:t/></w:r><w:r><w:t>café &amp; &lt;b&gt; &#233;&#x1F642;&amp;lt;</w:t></w:r>", "café & <b> é🙂&lt;", [(0, 0), (0, 17)]),
        ("<w:ins w:id='1'>" + r("added") + "</w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>" + r("tail"), "addedtail", [(0, 5), (5, 9)]),
        ("<w:r><w:t><![CDATA[a < b]]></w:t></w:r>", "a < b", [(0, 5)]),
    ]
    rows = [(i, f"{HEAD}<w:p>{x}</w:p>{TAIL}") for i, (x, _, _) in enumerate(known)] + [(98, None), (99, "")]
    got = {x.doc_id: x for x in review.projected(spark.createDataFrame(rows, "doc_id long, xml string")).collect()}
    for i, (_, text, runs) in enumerate(known):
        assert got[i].text == text + "\n\n" and [(x.start, x.end) for x in got[i].runs] == runs
        assert [x.run for x in got[i].runs] == list(range(len(runs)))
        assert text + "\n\n" == word_text(package({"word/document.xml": rows[i][1]}))
    assert got[98].text == got[99].text == ""


def test_text_of_a_part_alone(spark):
    """`said` gives the text of `projected`, also of odd parts: tags in texts, character data, references, prefixes, closing tags with blanks."""
    rows = ["", None, "<w:t/>", "</w:p>", "plain", "<w:t>a<b>c</w:t><w:t>d</w:t>", "<w:t><![CDATA[x<y]]></w:t>", "<w:t>&am</w:t><w:t>p;</w:t>", "<w:t>&amp;lt; &#65;</w:t></w:p><w:tab/>", "<w:t>\t</w:t><w:br/><w:cr w:x='1'/><w:t></w:t></w:p ><t a='>'>z</t >", "<w:t>a > b</w:t><w:t a='<'>q</w:t>", "<w:tabs/><w:delText>no</w:delText><w:t>yes</w:t>", "<w:t>x<w:t>y</w:t></w:p>"]
    said = ["", "", "", "\n\n", "", "a<b>cd", "x<y", "&amp;", "&lt; A\n\n\t", "\t\n\n\n\n'>z", "a > bq", "yes", "x<w:t>y\n\n"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, xml string")
    got = review.projected(df).withColumn("said", review.said(F.col("xml"))).orderBy("doc_id").collect()
    assert [x.said for x in got] == [x.text for x in got] == said
    assert all(x.text[y.start : y.end] for x in got for y in x.runs if y.start < y.end)


def package(held):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in held.items():
            z.writestr(name, data)
    return out.getvalue()


def plain_edits(text, runs, findings):
    """(id, kind, start, end) one candidate after the other."""
    fixes = sorted((f.start, f.end, i) for i, f in enumerate(findings) if f.replacement is not None)
    notes = sorted((f.start, f.end, i) for i, f in enumerate(findings) if f.replacement is None and f.start < f.end)
    out, guard, lost = [], 0, 0
    for group in (fixes, notes):
        for a, b, i in group:
            first = next((x.run for x in runs if x.start <= a < x.end), None)
            last = next((x.run for x in runs if x.start < b <= x.end), None)
            if first is None or last is None:
                lost += 1
                continue
            kind = "redline" if group is fixes and first == last and a >= guard else "comment" if first == last else "split"
            guard = b if kind == "redline" else guard
            out.append((len(out) + 1, kind, a, b, first, last, findings[i].replacement if kind == "redline" else None))
    return out, lost


WORDS = ["utilize", "in order to", "due to the fact that", "a;", "tapestry", "delve", "plain", "R&D <x>", "Numerous", "approximately\tnow", "é🙂"]


def some_documents(n):
    draw = random.Random(11)
    rows = []
    for i in range(n):
        body = ""
        for _ in range(draw.randint(1, 3)):
            text = " ".join(draw.choices(WORDS, k=draw.randint(1, 25)))
            cuts = sorted(draw.sample(range(len(text) + 1), min(len(text), draw.randint(0, 6))))
            cells = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            body += "<w:p><w:pPr><w:tabs><w:foo/></w:tabs></w:pPr>"
            for c in cells:
                kind = draw.random()
                body += f'<w:ins w:id="1" w:author="else">{r(c)}</w:ins>' if kind < 0.1 else f"<w:r>{t(c)}<w:br/></w:r>" if kind < 0.2 else "<w:r>" + t(c[:2]) + t(c[2:]) + "</w:r>" if kind < 0.3 else r(c, "<w:rPr><w:b/></w:rPr>") if kind < 0.6 else r(c)
            body += "</w:p>"
        rows.append((i, HEAD + body + TAIL))
    return rows


def test_against_plain(spark):
    """The choice of edits, what becomes of them, and texts with everything accepted and rejected."""
    rows = some_documents(60)
    edits, done = parts(spark, rows)
    chosen = {x.doc_id: x for x in edits.collect()}
    author = Review().author
    both = done.select("doc_id", "reviewed_xml", "comments_xml", "applied", "annotated", "skipped", review.accepted(F.col("reviewed_xml"), author).alias("yes"), review.rejected(F.col("reviewed_xml"), author).alias("no"))
    kinds = set()
    for x in both.collect():
        e = chosen[x.doc_id]
        want, lost = plain_edits(e.text, e.runs, e.findings)
        assert [(z.id, z.kind, z.start, z.end, z.first.run, z.last.run, z.replacement) for z in e.edits] == want and e.n_lost == lost
        marked = ElementTree.fromstring(x.reviewed_xml)
        find = lambda tag: [z.get(f"{{{NAMESPACE}}}id") for z in marked.iter(f"{{{NAMESPACE}}}{tag}")]  # noqa: E731, B023
        starts, ends, told = find("commentRangeStart"), find("commentRangeEnd"), find("commentReference")
        assert sorted(starts) == sorted(ends) == sorted(told) and len(set(starts)) == len(starts) == x.applied + x.annotated
        comments = [] if x.comments_xml is None else [z.get(f"{{{NAMESPACE}}}id") for z in ElementTree.fromstring(x.comments_xml)]
        assert comments == ends and x.applied + x.annotated + x.skipped == len(want) + lost
        revisions = [z for z in find("ins") + find("del") if int(z) >= review.FIRST_REVISION]
        assert sorted(map(int, revisions)) == list(range(review.FIRST_REVISION, review.FIRST_REVISION + len(revisions)))
        assert word_text(package({"word/document.xml": x.no})) == e.text
        held, text = set(map(int, starts)), e.text
        for _, kind, a, b, _, _, fix in sorted((w for w in want if w[0] in held), key=lambda w: -w[2]):
            kinds.add(kind)
            if kind == "redline":
                text = text[:a] + fix + text[b:]
        assert word_text(package({"word/document.xml": x.yes})) == text
    assert kinds == {"redline", "comment", "split"}


def test_a_comment_inside_a_change(spark):
    """A change is cut where another finding's comment ends inside it; both ends of a comment over a closed run go."""
    _, done = parts(spark, [(1, f"{HEAD}<w:p>{r('We utilize it.')}</w:p>{TAIL}")])
    x = done.withColumn("edits", F.expr("transform(array(named_struct('a', 3, 'b', 10, 'r', 'use'), named_struct('a', 5, 'b', 12, 'r', null)), (z, i) -> named_struct('id', i + 1, 'start', z.a, 'end', z.b, 'replacement', z.r, 'message', 'm & n', 'kind', 'comment', 'first', runs[0], 'last', runs[0], 'maybe', false))"))
    x = review.reviewed(x.drop("reviewed_xml", "comments_xml", *packages.COUNTS), Review("A B", "2026-01-02T03:04:05Z")).first()
    inner = x.reviewed_xml.split("<w:p>")[1]
    assert inner.index('Start w:id="1"') < inner.index(">ut<") < inner.index('Start w:id="2"') < inner.index(">ilize<") < inner.index(">use<") < inner.index('End w:id="1"') < inner.index("> i<") < inner.index('End w:id="2"')
    assert 'w:initials="AB" w:date="2026-01-02T03:04:05Z"' in x.comments_xml and "m &amp; n" in x.comments_xml
    assert (x.applied, x.annotated) == (1, 1)


def test_packages(spark, tmp_path):
    held = {"[Content_Types].xml": TYPES, "word/_rels/document.xml.rels": RELATIONS, "word/media/a.bin": bytes(range(256)), "word/document.xml": f"{HEAD}<w:p>{r('We utilize it; now.')}</w:p>{TAIL}", "docProps/x": b""}
    old = '<w:comments xmlns:w="x"><w:comment w:id="41" w:author="z"/></w:comments>'
    clean = held | {"word/document.xml": f"{HEAD}<w:p>{r('Nothing here.')}</w:p>{TAIL}"}
    files = [("a.docx", package(held)), ("b.docx", package(held | {"word/comments.xml": old})), ("c.docx", package(clean)), ("d.docx", b"no zip"), ("e.docx", package({"x": b""})), ("f.docx", None)]
    df = spark.createDataFrame(files, "path string, content binary").repartition(3)
    got = {x.path: x for x in packages.reviewed_packages(df).collect()}
    for name, data in files[2:]:
        assert got[name].content == data and got[name].applied + got[name].annotated == 0
    assert got["d.docx"].error and got["e.docx"].error and not got["c.docx"].error
    for name in ("a.docx", "b.docx"):
        new, was = packages.parts_of(bytes(got[name].content)), packages.parts_of(dict(files)[name])
        changed = {k for k in new if new[k] != was.get(k)}
        assert changed == {"word/document.xml", "word/comments.xml", packages.TYPES, packages.RELATIONS} and list(new)[: len(was)] == list(was)
        assert b'Id="rId8"' in new[packages.RELATIONS] and new[packages.TYPES].count(b"comments.xml") == 1
        assert (got[name].applied, got[name].annotated, got[name].skipped) == (1, 2, 0) or got[name].applied == 1
    assert b'w:id="41"' in packages.parts_of(bytes(got["b.docx"].content))["word/comments.xml"] and b'w:id="42"' in packages.parts_of(bytes(got["b.docx"].content))["word/comments.xml"]
    # once more, with the parts already declared; and to files and back
    again = packages.reviewed_packages(spark.createDataFrame([("b.docx", bytes(got["b.docx"].content))], "path string, content binary")).first()
    parts_ = packages.parts_of(bytes(again.content))
    assert parts_[packages.TYPES].count(b"comments.xml") == 1 and parts_[packages.RELATIONS].count(b"comments.xml") == 1
    out = str(tmp_path / "out")
    wrote = packages.write_files(packages.reviewed_packages(df).select(F.concat(F.lit("sub/"), "path").alias("name"), "content").where("content is not null"), out)
    assert wrote.count() == 5 and wrote.count() == 5  # running twice does no harm
    back = {x.path.rsplit("/", 1)[1]: bytes(x.content) for x in packages.read_packages(spark, out).collect()}
    assert back == {k: bytes(x.content) for k, x in got.items() if x.content is not None}
    with pytest.raises(Exception, match="no name"):
        packages.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), out).collect()


def test_the_corpus_of_queries(spark):
    texts = ["We utilize it;\n\nin order to\tsee & <go>\n  so", "", " ", "\n\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, said string").select("doc_id", "said", word_xml(F.coalesce("said", F.lit(""))).alias("xml"))
    assert all(x.text == (x.said or "") + "\n\n" for x in review.projected(df).collect())
    edits = review.edits(lint.find(review.projected(df.limit(0))))
    assert review.reviewed(edits).collect() == []


def test_runs_are_looked_up_by_their_beginnings(spark):
    """Of many runs, some of them empty, the same are found as by going through all."""
    runs = [(i, 3 * i + (i > 20), 3 * i + (i > 20) + (0 if i == 17 else 2)) for i in range(70)]
    spans = [(s, s + n) for s in range(0, 214) for n in (0, 1, 2, 4)]
    df = spark.createDataFrame([(1, [dict(zip(("run", "start", "end"), r)) for r in runs], "x" * 220, [(s, e, 0, 0, "r", "warning", "hard", "style", "m", 1, "y", None) for s, e in spans])], f"doc_id long, runs array<struct<run:int,start:int,end:int>>, __t string, findings {lint.FINDING}")
    (row,) = review.edits(df).select("edits").collect()
    want = []
    for s, e in sorted(spans):
        at = [r for r, a, b in runs if a <= s and e <= b]
        first, last = (at, at) if s == e else ([r for r, a, b in runs if a <= s < b], [r for r, a, b in runs if a < e <= b])
        want += [(s, e, first[0], last[0])] if first and last else []
    assert [(x.start, x.end, x.first.run, x.last.run) for x in row.edits] == want
