"""Parsing, rules, directives, fixes and scores on small texts."""

import random

import pytest
from pyspark.sql import functions as F
from quillspark.functions.sentences import sentences
from quillspark.functions.markdown import markdown_blocks
from quillspark.functions.text import blocks
from quillspark.functions import text as text_functions
from quillspark.operators import evaluate, judge, lint, mining, sourcing
from quillspark.rules import loader, parts
from quillspark.rules.model import Options, Rule, RuleError, RuleSet
from quillspark.streaming.scores import score_monitor, stream_scores

DASHES = "a–b and 3–4"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences(spark):
    cases = {
        "One. Two.": 2, "See Smith v. Jones today. Next one.": 2, "Mr. Brown came. He left.": 2, "It is 3.5 wide. Yes.": 2, 'He said "Go." Then left.': 2, "What?! No way... Really.": 3, "U.S. Courts agree. Ok.": 2,
        "the 3rd. Circuit held. Ok": 2, "1. First item here.": 1, "x\n  (ii). Second. Third.": 2, "a. b. c": 1, "A. Smith wrote. B. Jones read.": 2, "no end": 1, "": 0, "Grün. Älter.": 2, "end.x Next": 1, "Version 2. Next": 2, "Wait... What": 2,
    }
    rows = frame(spark, *cases).select("text", sentences(F.col("text")).alias("s")).collect()
    for r in rows:
        assert len(r.s) == cases[r.text], r
        assert all(r.text[s.start : s.end] == s.text for s in r.s)


def test_blocks(spark):
    text = "  one\ntwo \n \t\n\n three 🙂\n\n"
    (r,) = frame(spark, text).select(blocks(F.col("text")).alias("b")).collect()
    assert [(b.start, b.end, b.text) for b in r.b] == [(2, 9, "one\ntwo"), (16, 23, "three 🙂")]


def test_scores(spark):
    hundred = " ".join(["word"] * 99) + " delve"
    docs = frame(spark, "", hundred, None)
    only = Options(enable=("no-ai-cliches",))
    got = {r.doc_id: r.score for r in lint.lint_scores(docs, options=only).collect()}
    assert got == {0: 100, 1: 74, 2: 100}


def test_spans_and_context(spark):
    docs = frame(spark, DASHES, "🙂 utilize; x\n\nUTILIZE Utilize")
    found = lint.diagnostics(docs, options=Options(enable=("no-en-dash", "prefer-short-words", "no-semicolons"))).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.start, r.end, r.line, r.column) for r in found] == [(0, 1, 2, 1, 2), (1, 2, 9, 1, 4), (1, 9, 10, 1, 11), (1, 14, 21, 3, 1), (1, 22, 29, 3, 9)]
    assert [r.replacement for r in found] == [None, "use", None, "USE", "Use"]


def test_fixes_and_directives(spark):
    text = "We utilize it.\nprose-disable-next-line prefer-short-words\n\nWe utilize it.\nprose-disable no-semicolons\na; purchase\nprose-enable\nb; c"
    rules = Options(enable=("no-semicolons", "prefer-short-words"))
    (fixed,) = lint.fixed(frame(spark, text), options=rules).collect()
    assert fixed.n_fixes == 2 and fixed.fixed_text.count("utilize") == 1 and "a; buy" in fixed.fixed_text
    found = lint.diagnostics(frame(spark, text, text + "\nprose-disable-file"), options=rules).collect()
    assert sorted((r.doc_id, r.line) for r in found) == [(0, 1), (0, 6), (0, 8)]


def test_openers_rhythm_length(spark):
    openers = "We a. We b. We c. We d."
    uniform = " ".join(["One two three four five six seven eight nine ten."] * 10)
    long = " ".join(["word"] * 46) + "."
    found = lint.diagnostics(frame(spark, openers, uniform, long), options=Options(enable=("no-repetitive-openers", "uniform-sentence-rhythm", "sentence-length"))).collect()
    assert [(r.rule_id, r.start) for r in found if r.doc_id == 0] == [("core/no-repetitive-openers", 12)]
    assert ("core/uniform-sentence-rhythm", 0) in [(r.rule_id, r.start) for r in found if r.doc_id == 1]
    assert [r.rule_id for r in found if r.doc_id == 2] == ["core/sentence-length"]


def test_density(spark):
    (r,) = lint.diagnostics(frame(spark, "perhaps " * 3 + "word " * 97), options=Options(enable=("no-hedging",))).collect()
    assert (r.weight, r.start) == (2, 0) and r.message.endswith("(3 occurrences in 100 words)")


def test_prose_scope(spark):
    rules = RuleSet((Rule("x", "phrase", scope="prose", patterns=("Smith",), package="p"),))
    docs = frame(spark, "See Smith v. Jones, 12 F.3d 345. Then Smith spoke.")
    assert [r.start for r in lint.diagnostics(docs, rules).collect()] == [38]


def test_markdown_blocks(spark):
    cases = {
        "# The Title\n\nBody paragraph here.\n": [("heading", "The Title"), ("paragraph", "Body paragraph here.")],
        "- first point\n- second point\n": [("item", "first point"), ("item", "second point")],
        "1. first item\n\n2. second item\n": [("item", "first item"), ("item", "second item")],
        "1. first item\n\n   more of it\n\nafter": [("item", "first item"), ("item", "more of it"), ("paragraph", "after")],
        "> Quoted holding\n> of the court.\n": [("quote", "Quoted holding\n> of the court.")],
        "Intro text.\n\n```rust\nlet x = 1;\n\n# no\n```\n\nOutro.\n": [("paragraph", "Intro text."), ("code", "```rust\nlet x = 1;\n\n# no\n```"), ("paragraph", "Outro.")],
        "Para.\n\n    let indented = true;\n\nAfter.\n": [("paragraph", "Para."), ("code", "    let indented = true;"), ("paragraph", "After.")],
        "> - nested point\n": [("item", "nested point")],
        "- item\n  > inner quote\n": [("item", "item"), ("quote", "inner quote")],
        "A *b* [c](https://d.e) f.\nLine two\n\nNext.\n": [("paragraph", "A *b* [c](https://d.e) f.\nLine two"), ("paragraph", "Next.")],
        "> # Quoted Heading\n": [("heading", "Quoted Heading")],
        "# Café—Ruling ##\n\nThe naïve—🙂 text.\n": [("heading", "Café—Ruling"), ("paragraph", "The naïve—🙂 text.")],
        "Before.\n\n---\n\n<div>\nraw html\n</div>\n\nAfter.\n": [("paragraph", "Before."), ("paragraph", "After.")],
        "Before.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nAfter.\n": [("paragraph", "Before."), ("paragraph", "After.")],
        "Title\n=====\ntext in\n2020. was written\n1. one": [("heading", "Title"), ("paragraph", "text in\n2020. was written"), ("item", "one")],
        "# H\n\npara one\n\n- li\n\n> q\n\n~~~\ncode": [("heading", "H"), ("paragraph", "para one"), ("item", "li"), ("quote", "q"), ("code", "~~~\ncode")],
        "": [],
        # items within items
        "- a\n  - b\n\n  c\n\nd": [("item", "a"), ("item", "b"), ("item", "c"), ("paragraph", "d")],
        "1.  one\n    - two\n      - three\n\n      more three\n\n    more two's item\n\n    still": [("item", "one"), ("item", "two"), ("item", "three"), ("item", "more three"), ("item", "more two's item"), ("item", "still")],
        "- a\n\n      code\n\n  # Head\n  > quoted\n\n- b": [("item", "a"), ("code", "    code"), ("heading", "Head"), ("quote", "quoted"), ("item", "b")],
        "- a\nlazy\n- b": [("item", "a\nlazy"), ("item", "b")],
        "- a\n\n> q\n\n  text": [("item", "a"), ("quote", "q"), ("paragraph", "text")],
        # definitions of link references
        "[a]: http://x.y 'T'\n[b c]: <u v>\nText [a].\n\n[d]: /only\n\nEnd": [("paragraph", "Text [a]."), ("paragraph", "End")],
        "[a]:\n  /long\n  \"over\n lines\"\nrest": [("paragraph", "rest")],
        "[a]: /x \"bad\" more\n[]: /y\n[b]: \n": [("paragraph", "[a]: /x \"bad\" more\n[]: /y\n[b]:")],
        "Text\n[a]: /no": [("paragraph", "Text\n[a]: /no")],
        "> [q]: /z\n> said\n\n- [i]: /w\n- [k]: /w\n  item": [("quote", "said"), ("item", "item")],
        "[a\\]b]: /x\n'title (not \n\nX": [("paragraph", "'title (not"), ("paragraph", "X")],
        "```\n[a]: /code\n```": [("code", "```\n[a]: /code\n```")],
    }
    for r in frame(spark, *cases).select("text", markdown_blocks(F.col("text")).alias("b")).collect():
        assert [(b.kind, r.text[b.start : b.end]) for b in r.b] == cases[r.text], r.text


def test_markdown_scopes(spark):
    text = "# utilize\n\nWe utilize it.\n\n```\nutilize code here\n```\n\n> utilize\n"
    docs = frame(spark, text, text).withColumn("markdown", F.col("doc_id") == 1)
    for scope, at in (("text", [2, 14, 56]), ("prose", [14]), ("all", [2, 14, 31, 56])):
        rules = RuleSet((Rule("x", "phrase", scope=scope, patterns=(r"(?i)\butilize\b",)),))
        found = lint.diagnostics(docs, rules).where("doc_id = 1").orderBy("ord").collect()
        assert [r.start for r in found] == at, scope
    assert {r.doc_id: r.words for r in lint.parse(docs).collect()} == {0: 8, 1: 5}


def test_rule_errors():
    for bad in ({"name": "X"}, {"engine": "none"}, {"patterns": ()}, {"severity": "fatal"}, {"direction": "above"}, {"scope": "here"}):
        with pytest.raises(RuleError):
            Rule(**({"name": "x", "engine": "phrase", "patterns": ("a",)} | bad))


def test_auc(spark):
    rows = [("ai", 3), ("ai", 2), ("human", 1), ("human", 2)]
    assert evaluate.auc(spark.createDataFrame(rows, "label string, value int")).first().auc == 0.875
    assert evaluate.auc(spark.createDataFrame(rows[:2], "label string, value int")).first().auc == 0.0


def test_split(spark):
    assert spark.range(1).select(evaluate.split_of(F.lit("pair"))).first()[0] == "test"


def test_grounding(spark):
    rules = [Rule("vague", "inferential", granularity="paragraph", rubric="Is it vague?")]
    asked = judge.requests(lint.parse(frame(spark, "Intro.\n\nThe quick brown fox jumps.")), rules)
    (r,) = asked.collect()
    answer = '```json\n[{"rule":"core/vague","quote":"quick brown fix jumps"},{"rule":"core/vague","quote":"Intro."},{"rule":"other","quote":"Intro."},{"rule":"core/vague","quote":"absent"}]\n```'
    found = judge.grounded(judge.parsed_answers(spark.createDataFrame([(r.cache_key, answer)], "cache_key string, answer string")), asked)
    assert [(x.status, x.start) for x in found.orderBy("ord").collect()] == [("grounded", 12), ("grounded", 0), ("foreign", None), ("not found", None)]


def test_places_of_altered_quotes(spark):
    import random

    draw = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    def plain(text, quote):
        if quote in text:
            return text.index(quote)
        far = [(distance(text[i : i + len(quote)], quote) / len(quote), i) for i in range(len(text) - len(quote) + 1)]
        return min(far)[1] if far and 1 - min(far)[0] >= judge.FUZZY_LEAST else None

    rows = []
    for _ in range(60):
        text = "".join(draw.choices("aab .+", k=draw.randint(20, 150)))
        at = draw.randrange(len(text) - 12)
        quote = list(text[at : at + draw.randint(10, 60)])
        for _ in range(draw.randint(0, 4)):
            quote[draw.randrange(len(quote))] = draw.choice("abé")
        rows.append((text, "".join(quote)))
    got = spark.createDataFrame(rows, "text string, quote string").select("text", "quote", judge._place(F.col("text"), F.col("quote")).alias("at")).collect()
    want = [plain(t, q) for t, q in rows]
    assert [r["at"] for r in got] == want and sum(w is not None for w in want) > 30


def test_sourcing(spark):
    page = "<html><script>x<y</script><p>One &amp; <b>two</b></p><!-- c --><p>7</p><p>three [1] four</p></html>"
    (r,) = frame(spark, page).select(sourcing.clean_lines(sourcing.html_text(F.col("text"))).alias("t")).collect()
    assert r.t == "One & two three four"
    odd = "a&mdash;b &sect; &#8212;&#x1F642; &amp;lt; &#xD800; &bogus;<script>never closed"
    (r,) = frame(spark, odd).select(sourcing.html_text(F.col("text")).alias("t")).collect()
    assert r.t.strip() == "a—b § —🙂 &lt; &#xD800; &bogus;"


def test_overlap_of_short_items(spark):
    items = spark.createDataFrame([(1, "one two three four five"), (2, "a b c d"), (3, "x y z u v w t s")], "item_id long, text string")
    docs = frame(spark, "zero One, two three FOUR five six", "x y z u v w t s", "a b c d")
    assert [tuple(r) for r in sourcing.short_overlap(docs, items).collect()] == [(1, 0)]
    assert [tuple(r) for r in sourcing.verbatim_overlap(docs, items).collect()] == [(3, 1, 1)]


def test_verdicts(spark):
    rows = [("core/empty-hedge", "No empty hedge here."), ("core/empty-hedge", "This hedge adds no information."), ("core/empty-hedge", "Not applicable."), ("x/y", "Nothing to flag."), ("core/empty-hedge", "It does not hedge.")]
    got = spark.createDataFrame(rows, "rule string, explanation string").select(judge.denied(F.col("explanation"), F.col("rule")), judge.negational(F.col("explanation"), F.col("rule"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (True, True), (False, True)]


def test_judged_scores(spark):
    scores = spark.createDataFrame([(1, 100, 5, 3.0), (2, 10, 1, 0.0)], "doc_id long, word_count int, sentence_count int, penalty double")
    rules = [Rule("vague", "inferential", granularity="paragraph")]
    judged = spark.createDataFrame([(1, "core/vague", "grounded", 0.8), (1, "core/vague", "denied", 0.9), (1, "core/vague", "grounded", 0.5)], "doc_id long, rule string, status string, confidence double")
    got = {r.doc_id: (r.n_judged, r.score) for r in judge.judged_scores(scores, judged, rules).collect()}
    assert got == {1: (1, 58), 2: (0, 100)}


def test_templates(spark):
    rule = Rule("swap", "phrase", patterns=((r"(?i)\b(\w+), (\w+)\b", "$2 $1$$"), ("Plain", "x$1")), templates=(0,), match_case=False)
    (r,) = lint.fixed(frame(spark, "Doe, john; Plain"), RuleSet((rule,))).collect()
    assert r.fixed_text == "john Doe$; x$1"
    with pytest.raises(RuleError):
        Rule("swap", "phrase", patterns=((r"(a)", "$2"),), templates=(0,))


def test_quantiles(spark):
    rows = [(float(i * i % 97),) for i in range(500)] + [(None,)]
    want = sorted(x for (x,) in rows if x is not None)
    got = {r.share: r.value for r in evaluate.quantiles(spark.createDataFrame(rows, "v double"), "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert got == {p: want[round(499 * p)] for p in (0.0, 0.1, 0.5, 0.99, 1.0)}


def test_corpus_stats(spark):
    r = mining.corpus_stats(frame(spark, "One, two, and three. Four; five — six.", None)).first()
    assert (r.files, r.sentences, r.semicolons, r.em_dashes, r.oxford_with) == (2, 2, 1, 1, 1)


def test_examples_of_rules(spark):
    rules = RuleSet((Rule("short", "phrase", patterns=((r"(?i)\butilize\b", "use"),), examples=(("We utilize it.", "We use it."), ("fine", "utilize"))),))
    got = {(r.example_ix, r.kind): r.ok for r in evaluate.rule_tests(spark, rules).collect()}
    assert got == {(0, "bad"): True, (0, "good"): True, (1, "bad"): False, (1, "good"): False}


def test_packages(tmp_path):
    rules = RuleSet((
        Rule("swap", "phrase", patterns=((r"(a)(b)", "$2$1"), ("x", "y"), "z"), templates=(0,), match_case=False, allow_context=("q", 2), examples=(("ab", "c"),), package="own"),
        Rule("long", "statistical", metric="sentence-length", max_words=9, package="own"),
    ))
    loader.write_package(tmp_path, "own", RuleSet((*rules.rules, Rule("gone", "phrase", patterns=("g",), package="own"))))
    loader.write_package(tmp_path, "own", rules)
    assert sorted(loader.load_package(tmp_path).rules, key=lambda r: r.name) == sorted(rules.rules, key=lambda r: r.name)
    with pytest.raises(RuleError):
        loader.parse_rule("id: x\nengine: phrase\npatterns: [{pattern: a, fix: b, fixTemplate: c}]", "own")


def test_mined_examples(spark):
    docs = frame(spark, "See Smith v. Jones use this. We use the standard form here.", "They use the other form there.")
    got = {r.name: (r.bad, r.good) for r in mining.synthesized(docs, mining.family_seeks()).collect()}
    assert got == {"no-utilize": ("We utilize the standard form here.", "We use the standard form here.")}
    rows = [(0, 0, "No Utilize!", "a"), (0, 1, "no-utilize", "b"), (1, 0, "--", "c"), (1, 1, "x", "")]
    got = mining.sanitized(spark.createDataFrame(rows, "lens_ix int, ix int, id string, pattern string")).collect()
    assert sorted((r.id, r.pattern) for r in got) == [("no-utilize", "a"), ("no-utilize-2", "b"), ("rule", "c")]


def test_stream(spark, tmp_path):
    frame(spark, "We utilize it.", "Fine.").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    scored = stream_scores(docs, keep=("doc_id", "at"))
    query = scored.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination()
    want = {r.doc_id: r.score for r in lint.lint_scores(frame(spark, "We utilize it.", "Fine.")).collect()}
    assert {r.doc_id: r.score for r in spark.table("scored").collect()} == want
    query = score_monitor(scored, "at").writeStream.format("memory").queryName("monitor").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination()
    assert [(r.n, r.mean_score) for r in spark.table("monitor").collect()] == [(2, sum(want.values()) / 2)]


def test_judged_findings_among_the_others(spark):
    text = "# Vague head\n\nWe utilize it.\n\nprose-disable-next-line vague\nperhaps so.\n\nSee Smith v. Jones, 12 F.3d 345."
    docs = frame(spark, text).withColumn("markdown", F.lit(True))
    rules = RuleSet((Rule("words", "phrase", patterns=((r"(?i)\butilize\b", "use"),)), Rule("vague", "inferential", granularity="paragraph", scope="prose"), Rule("loud", "inferential", granularity="paragraph")))
    place = lambda quote: (text.index(quote), text.index(quote) + len(quote))
    rows = [(0, "core/vague", "grounded", *place("Vague head"), "heading", 0.9, None), (0, "core/vague", "grounded", *place("We utilize"), "", 0.9, "We take"), (0, "core/vague", "grounded", *place("perhaps"), "off", 0.9, None)]
    rows += [(0, "core/loud", "grounded", *place("perhaps"), "on", 0.8, None), (0, "core/loud", "grounded", *place("it"), "low", 0.3, None), (0, "core/vague", "grounded", *place("See Smith"), "cited", 0.9, None), (0, "core/loud", "denied", *place("We"), "no", 0.9, None)]
    judged = spark.createDataFrame(rows, "doc_id long, rule string, status string, start int, end int, explanation string, confidence double, suggested_rewrite string")
    found = lint.merged(lint.find(docs, rules), judged, rules)
    got = lint.diagnostics(docs, found=found).orderBy("ord").collect()
    assert [(r.rule_id, r.message, r.applicability) for r in got] == [("core/vague", "Flagged by core/vague.", "maybe-incorrect"), ("core/words", "Words.", "machine-applicable"), ("core/loud", "on", None)]
    r = found.select(lint.penalty().alias("p"), lint.fixable(F.col("findings")).alias("sure"), lint.fixable(F.col("findings"), True).alias("all")).first()
    assert (round(r.p, 6), r.sure, r["all"]) == (round(3 * 0.9 + 3 + 3 * 0.8, 6), 1, 2)
    assert lint.fixed(docs, found=found).first().fixed_text == text.replace("utilize", "use")
    assert lint.fixed(docs, found=found, maybe=True).first().fixed_text == text.replace("We utilize", "We take")
    assert [x.fixed_text for x in lint.changed(frame(spark, "utilize", "fine"), rules).collect()] == ["use"]


def test_chunks_end_at_what_is_no_prose(spark):
    docs = frame(spark, "one\n\ntwo\n\n# head\n\nthree\n\n---\n\nfour", "one\n\ntwo").withColumn("markdown", F.col("doc_id") == 0)
    got = {r.doc_id: [(c.start, c.end) for c in r.chunks] for r in judge.chunks(lint.parse(docs)).collect()}
    assert got == {0: [(0, 8), (18, 23), (30, 34)], 1: [(0, 8)]}


def test_cache_and_statistics(spark, tmp_path):
    rules = [Rule("vague", "inferential", granularity="paragraph")]
    asked = judge.requests(lint.parse(frame(spark, "Intro text.", "Other text.")), rules)
    first = asked.where("doc_id = 0").select("cache_key", F.lit('[{"rule":"core/vague","quote":"Intro"},{"rule":"x/y","quote":"Intro"}]').alias("answer"))
    judge.write_answers(first, str(tmp_path / "cache"))
    judge.write_answers(first, str(tmp_path / "cache"))
    cache = judge.read_answers(spark, str(tmp_path / "cache"))
    assert cache.count() == 1 and judge.cache_misses(asked, cache).count() == 1
    checked = judge.grounded(judge.parsed_answers(cache), asked)
    got = {r.doc_id: (r.chunks, r.cache_hits, r.chunks_failed, r.grounded, r.hallucinated, r.first_failure is None) for r in judge.judge_stats(checked, asked, cache).collect()}
    assert got == {0: (1, 1, 0, 1, {"x/y": 1}, True), 1: (1, 0, 1, 0, None, False)}


def test_samples_and_gates(spark):
    docs = frame(spark, "\n\n".join(f"part {i} " + "x" * 60 for i in range(9)), "only one", "  ")
    got = mining.spread_sample(docs, "doc_id", slots=5, chars=70, budget=1000).collect()
    assert [(r.doc_id, r.slot, r.passage[:6]) for r in got] == [(1, 0, "only o"), (0, 0, "part 0"), (0, 1, "part 8")]
    rules = RuleSet((Rule("a", "phrase", patterns=("part",)), Rule("b", "phrase", patterns=("zeta",), examples=(("a zeta", "none"),)), Rule("c", "phrase", patterns=("eta",), examples=(("none", "none"),))))
    assert {r.rule_id: r.ok for r in mining.consistent(rules, docs).collect()} == {"core/a": False, "core/b": True, "core/c": False}


def test_messages_round_to_even(spark):
    """Two decimals of a value halfway between two are the even ones: 3.125 and 0.125."""
    docs = frame(spark, " ".join(["word"] * 316) + ". Red, green, and blue.", "Go on. " * 14 + "Stop. Go on now.")
    found = lint.diagnostics(docs, options=Options(enable=("triad-overuse", "uniform-sentence-rhythm"))).orderBy("doc_id").collect()
    assert [r.message for r in found] == ["Triad overuse. (3.12, threshold 2.00)", "Uniform sentence rhythm. (0.12, threshold 105.00)"]


def test_quick_patterns_match_alike(spark):
    """Patterns that stand for slower ones have the same matches, or as many, in texts made of what they look at."""
    rnd, bits = random.Random(7), ["a", "red", "İs", "is", "was", "been", "noted", "given", "and", "or", "AND", ",", ", ", " ", "  ", "\n", ".", ";", "’", "'", "-", "_", "5", "é", "é", "́", "–"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(3000)] + [" ".join(rnd.choice(["a", "red,", "and", "or", "is", "noted", "b", "c,"]) for _ in range(30)) for _ in range(1000)]
    df = frame(spark, *texts)
    for own, quick in parts._QUICK.items():
        spans = [text_functions.match_spans(F.col("text"), text_functions.java(p)) for p in (own, quick)]
        assert df.where(F.size(spans[0]) > 0).count() > 50 and df.where(~spans[0].eqNullSafe(spans[1])).count() == 0
    for own, quick in parts._AS_MANY.items():
        counts = [F.regexp_count("text", F.lit(text_functions.java(p))) for p in (own, quick)]
        assert df.where(counts[0] > 0).count() > 50 and df.where(counts[0] != counts[1]).count() == 0
    assert df.where(text_functions.word_count(F.col("text")) != F.regexp_count("text", F.lit(r"(?U)\b[\w'’-]+\b"))).count() == 0


def test_patterns_are_tried_where_all_they_need_is(spark):
    """A word that a pattern shares with most texts does not make it a candidate."""
    df = lint._with_candidates(frame(spark, "The people of that place, at the door.", "So in the age of tin.").withColumn("__t", F.col("text")), parts.parts([r for r in lint.core_rules().rules if r.name in ("prefer-concise-phrases", "no-marketing-language")]))
    assert [len(r["__at"]) for r in df.orderBy("doc_id").collect()] == [0, 1]


def test_scores_without_sentences(spark):
    """Where neither rules nor columns need sentences, the plan makes none."""
    df = lint.lint_scores(frame(spark, "We utilize it. It is new."), options=Options(enable=("prefer-short-words",)))
    told = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "is_citation" in told(df) and "is_citation" not in told(df.select("doc_id", "score"))
    assert [(r.sentence_count, r.n_findings) for r in df.collect()] == [(2, 1)]


def test_judged_findings_without_sentences(spark):
    """Where no judged rule looks at prose only, findings of a judge are placed without sentences."""
    judged = spark.createDataFrame([(0, "core/empty-hedge", "grounded", 3, 5, "vague", 0.9, None)], "doc_id long, rule string, status string, start int, end int, explanation string, confidence double, suggested_rewrite string")
    found = lint.find(frame(spark, "We do it. It is new."), options=Options(enable=("prefer-short-words",)), late=True)
    df = lint.merged(found, judged, lint.core_rules()).select("doc_id", "findings")
    assert "is_citation" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [[(f.start, f.end) for f in r.findings] for r in df.collect()] == [[(3, 5)]]


def test_word_lookups():
    cases = {
        r"(?i)\butili[sz]e\b": {"utilise", "utilize"}, r"(?i)\bgame[- ]changer\b": {"game", "changer"}, r"(?i)\bcomprehensive(?:ly)?\b": {"comprehensive", "comprehensively"},
        r"(?im)^\s*(Moreover|Furthermore),": {"moreover", "furthermore"}, r"(?i),\s*(?:showing|telling)\b\s+the\b": {"showing", "telling", "the"}, r"(?i)the catch\s*:": {"catch"},
    }
    for pattern, words in cases.items():  # no text is searched for parts of words
        assert {(s, whole) for need in parts.needed(pattern) for s, whole, _ in need} == {(w, True) for w in words}, pattern
    for pattern in (r"(?i)\bvis-?a", r"(?i)\brel[a-z]+\b", r"(?i)\bnon\w*\b", r"(?i)before"):
        assert not any(whole for need in parts.needed(pattern) for _, whole, _ in need), pattern


def test_spans_of_texts_that_hold_marks(spark):
    import re

    texts = ["ab\ufdd0ab b", "\ufdd2ab", "ab ab🙂ab", "none", "", "ab"]
    got = frame(spark, *texts).withColumn("p", F.lit("ab?")).select("text", text_functions.match_spans(F.col("text"), F.col("p")).alias("s")).collect()
    assert all([(s.start, s.end, s.text) for s in r.s] == [(*m.span(), m[0]) for m in re.finditer("ab?", r.text)] for r in got)


def test_free_stops(spark):
    from quillspark.functions import sentences as cut

    rng = random.Random(4)
    pieces = ["Prof", "prof", "e.g", "Sept", "septs", "words", "wordy", "A", "xA", "12th", "3", "\n(ii)", "iv", ".", ". ", "! ", "? ", '." ', " ", "Then", "(So", "7"]
    texts = ["".join(rng.choice(pieces) for _ in range(60)) for _ in range(300)]
    whole = cut.BOUNDARY.replace(f"(?:{cut._FREE}|(?!{cut._BLOCKED}))", f"(?!{cut._BLOCKED})")
    assert whole != cut.BOUNDARY
    assert frame(spark, *texts).where(F.regexp_replace("text", cut.BOUNDARY, "$0|") != F.regexp_replace("text", whole, "$0|")).count() == 0


def test_fixed_texts_search_for_fixes_only(spark):
    texts = ("In order to utilize it; we purchase – perhaps, due to the fact that it is late.", "prose-disable prefer-short-words\nWe utilize it In Order To go.", "Nothing here. Nothing there.", "")
    docs = frame(spark, *texts)
    fixed = lint.fixed(docs)
    assert sorted(fixed.collect()) == sorted(lint.fixed(docs, found=lint.find(docs)).collect())
    assert all(f.replacement is not None for r in lint.fixes(docs).collect() for f in r.findings)
    assert "sents" not in fixed._jdf.queryExecution().optimizedPlan().toString()


def test_led_patterns_match_alike(spark):
    """A look at the first letter changes no match, also of letters that count as ASCII ones without regard to case."""
    own = [p for r in lint.core_rules().rules for p, _ in r.pairs() if parts._led(p) != p]
    rng = random.Random(11)
    said = [w for p in own for w in ("".join(c if c.isalpha() else " " for c in p.replace(r"\b", " ").replace("(?i)", " "))).split()]
    odd = lambda w: "".join({"s": "ſ", "k": "K", "i": rng.choice("İıI")}.get(c, c.upper()) if rng.random() < 0.2 else c for c in w)
    texts = [p.replace("(?i)", "").replace(r"\b", rng.choice(["", " ", "x", "́"])) for p in own for _ in range(3)] + [" ".join(odd(rng.choice(said)) for _ in range(30)) for _ in range(100)]
    marked = lambda p: F.regexp_replace("text", text_functions.java(p), "<$0>")
    assert len(own) > 100
    for i in range(0, len(own), 40):
        wrong = F.array_compact(F.array(*(F.when(marked(p) != marked(parts._led(p)), F.lit(p)) for p in own[i : i + 40])))
        assert frame(spark, *texts).where(F.size(wrong) > 0).count() == 0
    assert all(parts._led(p) == p for p in (r"(?i)\b(?:un)?lock\b", r"(?i)\b\w+ly\b", r"(?i)\bété\b", r"\bword\b", r"(?i)\b[a-z]+"))


def test_openers_repeat(spark):
    """Sentences are folded for runs of openers only where so many in a row begin alike."""
    df = lint.parse(frame(spark, "We go. We see. We run.", "We go. We see. They run. We go.", "We go.\n\nWe see. We run.", "", "? ? ?"))
    assert [r[0] for r in df.orderBy("doc_id").select(lint._repeats(F.col("sents"), 3)).collect()] == [True, False, False, False, False]


def test_runs_that_matches_hold():
    assert [parts.held(p) for p in (r"\buse\b", r", ([^,;]{1,40}), (and|or)\b", r"(?i)\buse\b", r"\w+")] == [["use"], [", and", ", or"], [], []]
