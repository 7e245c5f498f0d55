"""Rule files of the published form: front matter, pattern messages, instructions and examples in the body, all problems at once."""

import pytest
from quillspark.operators import lint
from quillspark.rules import loader
from quillspark.rules.model import Rule, RuleError, RuleSet

JUDGED = """---
id: vague
engine: inferential
severity: warning
granularity: sentence
description: "Vague."
examples: {bad: "b", good: "g"}
---
Flag what is vague.

## When
Always.

## Flag examples
- "It depends."
* Perhaps so.
-   Some say.

text between is left out
## PASS examples
- It is red.
- It is ten.
- It is so.
"""
PHRASE = """---
id: no-dash
engine: phrase
scope: text
severity: error
intent: style
rationale: "Why."
docs: https://example.org/x
message: "No dash."
# a comment
patterns:
  - '–'
  - pattern: '—+'
    message: "No long dash."
    suggestion: "Use a comma."
    fix: ","
---
Long words about dashes.
"""


def test_bodies():
    rule = loader.parse_rule(JUDGED, "own")
    assert rule.flags == ('"It depends."', "Perhaps so.", "Some say.") and rule.passes == ("It is red.", "It is ten.", "It is so.")
    assert rule.rubric == "Flag what is vague.\n\n## When\nAlways." and rule.examples == (("b", "g"),) and rule.description == "Vague."
    hard = loader.parse_rule(PHRASE, "own")
    assert hard.explanation == "Long words about dashes." and hard.messages == ((1, "No long dash."),) and hard.pairs() == [("–", None), ("—+", ",")]
    assert (hard.rationale, hard.docs) == ("Why.", "https://example.org/x")


@pytest.mark.parametrize(
    ("change", "field"),
    [
        (("* Perhaps so.\n", ""), "flag_examples"), (("- It is ten.\n", ""), "pass_examples"), (("severity: warning", "severity: error"), "severity"), (("granularity: sentence\n", ""), "granularity"),
        (("---\nFlag", "Flag"), "front matter"), (("id: vague", "id: ["), "front matter"), (("description", "unknown"), "unknown"), (("Flag what is vague.\n\n## When\nAlways.\n", ""), "rubric"),
    ],
)
def test_problems(change, field):
    with pytest.raises(RuleError) as e:
        loader.parse_rule(JUDGED.replace(*change), "own", "rules/x.md")
    assert e.value.field == field


def test_all_problems_at_once():
    bad = PHRASE.replace("engine: phrase", "engine: none")
    files = [("a.md", JUDGED), ("b.md", bad), ("c.md", PHRASE), ("d.md", PHRASE), ("e.md", PHRASE.replace("suggestion:", "advice:"))]
    found = loader.problems("own", files)
    assert [f for f, _ in found] == ["b.md", "d.md", "e.md"] and "c.md" in found[1][1]
    assert loader.problems("own", [("a.md", JUDGED), ("c.md", PHRASE)]) == []


def test_written_and_read_again(tmp_path):
    rules = RuleSet((loader.parse_rule(JUDGED, "own"), loader.parse_rule(PHRASE, "own"), Rule("plain", "phrase", patterns=("x",), package="own")))
    loader.write_package(tmp_path, "own", rules)
    assert sorted(loader.load_package(tmp_path).rules, key=lambda r: r.name) == sorted(rules.rules, key=lambda r: r.name)


def test_messages_of_patterns(spark):
    rules = RuleSet((loader.parse_rule(PHRASE, "own"),))
    docs = spark.createDataFrame([(1, "a – b — c")], "doc_id long, text string")
    assert [(r.message, r.replacement) for r in lint.diagnostics(docs, rules).orderBy("ord").collect()] == [("No dash.", None), ("No long dash.", ",")]
