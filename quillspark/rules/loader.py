"""Rule packages from files: a manifest `style.yaml` and `rules/*.md` with YAML front matter."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from .model import Rule, RuleError, RuleSet

_TEXTS = ("description", "rationale", "docs", "explanation")
_FIELDS = {
    "id", "engine", "severity", "intent", "threshold", "metric", "direction", "granularity", "message", "patterns", "params", "allow_context", "match_case", "scope", "examples", "docs_url", "rubric", "tier",
    "flag_examples", "pass_examples", *_TEXTS,
}
_PATTERN_FIELDS = {"pattern", "message", "suggestion", "fix", "fixTemplate", "fix_template"}
#: Of the examples that a judge is shown there are at least so many of either kind.
LEAST_SHOWN = 3
# Headings of a body's lists of examples, and the fields that they stand for.
SECTIONS = {"flag examples": "flag_examples", "pass examples": "pass_examples"}


def sections(body: str) -> tuple[str, dict[str, list[str]]]:
    """A judge's instructions and the items under the headings of `SECTIONS`; other headings belong to the instructions."""
    rest: list[str] = []
    found: dict[str, list[str]] = {name: [] for name in SECTIONS.values()}
    at = None
    for line in body.splitlines():
        heading = re.match(r"## (.*)", line)
        if heading:
            at = SECTIONS.get(heading[1].strip().lower())
        if at is None:
            rest.append(line)
        elif item := re.match(r"\s*[-*] +(\S.*?)\s*\Z", line):
            found[at].append(item[1])
    return "\n".join(rest).strip(), found


def _head(text: str, file: str) -> tuple[dict, str]:
    """Fields and body of a rule's file; bare YAML counts as front matter."""
    found = re.match(r"\s*---[^\S\n]*\n(.*?)^---[^\S\n]*(?:\n(.*))?\Z", text, re.S | re.M)
    if not found and text.lstrip().startswith("---"):
        raise RuleError(file, "front matter", text.strip()[:40], "closed by a line ---")
    try:
        fields = yaml.safe_load(found[1] if found else text)
    except yaml.YAMLError as e:
        raise RuleError(file, "front matter", str(e).replace("\n", " "), "YAML") from e
    if not isinstance(fields, dict):
        raise RuleError(file, "front matter", text[:40], "a mapping")
    return fields, (found[2] or "") if found else ""


def parse_rule(text: str, package: str, file: str = "rule") -> Rule:
    """A rule from its file's text. The body of a rule that is judged holds its instructions and examples, that of another its explanation;
    fields win over the body."""
    fields, body = _head(text, file)
    for name in fields:
        if name not in _FIELDS:
            raise RuleError(file, name, fields[name], sorted(_FIELDS))
    listed = [{"pattern": p} if isinstance(p, str) else p for p in fields.get("patterns") or ()]
    for n, p in enumerate(listed):
        unknown = set(p) - _PATTERN_FIELDS
        if unknown or "pattern" not in p:
            raise RuleError(file, f"patterns[{n}]", p, sorted(_PATTERN_FIELDS))
        if "fix" in p and {"fixTemplate", "fix_template"} & set(p):
            raise RuleError(file, f"patterns[{n}]", p, "one of fix and fixTemplate")
    template = lambda p: p.get("fixTemplate") or p.get("fix_template")
    fixes = [p.get("fix") or template(p) for p in listed]
    patterns = tuple((p["pattern"], f) if f else p["pattern"] for p, f in zip(listed, fixes, strict=True))
    templates = tuple(n for n, p in enumerate(listed) if template(p))
    messages = tuple((n, p["message"]) for n, p in enumerate(listed) if p.get("message"))
    given = fields.get("examples") or ()
    examples = tuple((e["bad"], e["good"]) for e in ([given] if isinstance(given, dict) else given))
    params = {k: int(v) for k, v in (fields.get("params") or {}).items()}
    context = fields.get("allow_context")
    keep = {k: fields[k] for k in ("engine", "severity", "intent", "scope", "threshold", "metric", "direction", "granularity", "message", "match_case", *_TEXTS) if k in fields}
    if keep.get("engine") == "inferential":
        instructions, shown = sections(body)
        keep["rubric"] = fields.get("rubric") or instructions
        if not keep["rubric"].strip():
            raise RuleError(file, "rubric", keep["rubric"], "text, there or in the body")
        for name, field in (("flag_examples", "flags"), ("pass_examples", "passes")):
            keep[field] = tuple(fields.get(name) or shown[name])
            if len(keep[field]) < LEAST_SHOWN:
                raise RuleError(file, name, list(keep[field]), f"{LEAST_SHOWN} or more")
    elif body.strip():
        keep["explanation"] = body.strip()
    try:
        return Rule(fields.get("id", ""), patterns=patterns, templates=templates, examples=examples, messages=messages, package=package, allow_context=(context["pattern"], context["window"]) if context else None, **params, **keep)
    except (KeyError, TypeError) as e:
        raise RuleError(file, "front matter", str(e), "the fields of a rule") from e


def problems(package: str, files: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(file, what is wrong) of each rule's file that cannot be used; files are read on their own, so that one does not hide the others."""
    out: list[tuple[str, str]] = []
    seen: dict[str, str] = {}
    for file, text in files:
        try:
            rule = parse_rule(text, package, file)
        except RuleError as e:
            out.append((file, str(e)))
            continue
        if rule.id in seen:
            out.append((file, f"{rule.id} is also in {seen[rule.id]}"))
        seen.setdefault(rule.id, file)
    return out


def load_package(folder: str | Path) -> RuleSet:
    """The rules of a package folder, in the order of their file names."""
    folder = Path(folder)
    manifest = yaml.safe_load((folder / "style.yaml").read_text())
    name = manifest.get("name", "")
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", name):
        raise RuleError("style.yaml", "name", name, "kebab-case")
    return from_sources(name, [(p.name, p.read_text()) for p in sorted(folder.glob("rules/*.md"))])


def from_sources(package: str, files: list[tuple[str, str]]) -> RuleSet:
    return RuleSet(tuple(parse_rule(text, package, name) for name, text in files))


def write_package(folder: str | Path, name: str, rules: RuleSet) -> None:
    """A manifest and one file for each rule; files of rules that are gone go too."""
    folder = Path(folder)
    (folder / "rules").mkdir(parents=True, exist_ok=True)
    for old in folder.glob("rules/*.md"):
        if old.stem not in {r.name for r in rules.rules}:
            old.unlink()
    (folder / "style.yaml").write_text(yaml.safe_dump({"name": name, "version": "1"}))
    for r in rules.rules:
        fields = {"id": r.name, "engine": r.engine, "severity": r.severity, "intent": r.intent, "scope": r.scope}
        fields |= {k: getattr(r, k) for k in ("threshold", "metric", "direction", "granularity", "message") if getattr(r, k) is not None}
        fields |= {k: getattr(r, k) for k in ("description", "rationale", "docs") if getattr(r, k) is not None}
        if r.patterns:
            said = dict(r.messages)
            fixed = [({"pattern": p} if f is None else {"pattern": p, "fixTemplate" if n in r.templates else "fix": f}) | ({"message": said[n]} if n in said else {}) for n, (p, f) in enumerate(r.pairs())]
            fields["patterns"] = [p["pattern"] if len(p) == 1 else p for p in fixed]
        if r.engine == "statistical":
            fields["params"] = {"run_length": r.run_length, "max_words": r.max_words}
        if r.allow_context:
            fields["allow_context"] = {"pattern": r.allow_context[0], "window": r.allow_context[1]}
        if not r.match_case:
            fields["match_case"] = False
        if r.examples:
            fields["examples"] = [{"bad": b, "good": g} for b, g in r.examples]
        body = r.rubric or r.explanation or ""
        for title, items in (("Flag examples", r.flags), ("Pass examples", r.passes)):
            body += f"\n\n## {title}\n" + "".join(f"- {x}\n" for x in items) if items else ""
        (folder / "rules" / f"{r.name}.md").write_text(f"---\n{yaml.safe_dump(fields, allow_unicode=True)}---\n{body}")
