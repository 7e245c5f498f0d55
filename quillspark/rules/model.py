"""Rules, rule sets and options; validation happens where a rule is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

ENGINES = {"phrase": "static", "leading": "static", "density": "static", "statistical": "statistical", "inferential": "inferential"}
SEVERITIES = {"error": 5, "warning": 3, "suggestion": 1}
INTENTS = ("style", "detection")
SCOPES = ("prose", "text", "all")
SENTENCE_METRICS = ("sentence-length", "repetitive-openers")
DOCUMENT_METRICS = ("sentence-length-variance", "cadence-autocorrelation", "repeated-opener-density", "triad-density", "paired-adjective-rate")
MACHINE, MAYBE = "machine-applicable", "maybe-incorrect"


class RuleError(ValueError):
    """A rule that cannot be used: which field of which rule, its value, and what it may be."""

    def __init__(self, rule: str, name: str, value: object, allowed: object = None):
        super().__init__(f"{rule}: {name} is {value!r}" + (f"; it may be {allowed}" if allowed is not None else ""))
        self.rule, self.field, self.value, self.allowed = rule, name, value, allowed


@dataclass(frozen=True)
class Rule:
    """One rule. `patterns` holds patterns, or pairs of a pattern and its replacement: a literal one,
    or one that names groups ($1, ${name}, $$ for a dollar sign) at the places in `templates`.
    `examples` are pairs of a text that the rule flags and one that it leaves alone; `flags` and `passes` are
    what a judge is shown of either kind. `messages` holds messages of single patterns, by their places."""

    name: str
    engine: str
    severity: str = "warning"
    intent: str = "detection"
    scope: str = "text"
    patterns: tuple = ()
    threshold: float | None = None
    metric: str | None = None
    direction: str | None = None
    granularity: str | None = None
    run_length: int = 3
    max_words: int = 45
    allow_context: tuple[str, int] | None = None
    match_case: bool = True
    templates: tuple[int, ...] = ()
    message: str | None = None
    rubric: str | None = None
    examples: tuple[tuple[str, str], ...] = ()
    package: str = "core"
    flags: tuple[str, ...] = ()
    passes: tuple[str, ...] = ()
    messages: tuple[tuple[int, str], ...] = ()
    description: str | None = None
    rationale: str | None = None
    docs: str | None = None
    explanation: str | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, name: str, value: object, allowed: object = None) -> None:
            if not ok:
                raise RuleError(self.name, name, value, allowed)

        need(bool(re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", self.name)), "name", self.name, "kebab-case")
        need(self.engine in ENGINES, "engine", self.engine, sorted(ENGINES))
        severity = "suggestion" if self.severity == "info" else self.severity
        need(severity in SEVERITIES, "severity", self.severity, sorted(SEVERITIES))
        object.__setattr__(self, "severity", severity)
        need(self.intent in INTENTS, "intent", self.intent, INTENTS)
        need(self.scope in SCOPES, "scope", self.scope, SCOPES)
        if self.engine in ("phrase", "leading"):
            need(len(self.patterns) > 0, "patterns", self.patterns, "one or more")
        if self.engine == "density":
            need(len(self.patterns) == 1, "patterns", self.patterns, "exactly one")
            need(self.threshold is not None and self.threshold >= 0, "threshold", self.threshold, "0 or more")
        if self.engine == "statistical":
            need(self.metric in SENTENCE_METRICS + DOCUMENT_METRICS, "metric", self.metric, SENTENCE_METRICS + DOCUMENT_METRICS)
            if self.metric in DOCUMENT_METRICS:
                need(self.threshold is not None, "threshold", self.threshold, "a number")
                need(self.direction in ("above", "below"), "direction", self.direction, ("above", "below"))
        else:
            need(self.direction is None, "direction", self.direction, "set for statistical rules only")
        for n in self.templates:
            need(self.engine == "phrase" and n < len(self.patterns) and self.pairs()[n][1] is not None, "templates", self.templates, "places of patterns with a replacement")
            self.java_template(self.pairs()[n][1], self.pairs()[n][0])
        if self.engine != "phrase":
            need(self.allow_context is None, "allow_context", self.allow_context, "set for phrase rules only")
        if self.engine == "inferential":
            need(self.severity != "error", "severity", self.severity, ("warning", "suggestion"))
            need(self.granularity in ("sentence", "paragraph", "document"), "granularity", self.granularity, ("sentence", "paragraph", "document"))

    @property
    def id(self) -> str:
        return f"{self.package}/{self.name}"

    @property
    def tier(self) -> str:
        return ENGINES[self.engine]

    def pairs(self) -> list[tuple[str, str | None]]:
        """Each pattern with its replacement."""
        return [(p, None) if isinstance(p, str) else (p[0], p[1]) for p in self.patterns]

    def java_template(self, template: str, pattern: str | None = None) -> str:
        """A template in the notation of Java's replacements; groups that `pattern` lacks are an error."""
        known = None
        if pattern is not None:
            try:
                known = re.compile(pattern)
            except re.error:  # a construct of the other dialect: groups are not checked
                pass

        def one(m: re.Match) -> str:
            name = m[1] or m[2]
            if name is None:
                return r"\$" if m[0] == "$$" else "\\" + m[0]
            if known is not None and (int(name) > known.groups if name.isdigit() else name not in known.groupindex):
                raise RuleError(self.name, "templates", m[0], "a group of the pattern")
            return f"${name}" if name.isdigit() else f"${{{name}}}"

        return re.sub(r"\$\$|\$(\w+)|\$\{(\w+)\}|[\\$]", one, template)

    def says(self, pattern: int | None = None) -> str:
        """The rule's message, or that of one of its patterns."""
        for n, text in self.messages:
            if n == pattern:
                return text
        return self.message or f"{self.name.replace('-', ' ').capitalize()}."


@dataclass(frozen=True)
class Options:
    """What a run turns on, off or changes; keys are ids or names that are unique across packages."""

    enable: tuple[str, ...] | None = None
    disable: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    directive: str = "prose"
    confidence_floor: float = 0.6

    def layer(self, over: Options) -> Options:
        """These options with those of `over` on top, field by field."""
        base = Options()
        changed = {k: v for k, v in vars(over).items() if v != getattr(base, k)}
        for name in ("severity", "thresholds"):
            if name in changed:
                changed[name] = getattr(self, name) | changed[name]
        return replace(self, **changed)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]

    def __post_init__(self) -> None:
        ids = [r.id for r in self.rules]
        for i in ids:
            if ids.count(i) > 1:
                raise RuleError(i, "id", i, "unique")

    def merge(self, other: RuleSet) -> RuleSet:
        """Both sets; an id in both is an error, and neither set changes."""
        return RuleSet(self.rules + other.rules)

    def resolve(self, name: str) -> str | None:
        """The id that a full id, or a bare name which only one package has, stands for."""
        if any(r.id == name for r in self.rules):
            return name
        found = [r.id for r in self.rules if r.name == name]
        return found[0] if len(found) == 1 else None

    def chosen(self, options: Options) -> list[Rule]:
        """The rules that run under the options, in order, with their severities and thresholds.
        `enable` is a list of all that run if present; `disable` wins; unknown names do nothing."""
        on = None if options.enable is None else {self.resolve(x) for x in options.enable}
        off = {self.resolve(x) for x in options.disable}
        out = []
        for r in self.rules:
            if r.id in off or on is not None and r.id not in on:
                continue
            severity = {self.resolve(k): v for k, v in options.severity.items()}.get(r.id, r.severity)
            by_alias = {self.resolve(k): v for k, v in options.thresholds.items()}
            threshold = options.thresholds.get(r.id, by_alias.get(r.id))
            if threshold is not None:
                r = replace(r, max_words=int(threshold)) if r.metric == "sentence-length" else replace(r, threshold=threshold)
            out.append(replace(r, severity=severity))
        return out
