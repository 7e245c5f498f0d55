"""The core rule package: what each rule looks for.

Messages and descriptions are our own; identifiers, thresholds and patterns are
fixed values.
"""

from __future__ import annotations

from .model import Rule

# Rules in the order of their names, each with its patterns in order;
# a pair is a pattern with its replacement.
CORE: tuple[Rule, ...] = (
    Rule("empty-hedge", "inferential", "warning", "detection", granularity="sentence"),
    Rule("no-achievement-language", "phrase", "warning", "style", patterns=(
        r"(?i)\bsuccessfully\b",
        r"(?i)\bcomprehensive(?:ly)?\b",
        r"(?i)\breliable\b|\breliably\b",
        r"(?i)\bflawless(?:ly)?\b",
        r"(?i)\beffortless(?:ly)?\b",
        r"(?i)\bstate[- ]of[- ]the[- ]art\b",
        r"(?i)\bbest[- ]in[- ]class\b",
        r"(?i)\bworld[- ]class\b",
        r"(?i)\bgame[- ]chang(?:er|ing)\b",
        r"(?i)\brevolutionary\b|\brevolutioni[sz]e[sd]?\b",
        r"(?i)\btop[- ]notch\b",
    )),
    Rule("no-ai-cliches", "phrase", "warning", "detection", patterns=(
        r"(?i)\bdelve\b",
        r"(?i)\btapestry\b",
        r"(?i)\blandscape of\b",
        r"(?i)\bin today's fast-paced world\b",
        r"(?i)\bit is important to note\b",
        r"(?i)\bnavigate the complexities\b",
        r"(?i)\bfoster\b",
        r"(?i)\butilize\b",
        r"(?i)\bfacilitate\b",
        r"(?i)\bempower\b",
        r"(?i)\bstreamline\b",
        r"(?i)\bparadigm shift\b",
        r"(?i)\bgame[- ]changer\b",
        r"(?i)\bthis is huge\b",
        r"(?i)\bthis changes everything\b",
        r"(?i)\bbeacon\b",
        r"(?i)\bmulti[- ]faceted\b",
        r"(?i)\bmeticulous(?:ly)?\b",
        r"(?i)\bintricate\b",
        r"(?i)\bparamount\b",
        r"(?i)\btransformative\b",
        r"(?i)\belevate\b",
        r"(?i)\bembark(?:ing)?\s+on\b",
        r"(?i)\bsupercharge\b",
        r"(?i)\bharness\b",
        r"(?i)\bever[- ]evolving\b",
    )),
    Rule("no-binary-contrast", "phrase", "warning", "detection", patterns=(
        r"(?i)\bthe (?:question|problem|issue|point) isn['’]t\b[^.?!]{0,80}[.,;]\s*it['’]s\b",
        r"(?i)\bit['’]s not just\b[^.?!]{0,80}\bit['’]s\b",
        r"(?i)\bthis is not\b[^.?!]{0,80}\.\s*it['’]s\b",
    )),
    Rule("no-colon-reveal", "leading", "warning", "detection", patterns=(
        r"the best part\s*:",
        r"the kicker\s*:",
        r"the catch\s*:",
        r"the result\s*:",
    )),
    Rule("no-dead-metaphors", "phrase", "warning", "style", patterns=(
        r"(?i)\blow[- ]hanging fruit\b",
        r"(?i)\blevel playing field\b",
        r"(?i)\bmove the needle\b",
        r"(?i)\bthink(?:ing)? outside the box\b",
        r"(?i)\bthe elephant in the room\b",
        r"(?i)\ba perfect storm\b",
        r"(?i)\bwhen push comes to shove\b",
        r"(?i)\bback to the drawing board\b",
        r"(?i)\btip of the iceberg\b",
        r"(?i)\bpar for the course\b",
        r"(?i)\bhit the ground running\b",
        r"(?i)\bthe lion['’]s share\b",
        r"(?i)\ba double[- ]edged sword\b",
        r"(?i)\bin a nutshell\b",
        r"(?i)\bthe ball is in (?:your|their|his|her|its) court\b",
    )),
    Rule("no-doublets", "phrase", "suggestion", "detection", patterns=(
        r"(?i)\b(?:cease and desist|null and void|any and all)\b",
    )),
    Rule("no-dramatic-fragment", "phrase", "warning", "detection", patterns=(
        r"(?i)\bthat['’]s it\.\s*that['’]s the\b",
        r"(?i)\bnot (?:a|an) [^.?!]{1,40}\.\s*not (?:a|an)\b",
        r"(?i)\bfull stop\.",
    )),
    Rule("no-em-dash-overuse", "density", "warning", "detection", threshold=8, patterns=(
        "—",
    )),
    Rule("no-empty-emphasis", "density", "warning", "detection", threshold=12, patterns=(
        r"(?i)\b(?:very|really|significantly|crucially)\b",
    )),
    Rule("no-en-dash", "phrase", "error", "style", allow_context=(r"\d–\d", 1), patterns=(
        "–",
    )),
    Rule("no-faux-insight", "phrase", "warning", "detection", patterns=(
        r"(?i)\bwhat most people get wrong\b",
        r"(?i)\bhere['’]s what nobody tells you\b",
        r"(?i)\bthe part everyone misses\b",
        r"(?i)\bthis is the part most people skip\b",
        r"(?i)\bhere['’]s the thing\b",
        r"(?i)\bhere['’]s what i mean\b",
        r"(?i)\bthe uncomfortable truth is\b",
    )),
    Rule("no-foreign-phrases", "phrase", "suggestion", "style", patterns=(
        (r"(?i)\binter alia\b", "among other things"),
        r"(?i)\bvis[- ]?à[- ]?vis\b|\bvis[- ]a[- ]vis\b",
        r"(?i)\bper se\b",
        (r"(?i)\bipso facto\b", "by that fact"),
        (r"(?i)\bmutatis mutandis\b", "with the necessary changes"),
        (r"(?i)\bceteris paribus\b", "all else being equal"),
        (r"(?i)\bergo\b", "therefore"),
        r"(?i)\bad hoc\b",
    )),
    Rule("no-hedging", "density", "warning", "detection", threshold=10, patterns=(
        r"(?i)\b(?:arguably|it could be said|generally speaking|perhaps|likely)\b",
    )),
    Rule("no-importance-puffery", "phrase", "error", "detection", patterns=(
        r"(?i)\bstands as a testament\b",
        r"(?i)\ba testament to\b",
        r"(?i)\bmarks a pivotal moment\b",
        r"(?i)\bplays a (?:vital|crucial|pivotal) role\b",
        r"(?i)\bsolidifies its position\b",
        r"(?i)\bunderscores (?:its significance|the importance)\b",
    )),
    Rule("no-legalese", "phrase", "warning", "style", patterns=(
        r"(?i)\bhereinafter\b",
        r"(?i)\baforementioned\b",
        (r"(?i)\bpursuant to\b", "under"),
        (r"(?i)\bnotwithstanding the foregoing\b", "despite the foregoing"),
        r"(?i)\bherein\b|\bthereto\b",
    )),
    Rule("no-marketing-language", "phrase", "error", "detection", patterns=(
        r"(?i)\bleverage\b",
        r"(?i)\bunlock\b",
        r"(?i)\bpowerful\b",
        r"(?i)\bseamless(?:ly)?\b",
        r"(?i)\brobust\b",
        r"(?i)\bcutting[- ]edge\b",
        r"(?i)\bdelve\b",
        r"(?i)\btapestry\b",
        r"(?i)\bin the realm of\b",
        r"(?i)\bnavigate the landscape of\b",
        r"(?i)\bit['’]s worth noting that\b",
        r"(?i)\bat the end of the day\b",
    )),
    Rule("no-not-only", "phrase", "warning", "detection", patterns=(
        r"(?is)\bnot only\b[\s\S]{0,120}\bbut also\b",
    )),
    Rule("no-parenthetical-asides", "density", "warning", "style", threshold=15, patterns=(
        r"(?:^|\s)(\([^)]*\))",
    )),
    Rule("no-passive-overuse", "density", "warning", "detection", threshold=25, patterns=(
        r"(?i)\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b",
    )),
    Rule("no-repetitive-openers", "statistical", "warning", "detection", metric="repetitive-openers", run_length=3),
    Rule("no-rhetorical-setups", "phrase", "warning", "detection", patterns=(
        r"(?i)\bwhat if i told you\b",
        r"(?i)\bthink about it\s*:",
        r"(?i)\bplot twist\s*:",
        r"(?i)\blet that sink in\b",
        r"(?i)\bread that again\b",
    )),
    Rule("no-robotic-transitions", "density", "warning", "detection", threshold=18, patterns=(
        r"(?im)^\s*(Moreover|Furthermore|Additionally|In conclusion),",
    )),
    Rule("no-rule-of-three", "density", "warning", "detection", threshold=12, patterns=(
        r"(?i)\b\w+(?:\s+\w+){0,3},\s+\w+(?:\s+\w+){0,3},\s+and\s+\w+",
    )),
    Rule("no-semicolons", "phrase", "error", "style", patterns=(
        ";",
    )),
    Rule("no-superficial-analysis", "phrase", "warning", "detection", patterns=(
        r"(?i),\s*(?:highlighting|underscoring|reflecting|showcasing|signaling|demonstrating|emphasizing|illustrating)\b\s+(?:the|its|their|a|how)\b",
    )),
    Rule("no-sycophantic-openers", "leading", "error", "detection", patterns=(
        "(?:great|good|excellent|fantastic|wonderful) question",
        "what a (?:great|fascinating|wonderful|excellent|interesting) (?:question|problem|point)",
        "that['’]s a (?:great|fascinating|wonderful|excellent) (?:question|point)",
    )),
    Rule("no-throat-clearing", "leading", "error", "detection", patterns=(
        "let me think(?: about this)?",
        "here['’]s my take",
        "here['’]s what i think",
        "i think it['’]s worth",
        "before (?:i|we) (?:begin|start|dive in)",
    )),
    Rule("no-weasel-attribution", "phrase", "warning", "detection", patterns=(
        r"(?i)\bexperts agree\b",
        r"(?i)\bstudies show\b",
        r"(?i)\bresearch (?:shows|suggests)\b",
        r"(?i)\bmany argue\b",
        r"(?i)\bwidely regarded as\b",
        r"(?i)\bindustry reports suggest\b",
        r"(?i)\bit is widely believed\b",
    )),
    Rule("oxford-comma", "phrase", "warning", "style", patterns=(
        r"(?i)\w+,\s+\w+(?:\s+\w+){0,3}\s+(?:and|or)\s+\w+",
    )),
    Rule("padded-elaboration", "inferential", "warning", "detection", granularity="paragraph"),
    Rule("prefer-concise-phrases", "phrase", "suggestion", "style", patterns=(
        (r"(?i)\bdue to the fact that\b", "because"),
        (r"(?i)\bin order to\b", "to"),
        (r"(?i)\bin the event that\b", "if"),
        (r"(?i)\bat this point in time\b", "now"),
        (r"(?i)\bat the present time\b", "now"),
        r"(?i)\bfor the purpose of\b",
        (r"(?i)\bin spite of the fact that\b", "although"),
        (r"(?i)\bwith regard to\b", "about"),
        (r"(?i)\bwith respect to\b", "about"),
        (r"(?i)\bin relation to\b", "about"),
        (r"(?i)\bon a regular basis\b", "regularly"),
        (r"(?i)\bin a timely manner\b", "promptly"),
        (r"(?i)\bin the near future\b", "soon"),
        r"(?i)\bthe majority of\b",
        r"(?i)\ba (?:large )?number of\b",
        (r"(?i)\b(?:has the ability to|have the ability to|is able to|are able to)\b", "can"),
        r"(?i)\bwhen it comes to\b",
        r"(?i)\bin today['’]s world\b",
        r"(?i)\bin the age of\b",
        r"(?i)\bin the world of\b",
        r"(?i)\bthe reality is\b",
        r"(?i)\bthe truth is\b",
        r"(?i)\bgoing forward\b",
        r"(?i)\blet['’]s dive in\b",
        r"(?i)\bat its core\b",
        r"(?i)\bit['’]s important to note\b",
    )),
    Rule("prefer-short-words", "phrase", "suggestion", "style", patterns=(
        (r"(?i)\butili[sz]e\b", "use"),
        (r"(?i)\butili[sz]ation\b", "use"),
        (r"(?i)\bfacilitate\b", "help"),
        (r"(?i)\bcommence\b", "start"),
        (r"(?i)\bterminate\b", "end"),
        (r"(?i)\bendeavou?r\b", "try"),
        (r"(?i)\bascertain\b", "find out"),
        (r"(?i)\bdemonstrate\b", "show"),
        (r"(?i)\bsufficient\b", "enough"),
        (r"(?i)\bnumerous\b", "many"),
        (r"(?i)\bapproximately\b", "about"),
        (r"(?i)\binitiate\b", "start"),
        (r"(?i)\bpurchase\b", "buy"),
        (r"(?i)\bmethodology\b", "method"),
        (r"(?i)\bexpedite\b", "speed up"),
        (r"(?i)\bremainder\b", "rest"),
        (r"(?i)\bassist\b", "help"),
    )),
    Rule("sentence-length", "statistical", "warning", "style", metric="sentence-length", max_words=45),
    Rule("triad-overuse", "statistical", "warning", "detection", threshold=2, metric="triad-density", direction="above"),
    Rule("uniform-sentence-rhythm", "statistical", "warning", "detection", threshold=105, metric="sentence-length-variance", direction="below"),
)
