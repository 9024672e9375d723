"""The two rule packs, as data.

A rule is a literal regular expression with a class and a label; the order of a
pack decides which rule names a line. Vocabularies are word lists put together by
alt(), so a rule reads as what it looks for.
"""

from __future__ import annotations

from dataclasses import dataclass

CI, CS = "(?iU)", "(?U)"
APOS = "['’]"


def alt(listed: str, *more: str) -> str:
    """One of the semicolon-separated alternatives."""
    return "(?:" + "|".join([w.strip() for w in listed.split(";") if w.strip()] + list(more)) + ")"


def word(listed: str, *more: str) -> str:
    return rf"\b{alt(listed, *more)}\b"


@dataclass(frozen=True)
class Rule:
    cls: str
    label: str
    regex: str
    heading_only: bool = False
    raw: bool = False  #: reads the raw line, of markdown alone, and never across lines
    suppress: str | None = None
    positional: bool = False  #: the suppressor must overlap the match
    path_suppress: str | None = None


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...]
    heading: str  #: what a heading is, on the left-stripped line
    long_table_class: str | None = None  #: class not told in table rows of over 200 characters
    emoji: bool = False
    joined_suppress: bool = True  #: across lines, suppressors read both lines; else only the match
    classes: tuple[str, ...] = ()

    def line_rules(self) -> list[tuple[int, Rule]]:
        return list(enumerate(self.rules))

    def wrap_rules(self) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules) if not r.heading_only and not r.raw]


GUIDED = CI + alt("getting[-_ ]?started; onboarding; quickstart; tutorial; walkthrough")
_worked = r"(?!" + alt("assume; call; define; denote; imagine; say; suppose") + r"\b)"
_tracker = r"(?:issue|PR|ticket)\s*#\d+"
_company = alt("brands?; CEO; co-founder; company; corp; CTO; founded; inc; llc; ltd; portfolio; president")

REVISION = Pack(
    "revision",
    (
        Rule("10", "heading argues rather than names", CI + r"(?:^#{1,6}\s+Why\b|\bmatters\s*$|, and why\s*$|:\s[^:]{0,40}\bnot\b|—[^—]*\bnot\b[^—]*$)", heading_only=True),
        Rule(
            "0a",
            "prior-state reference",
            CI
            + word(
                "first version; formerly; has since; initial version; no longer; previously; since then; what we had",
                "an earlier " + alt("draft; note; section; version"),
                "the original " + alt("note; plan; table; version"),
                "the " + alt("old; previous") + " " + alt("behaviou?r; draft; implementation; revision; version"),
                "we " + alt("assumed; concluded; had; thought"),
            ),
            suppress=CI + word("acquired by; before joining; formerly; née; previously; prior to joining; rebranded; renamed; spun out") + r"[^.]{0,60}\b" + _company + r"\b",
        ),
        Rule("0a", "past-habitual 'used to'", CI + r"\bused to \w+", suppress=CI + r"(?:\.\s+|[—–-]\s*|[,(]\s*|\b(?:of|for)\b[^.;]{0,30})used to \w+", positional=True),
        Rule("0a", "self-correction", CI + word("got wrong; half right; measured wrong; misread; mistakenly; overturn(?:s|ed)?; revised; superseded; was wrong; were wrong; wrongly", "corrected " + alt("above; below; that; this"), r"the corrected \w+", "turned out (?:to be )?wrong")),
        Rule("0a", "pass/round marker", CI + word("both passes", alt("earlier; first; initial; original; search-only; second; third") + " pass", "rounds? " + alt("1; 2; one; two")), suppress=CI + word("bidding; election; funding; interview; negotiation; review; sampling; seed; series [a-e]; survey; tournament")),
        Rule("0b", "version changelog", CS + r"\b" + alt("Added; Changed; Corrected; Fixed; Introduced; Removed; Updated") + r" in\s+[\"'_`]?\S+"),
        Rule("0b", "recency marker on behaviour", CI + r"(?<!by )(?<!for )(?<!right )(?<!until )\bnow\s+(?!" + alt("as; is; its; less; plus; this; thus; was") + r"\b)\w+s\b"),
        Rule(
            "0b",
            "perfect-tense changelog",
            CI + r"\bha(?:s|ve) (?:also |now |since )?been " + alt("added; deleted; deprecated; dropped; fixed; merged; moved; refactored; removed; renamed; replaced; restored; reverted; reworked; rewritten; simplified; split; updated") + r"\b",
            suppress=CI + word("after; as soon as; assuming; before; if; once; provided; unless; until; when; whenever") + r"[^.;]{0,60}\bha(?:s|ve)\b",
            positional=True,
        ),
        Rule("0b", "recency marker", CI + r"(?:" + word("got; has; have; only; was; were") + r"\s+recently\b|\brecently\s+" + alt("added; changed; fixed; gained; introduced; landed; merged; migrated; moved; renamed; rewritten; switched; updated") + r"\b)", suppress=CI + r"\bmost recent(?:ly)?\b"),
        Rule("0b", "pre-change narrative", CI + word("before this " + alt("branch; change; fix") + " existed", r"the first version of (?:the|this) \w+", "until (?:this|recently)")),
        Rule("0c", "dated status stamp", CI + r"(?:\bas of \d{4}|\bhas not been made\b|\bnow settled\b|\bstill " + alt("open; TBD; TODO") + r"\b|_?Status[:\s]+\d{4}(?:-\d{2}){2})"),
        Rule("0c", "implicit 'as of now'", CI + word("at present; at the time of writing; currently", "as of (?:this )?writing", "as of (?:right now|today)")),
        Rule(
            "0d",
            "status claim on a tracker item",
            CI + r"(?:" + _tracker + r".{0,80}" + word("has not been; hasn't been; is blocked; not yet; remains open; still open", "should be " + alt("closed; rewritten; updated")) + "|" + word("has not been; hasn't been; not yet done; still open", "should be " + alt("closed; rewritten; updated")) + r".{0,80}" + _tracker + ")",
        ),
        Rule(
            "0d",
            "future promise",
            CI
            + word(
                "coming soon; future work; on the roadmap",
                "in a (?:later|future) " + alt("change; iteration; pass; PR; release; version"),
                "not yet " + alt("built; documented; handled; implemented; supported; wired"),
                "will (?:eventually )?be " + alt("added; addressed; documented; expanded; fixed; implemented; removed; replaced; supported"),
            ),
        ),
        Rule("0.5", "explicit caveat", CI + r"\b" + alt(r"admittedly; be aware; bear in mind; caveat; it should be noted; keep in mind; limitation; not verified; revisit(?:ing|ed)?\b; should be checked; the one limit; the only limit; to be fair; unverified; with the exception")),
        Rule("0.5", "mid-sentence concession", CI + word("although; but note; however; note that; on the other hand; that said; then again; though")),
        Rule("0.5", "risk note", CI + word("danger; gotcha; hazard; pitfall; risk")),
        Rule("1", "document self-reference", CI + r"\b(?:this " + alt("doc; document; file; guide; note; page; plan; README; section; table") + r"\b|" + alt("a note on; for the record; how to read this; notes on; the point of writing") + r"\b)"),
        Rule("2", "navigation", CI + r"\b(?:as " + alt("described; discussed; mentioned; noted") + " " + alt("above; below; earlier") + "|see " + alt("§; above; below; section") + "|stop reading|the " + alt("list; point; section; table") + r" (?:below|above)|read (?!as\b).{0,20}first(?![-\w]))\b"),
        Rule(
            "3",
            "walking the reader",
            CI
            + r"(?:\blet['’]s "
            + _worked
            + r"\w+|\blet us "
            + _worked
            + r"\w+|"
            + word("as (?:we|you) " + alt("can see; have seen; saw; will see"), "before we " + alt("begin; continue; dive; get started; go any further; start"), "before diving in", "in what follows", "moving on", r"now that (?:you|we)(?: have|['’]ve)", r"we(?: will|['’]ll) (?:first |now |then )?" + alt("cover; discuss; dive; examine; explore; look; return; turn; walk"), "with that out of the way", "without further ado", "you m(?:ay|ight) " + alt("ask; be wondering; wonder"))
            + ")",
            path_suppress=GUIDED,
        ),
        Rule("4", "enumerative pre-announcement", CS + r"^\**" + alt("Both; Eight; Five; Four; Nine; Seven; Several; Six; Ten; Three; Two") + r"\b[^.!?]{0,60}:\s*$"),
        Rule("4", "inline count preamble", CS + r"\b" + alt("Five; Four; Seven; Six; Three; Two") + " " + alt("caveats; consequences; further; gaps; hard; independent; key; more; priors; reasons; rules; separate; things; ways") + r"\b"),
        Rule("5", "'worth X' attitude marker", CI + r"(?<!net )\bworth " + alt(r"a glance; a\b; carrying; deciding; defending; it\b; knowing; mentioning; noting; re-?checking; recording; remembering; the\b; \d")),
        Rule("6", "salience superlative", CI + word("is the finding; literally the", "the important (?:one|thing)", "the key " + alt("point; takeaway; thing"), r"the least \w+", r"the (?:single )?most (?!recent)\w+", "the " + alt("best; strongest; weakest; worst") + " " + alt("area; link; part; thing"))),
        Rule("6", "salience adverb", CI + r"\b(?:mo(?:re|st) )?" + alt("critically; crucially; importantly; notably") + r"\b"),
        Rule("7", "intent disclosure", CI + word("by design; deliberately; explicitly; intentionally; on purpose")),
        Rule("8", "contrastive framing", CI + r"(?:\b(?:are|is) \w+, not \w+\b|\bnot (?:an?|the) [-\w]+[,;] (?:it|this|that) is\b)"),
        Rule("9", "meta-commentary on the record", CI + word("being wrong in a recorded way; flagging (?:this|it) as; the diff is the record; worth recording", "the point of (?:documenting|writing)")),
    ),
    heading=r"^#",
    long_table_class="0.5",
    classes=("0a", "0b", "0c", "0d", "0.5", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10"),
)

_ive = "I" + APOS + "ve "
_s = APOS + "s"
PLACEHOLDER = r"\[" + alt("Add; Describe; Explain; Fill; Insert; List; PLACEHOLDER; Provide; TBD; TODO; Your") + r"\b[^\]]*\](?![\[(])"
EMOJI = "[\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2B5F}\\x{1F300}-\\x{1FAFF}]"

GENERATION = Pack(
    "generation",
    (
        Rule("3", "narrative heading", CI + r"^#{1,6}\s*[^\w]*" + alt("Closing Thoughts; Conclusion; Final Notes; Final Thoughts; In Summary; Key Takeaways; Wrapping Up") + r"\s*$", heading_only=True),
        Rule("0a", "assistant self-narration", CS + word("I went ahead and", _ive + alt("added; adjusted; also; bumped; changed; created; fixed; gone ahead; implemented; modified; refactored; removed; renamed; updated"), "I have " + alt("added; created; implemented; refactored; updated"), "I" + APOS + "ll (?:now )?" + alt("add; create; fix; implement; remove; update"))),
        Rule("0a", "model disclaimer", CI + word("As an AI(?: assistant| language model)?", "as of my (?:last )?knowledge cutoff", "my training data")),
        Rule(
            "0a",
            "chat pleasantry",
            CS
            + r"(?:"
            + word("As requested; Great question; Happy to help; Let me know if you; Thanks for reading; Would you like me to", "Feel free to (?:ask|reach out)", r"Happy \w+ing", "Here" + _s + " a breakdown", "Here" + _s + " (?:an|the) updated", "(?:I )?[Hh]ope this helps", "Please don" + APOS + "t hesitate", "You" + APOS + "re absolutely right")
            + r"|^\s*"
            + alt("Absolutely; Certainly; Of course; Sure thing")
            + "[!,])",
        ),
        Rule("0b", "handoff summary", CS + r"\b" + alt(r"Changes made:; Files (?:changed|modified):; In this update; Key changes:; No breaking changes\b; Summary of [Cc]hanges; The above (?:implementation|changes); The following changes were made; This completes the; What was done; with full test coverage", "(?:The )?[Ii]mplementation is (?:now )?complete", "This " + alt("change; commit; PR; pull request") + " " + alt("adds; fixes; implements; introduces; refactors; updates"))),
        Rule("0b", "test-pass assertion", CS + r"\b[Aa]ll (?:\d+\s+)?tests?\s+(?:are\s+)?(?:now\s+)?pass(?:ed|ing)?\b", suppress=CI + word("after; before; check that; confirm; ensure; makes? sure; once; require[ds]?(?: that)?; so that; until; verify; when")),
        Rule("0c", "unfilled placeholder", CI + r"(?:" + PLACEHOLDER + r"|\blorem ipsum\b|\bTODO: " + alt("add; complete; describe; document; fill; write") + r"\b)", raw=True),
        Rule(
            "1",
            "importance inflation",
            CI
            + word(
                "battle-tested; best-in-class; comprehensive; cutting-edge; endless possibilities; enterprise-grade; feature-rich; full-fledged; hassle-free; industry-leading; lightning-fast; next-generation; powerful yet simple; production-ready; revolutionary; rich set of; robust; simple yet powerful; state-of-the-art; supercharge[ds]?; top-notch; unparalleled; world-class",
                "blazing(?:ly)?[- ]fast",
                "effortless(?:ly)?",
                "seamless(?:ly)?",
                "highly " + alt("efficient; optimized; performant; scalable"),
                "wide (?:array|range) of",
            ),
            suppress=CI + r"(?:\bcomprehensive income\b|\bnext-generation sequencing\b|\brobust " + alt("estimat; regression; standard errors?; statistics") + ")",
        ),
        Rule(
            "2",
            "lexical tell",
            CI
            + word(
                r"a testament to; boasts?; cornerstone; delve[ds]?; delving; elevate[ds]?; ever-evolving; fast-paced; game-?changer; holistic; invaluable; meticulously; myriad; paradigm shift; pivotal; plethora; synerg\w+",
                "deep(?:er)? dive",
                "dive deep(?:er)?",
                "empower(?:ed|ing|s)?",
                "encompass(?:ing|es)?",
                "facilitat(?:ed|es|ing|e)",
                "foster(?:ed|ing|s)?",
                "harness(?:ed|es|ing)?",
                "in today" + _s,
                "leverag(?:ed|es|ing|e)",
                "(?:rich )?tapestry of",
                "showcas(?:es|ing|e)",
                "streamlin(?:ed|es|ing|e)",
                "underscor(?:es|ing|e)",
                "unlock(?:ed|ing|s)?",
                "utiliz(?:ed|es|ing|e)",
            ),
            suppress=CI + r"(?:\b" + alt("cable; test; wiring") + r" harness(?:es)?\b|\b" + alt("debt; leverage; operating") + r" ratio\b|\b(?:financial|operating) leverage\b|\bunlock(?:ed|ing|s)? (?:the )?" + alt("account; bootloader; device; lock; mutex; phone; screen") + r"\b|\bprivilege elevation\b|\belevated privileg|\bprogramming paradigm\b)",
        ),
        Rule("2", "role inflation", CI + word("of paramount importance", "it is " + alt("crucial; essential; vital") + " to", "plays? a " + alt("critical; crucial; key; pivotal; vital") + " role", alt("acts as; forms; serves as") + " the " + alt("backbone; bedrock; cornerstone; foundation") + " of")),
        Rule(
            "3",
            "essay scaffold",
            CI
            + r"(?:"
            + word("has you covered; In conclusion; In summary; Look no further; To sum up; To summarize", "By the end of this " + alt("article; document; guide; tutorial"), "Let" + _s + " (?:get started|dive in)", "This " + alt("document; guide; page") + " " + alt("takes; walks; will take; will walk") + " you through", "Whether you" + APOS + "re a")
            + r"|\bIn this "
            + alt("article; document; guide; page; post; README; section")
            + "(?:,| you| we))",
            path_suppress=GUIDED,
        ),
        Rule("4", "symmetric filler", CI + r"(?:" + word("strikes? a balance between; the best of both worlds; the perfect blend of; to the next level", "is (?:about more|more) than just") + r"|\bisn" + APOS + r"t just (?:about )?\w+|\bnot just an? \w+(?:.{0,40}\bbut\b)?|\bnot only\b.{0,60}\bbut also\b)"),
    ),
    heading=r"(?U)^#{1,6}\s",
    emoji=True,
    joined_suppress=False,
    classes=("0a", "0b", "0c", "0d", "1", "2", "3", "4", "5", "6"),
)

PACKS = {p.name: p for p in (REVISION, GENERATION)}
