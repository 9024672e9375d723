"""Triggers find every line that a rule matches, and no letters within other words."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folioscan.operators import match
from folioscan.plans.planted import MULTI, SINGLE
from folioscan.plans.rules import GENERATION, PACKS, REVISION
from folioscan.plans.triggers import bordered, pack_triggers, rule_trigger


def _found(pattern: str, text: str) -> bool:
    return re.search(pattern, f" {text} ") is not None


@pytest.mark.parametrize("pack", [REVISION, GENERATION], ids=lambda p: p.name)
def test_no_trigger_within_a_word(pack):
    assert not _found(pack_triggers(pack)[0], "attention sixth spreading knowledge asterisks worthy tallest networks robusta")


def test_border_at_either_end():
    by_label = {r.label: r for r in REVISION.rules}
    risk = rule_trigger(by_label["risk note"])
    assert all(_found(risk, t) for t in ("risk", "A RISK.", "(riſK)", "at-risk", "—risk—"))
    assert not any(_found(risk, t) for t in ("asterisk", "risks", "_risk", "risk2"))
    assert "\0now" in bordered(by_label["recency marker on behaviour"].regex)
    assert _found(rule_trigger(by_label["explicit caveat"]), "Two caveats")


def test_planted_hits_hold_their_rules_triggers():
    seen = 0
    for text, *of in SINGLE:
        for pack, hits in zip((REVISION, GENERATION), of, strict=True):
            for cls, label, match in hits:
                rules = [r for r in pack.rules if r.cls == cls and r.label == label]
                assert not rules or any(_found(rule_trigger(r), match) for r in rules), (text, label)
                assert not rules or rules[0].heading_only or rules[0].raw or _found(pack_triggers(pack)[0], text.replace("**", ""))
                seen += len(rules)
    for lines, hits in MULTI:
        for first, pack, _, label, match in hits:
            assert any(_found(rule_trigger(r), match) for r in PACKS[pack].rules if r.label == label)
            longest = pack_triggers(PACKS[pack])[2]
            ends = f"{lines[first][-longest:]} {lines[first + 1][:longest]}"
            assert any(_found(pack_triggers(PACKS[pack])[0], x) for x in (lines[first], lines[first + 1], ends))
    assert seen > 50


@pytest.mark.parametrize("pack", [REVISION, GENERATION], ids=lambda p: p.name)
def test_few_branches_and_plain_classes(pack):
    """A position of the text costs a few lookups: no ranges in a class, and no more than five branches in a row."""
    pattern = pack_triggers(pack)[0]
    assert not re.search(r"A-Z|a-z|0-9", pattern)
    tried, inside, i = [1], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside or c == "[":
            inside = c != "]"
        elif c == "(":
            tried.append(1)
        elif c == ")":
            assert tried.pop() <= 5
        elif c == "|":
            tried[-1] += 1
        i += 1
    assert tried == [1]


def test_every_string_is_found_in_either_case():
    for pack in (REVISION, GENERATION):
        for r in pack.rules:
            for s in () if r.heading_only else bordered(r.regex):
                text = s.replace("\0", " ")
                for t in (text, text.upper(), text.title(), f"x. {text}!"):
                    assert _found(rule_trigger(r), t), (r.label, t)
                    assert r.raw or _found(pack_triggers(pack)[0], t)


def test_long_patterns_are_kept_compiled(spark):
    """In lambdas rlike makes a string of its whole pattern for each line."""
    for pack in (REVISION, GENERATION):
        said = str(match.line_hits(pack, F.col("x"))).lower()
        assert "rlike(concat(' '" not in said
        assert said.count("regexp_instr(concat(' '") == len(pack.rules)
