"""Literal triggers: strings one of which every match of a pack's rules holds.

They are read off the rules' own syntax trees, so no list has to be kept in step
with the rules. A set of strings is exact for a part of a rule if the part matches
just these; exact parts in a row are multiplied out while few, and of the sets that
a rule offers the one with the longest shortest string is taken. A word border of the
rule is kept in its strings (BORDER), so that "two" isn't found within a word.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser

from .rules import Pack, Rule

MOST = 400
#: Characters beyond ASCII that a pattern without regard to case takes for a letter of ASCII.
ODD = {"s": "ſ", "i": "ıİ", "k": "\u212a"}
#: Stands for a word border in a string, and what is then beside the string: a rule's own border asks for more.
#: Java looks it up in a table, as it does a class of single Latin letters; ranges are a chain of calls for each character.
BORDER, BESIDE = "\0", r"\W"
PRINTED = [chr(c) for c in range(32, 127)]


def _read(tree) -> tuple[set[str] | None, set[str] | None]:
    """(exact, some): the strings that the part matches, if few; strings one of which it holds."""
    now: set[str] = {""}
    whole, offers = True, []

    def offer(s: set[str] | None) -> None:
        if s and all(x.strip(BORDER) for x in s):
            offers.append(s)

    for kind, v in tree:
        exact = some = None
        if kind is op.LITERAL:
            exact = {chr(v).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in v) and len(v) <= 4:
            exact = {chr(c).lower() for _, c in v}
        elif kind is op.SUBPATTERN:
            exact, some = _read(v[-1])
        elif kind is op.BRANCH:
            parts = [_read(b) for b in v[1]]
            exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            some = set().union(*(s for _, s in parts)) if all(s for _, s in parts) else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, sub = v
            e, s = _read(sub)
            exact = e if (low, high) == (1, 1) else e | {""} if (low, high) == (0, 1) and e is not None else None
            some = s if low else None
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            exact = {BORDER if v in (op.AT_BOUNDARY, op.AT_BEGINNING) else ""}
        if exact is not None and len(now) * len(exact) <= MOST:
            now = {a + b for a in now for b in exact}
            continue
        whole = False
        offer(now)
        offer(some)
        # marks such as ^\** leave what follows next to the border, or to a mark
        marks = kind is op.MAX_REPEAT and len(v[2]) == 1 and v[2][0][0] is op.LITERAL and not re.match(r"\w", chr(v[2][0][1]))
        beside = marks and all(x.endswith(BORDER) for x in now)
        now = exact if exact is not None else {BORDER if beside else ""}
    offer(now)
    best = max(offers, key=lambda s: (min(map(len, s)), -len(s)), default=None)
    return (now if whole and len(now) <= MOST else None), best


def bordered(regex: str) -> set[str]:
    """literals() with a BORDER at an end where the rule wants a border next to a letter or digit of ASCII."""
    found = _read(_parser.parse(re.sub(r"^\(\?\w+\)", "", regex)))[1]
    if not found:
        raise ValueError(f"no literal in every match of {regex}")

    def ends(s: str) -> str:
        bare = s.replace(BORDER, "")
        opened, closed = (BORDER * (at == BORDER and re.match("[a-z0-9_]", c) is not None) for at, c in ((s[0], bare[0]), (s[-1], bare[-1])))
        return opened + bare + closed

    return {ends(s) for s in found}


def literals(regex: str) -> set[str]:
    """Lower-case strings one of which every match of regex holds."""
    return {s.replace(BORDER, "") for s in bordered(regex)}


def _either(c: str) -> str:
    """A pattern of the character in either case; single letters, no ranges, see BESIDE."""
    every = sorted({x for x in (c, c.lower(), c.upper()) if len(x) == 1} | set(ODD.get(c, "")))
    return re.escape(c) if len(every) == 1 else f"[{''.join(every)}]"


def _unlike(chars: list[str]) -> str:
    """Not before a printed character of ASCII that is none of chars in either case: one lookup passes over them all."""
    own = {x for c in chars for x in (c.lower(), c.upper())}
    return "(?![" + "".join(re.escape(c) for c in PRINTED if c not in own) + "])"


def trie(strings: set[str]) -> str:
    """A pattern that finds any of the strings, in either case, in text with a blank before and after it; each branch begins with a character of its own.

    Branches are tried in turn, so many of them are put in groups, and groups of groups, each tried only before its own characters.
    """
    few = [s for s in strings if not any(t != s and t in s for t in strings)]
    tree: dict = {}
    for s in few:
        at = tree
        for c in s:
            at = at.setdefault(c, {})

    def either(parts: list[str]) -> str:
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    def grouped(edges: list[tuple[str, dict]]) -> list[str]:
        if len(edges) <= 4:
            return [_either(c) + write(sub) for c, sub in edges]
        n = -(-len(edges) // 4)
        groups = [edges[i : i + n] for i in range(0, len(edges), n)]
        return [_unlike([c for c, _ in g]) + either(grouped(g)) for g in groups]

    def write(node: dict) -> str:
        border = [BESIDE + write(sub) for c, sub in node.items() if c == BORDER]
        parts = border + grouped(sorted(((c, sub) for c, sub in node.items() if c != BORDER), key=lambda e: e[0]))
        return either(parts) if parts else ""

    return write(tree)


@lru_cache(maxsize=256)
def rule_trigger(rule: Rule) -> str:
    """trie() of one rule."""
    return trie(bordered(rule.regex))


@lru_cache(maxsize=64)
def pack_triggers(pack: Pack) -> tuple[str, str, int]:
    """Patterns of trie(): of the rules that read plain lines, and of those that read raw ones; and the length of the longest string of the first.

    Rules for headings have none: headings are few and are always tried.
    """
    plain = set().union(*(bordered(r.regex) for r in pack.rules if not r.raw and not r.heading_only))
    raw = set().union(*(bordered(r.regex) for r in pack.rules if r.raw))
    return trie(plain) or "(?!)", trie(raw), max(map(len, plain), default=1)
