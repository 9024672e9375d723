"""Rule matching, within the row of a file.

A line that holds none of the pack's triggers is passed over after one search
(plans/triggers.py); of the others each rule whose own triggers are there is tried by
its constant pattern, and only the rules that match are worked out further, from a
table of rules. Two lines together hold a trigger if one of them does or if it lies
across the end of the first, so they aren't searched again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds, let, py_lstrip, py_strip, spaced, spans
from ..plans.rules import EMOJI, GENERATION, Pack
from ..plans.triggers import pack_triggers, rule_trigger
from .prose import BLOCK_START, extracted, nothing, settled, unfolded

HIT = "array<struct<line:int,pass:int,ordinal:int,class:string,label:string,match:string,text:string>>"
LINE, EMOJI_PASS, WRAP, PHANTOM, EMPTY, BULLETS, CONFETTI = range(7)
BULLET_LEAD = rf"(?U)^\s*(?:[-+*]\s+)?{EMOJI}"


def hit(line: Column, step: int, ordinal: Column, rule_class: Column, label: Column, match: Column, text: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(step).alias("pass"), ordinal.alias("ordinal"), rule_class.alias("class"), label.alias("label"), match.alias("match"), text.alias("text"))


def _table(pack: Pack) -> Column:
    """The rules as an array; suppressors are empty where there are none."""
    row = lambda r: F.struct(F.lit(r.cls).alias("class"), F.lit(r.label).alias("label"), F.lit(r.regex).alias("regex"), F.lit(r.raw).alias("raw"), F.lit(r.suppress or "").alias("suppress"), F.lit(r.positional).alias("positional"), F.lit(r.path_suppress or "").alias("path_suppress"))
    return F.array(*[row(r) for r in pack.rules])


def _first_of_class(hits: Column) -> Column:
    return let(hits, lambda all_: F.filter(all_, lambda h, i: F.array_position(F.transform(all_, lambda x: x["class"]), h["class"]) == i + 1))


def _overlapped(hay: Column, pattern: Column, start: Column, end: Column) -> Column:
    """Whether some match of pattern overlaps [start, end)."""
    return F.exists(spans(hay, pattern), lambda q: (q["s"] < end) & (start < q["e"]))


def _path_allows(rule: Column) -> Column:
    return (rule["path_suppress"] == "") | ~F.rlike(F.col("path"), rule["path_suppress"])


def _allowed(rule: Column, hay: Column) -> Column:
    """Not suppressed, for the rule's first match in hay."""
    start = F.regexp_instr(hay, rule["regex"]) - 1
    free = let(start, lambda s: ~_overlapped(hay, rule["suppress"], s, s + F.length(F.regexp_substr(hay, rule["regex"]))))
    clear = F.when(rule["suppress"] == "", True).when(rule["positional"], free).otherwise(~F.rlike(hay, rule["suppress"]))
    return clear & _path_allows(rule)


def line_hits(pack: Pack, x: Column) -> Column:
    """All hits of a line of prose x, the first of each class."""
    md = F.col("kind") == "markdown"
    heading = md & py_lstrip(x["raw"]).rlike(pack.heading)
    table = md & py_lstrip(x["raw"]).startswith("|")
    matching = []
    for i, r in pack.line_rules():
        hay = x["raw"] if r.raw else x["plain"]
        when = holds(spaced(hay), rule_trigger(r)) & hay.rlike(r.regex)
        when = heading & when if r.heading_only else md & when if r.raw else when
        if r.cls == pack.long_table_class:
            when = when & ~(table & (F.length(x["raw"]) > 200))
        matching.append(F.when(when, F.lit(i)))

    def worked_out(i: Column) -> Column:
        def of(rule: Column) -> Column:
            hay = F.when(rule["raw"], x["raw"]).otherwise(x["plain"])
            return let(hay, lambda h: F.when(_allowed(rule, h), hit(x["line_no"], LINE, i, rule["class"], rule["label"], py_strip(F.regexp_substr(h, rule["regex"])), x["stripped"])))

        return let(F.get(_table(pack), i), of)

    found = F.transform(F.filter(F.array(*matching), lambda i: i.isNotNull()), worked_out) if matching else nothing(HIT)
    if pack.emoji:
        shown = md & ~table & ((heading & x["raw"].rlike(EMOJI)) | x["raw"].rlike(BULLET_LEAD))
        found = F.concat(found, F.array(F.when(shown, hit(x["line_no"], EMOJI_PASS, F.lit(0), F.lit("5"), F.lit("emoji decoration"), F.regexp_extract(x["raw"], EMOJI, 0), x["stripped"]))))
    return _first_of_class(F.filter(found, lambda h: h.isNotNull()).cast(HIT))


def wrap_hits(pack: Pack, x: Column, following: Column, joined: Column) -> Column:
    """Hits across a line's end: x and the line of prose after it, joined. The first of each class."""
    cut = F.length(x["plain"])
    matching = [F.when(holds(spaced(joined), rule_trigger(r)) & joined.rlike(r.regex), F.lit(i)) for i, r in pack.wrap_rules()]

    def worked_out(i: Column) -> Column:
        def of(rule: Column) -> Column:
            across = F.get(F.filter(spans(joined, rule["regex"]), lambda q: (q["s"] < cut) & (q["e"] > cut)), F.lit(0))

            def said(q: Column) -> Column:
                clear = F.when(rule["suppress"] == "", True).when(rule["positional"], ~_overlapped(joined, rule["suppress"], q["s"], q["e"])).otherwise(~F.rlike(joined if pack.joined_suppress else q["m"], rule["suppress"]))
                return F.when(q.isNotNull() & clear & _path_allows(rule), hit(x["line_no"], WRAP, i, rule["class"], rule["label"], py_strip(q["m"]), F.concat_ws(" ", x["stripped"], following["stripped"])))

            return let(across, said)

        return let(F.get(_table(pack), i), of)

    found = F.transform(F.filter(F.array(*matching), lambda i: i.isNotNull()), worked_out)
    return _first_of_class(F.filter(found, lambda h: h.isNotNull()).cast(HIT))


def scanned(files: DataFrame, pack: Pack) -> DataFrame:
    """files (extracted) with hits: those of the line pass and those across to the next line."""
    triggers, raw_triggers, longest = pack_triggers(pack)
    md = F.col("kind") == "markdown"
    none = nothing(HIT)

    def on_line(x: Column) -> Column:
        def of(held: Column) -> Column:
            may = held | (md & py_lstrip(x["raw"]).startswith("#"))
            if raw_triggers:
                may = may | (md & holds(spaced(x["raw"]), raw_triggers))
            if pack.emoji:
                may = may | (md & x["raw"].rlike(EMOJI))
            return F.struct(held.alias("holds"), F.when(may, line_hits(pack, x)).otherwise(none).alias("hits"))

        return let(holds(spaced(x["plain"]), triggers), of)

    if not pack.rules and not pack.emoji:
        return files.withColumn("hits", none)
    own = settled(files.withColumn("on_line", F.transform("prose", on_line)), *files.columns, "on_line")
    on_lines = F.transform("on_line", lambda x: x["hits"])
    if not pack.wrap_rules():
        return own.withColumn("hits", F.flatten(on_lines)).drop("on_line")

    def across(i: Column) -> Column:
        x, following = F.get("prose", i), F.get("prose", i + 1)
        here, there = F.get("on_line", i), F.get("on_line", i + 1)
        end = F.concat_ws(" ", F.lit(""), F.substring(x["plain"], -longest, longest), F.substring(following["plain"], 1, longest), F.lit(""))
        held = here["holds"] | there["holds"] | holds(end, triggers)
        closed = md & py_lstrip(x["raw"]).rlike(r"^[#|]")
        joins = (following["line_no"] == x["line_no"] + 1) & ~closed & ~following["raw"].rlike(BLOCK_START)

        def of(joined: Column) -> Column:
            seen = F.transform(F.concat(here["hits"], there["hits"]), lambda h: h["class"])
            return let(seen, lambda s: F.filter(wrap_hits(pack, x, following, joined), lambda h: ~F.array_contains(s, h["class"])))

        return F.when(joins & held, let(F.concat_ws(" ", x["plain"], following["plain"]), of)).otherwise(none)

    wraps = F.when(F.size("prose") > 1, F.transform(F.sequence(F.lit(0), F.size("prose") - 2), across)).otherwise(F.array().cast(f"array<{HIT}>"))
    return settled(own.withColumn("hits", F.flatten(F.concat(on_lines, wraps))), *files.columns, "hits")


FOUND = ["file_ord", "path", "line", "class", "label", "match", "text", "pass", "ordinal"]


def rows_of(files: DataFrame, hits: str | Column = "hits") -> DataFrame:
    """A row for each hit of the files."""
    return unfolded(files, hits, "file_ord", "path", first="class").select(*FOUND)


def first_wins(found: DataFrame) -> DataFrame:
    """One finding for each file, line and class: the earliest pass, then the earliest rule."""
    nth = F.row_number().over(Window.partitionBy("file_ord", "line", "class").orderBy("pass", "ordinal", "match"))
    return found.withColumn("nth", nth).where("nth = 1").drop("nth")


def raw_rule_hits(files: DataFrame, *packs: Pack) -> DataFrame:
    """Every suppressible rule's first match on every line before suppression and dedupe, with pack and suppressed."""
    told = [(p, i, r) for p in packs for i, r in p.line_rules() if r.suppress or r.path_suppress]
    triggers, raw_triggers, _ = pack_triggers(replace(packs[0], rules=tuple(replace(r, heading_only=False) for _, _, r in told)))

    def of(x: Column) -> Column:
        rows = []
        for p, i, r in told:
            hay = x["raw"] if r.raw else x["plain"]
            here = holds(spaced(hay), rule_trigger(r)) & hay.rlike(r.regex)
            rule = F.get(_table(p), F.lit(i))
            rows.append(F.when(here, F.struct(F.lit(p.name).alias("pack"), x["line_no"].alias("line"), F.lit(r.label).alias("label"), py_strip(F.regexp_extract(hay, r.regex, 0)).alias("match"), (~_allowed(rule, hay)).alias("suppressed"))))
        return F.filter(F.array(*rows), lambda h: h.isNotNull())

    def may(x: Column) -> Column:
        found = holds(spaced(x["plain"]), triggers)
        return found | holds(spaced(x["raw"]), raw_triggers) if raw_triggers else found

    return unfolded(files, F.flatten(F.transform(F.filter("prose", may), of)), "file_ord", "path", first="label")


def findings(corpus: DataFrame, pack: Pack, listing: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All findings of a pack, of the passes that its classes need; each file is read and scanned once.

    listing: (path) of what exists, for relative links; the corpus by default. files: the corpus as scanned() gives it, if that is at hand.
    """
    from . import structure

    files = files if files is not None else scanned(extracted(corpus), pack)
    if pack.name != GENERATION.name:
        return rows_of(files)
    hits, links = ["hits"], "0d" in pack.classes
    if {"0c", "6"} & set(pack.classes):
        files, hits = structure.shapes(files), [*hits, "shapes"]
    if links:
        files, hits = structure.linked(files), [*hits, "links"]
    found = rows_of(files, F.concat(*hits))
    return first_wins(structure.without_present(found, listing if listing is not None else corpus.select("path")) if links else found)
