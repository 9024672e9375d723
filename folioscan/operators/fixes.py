"""Rewrites that lose no fact, as chained column expressions over raw prose lines, within the row of a file.

What no rewrite touches stays as it is, form feeds and other odd line breaks too;
carriage returns become newlines, as reading text makes them.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import holds, let, line_breaks, py_rstrip, spaced, strip_phrase
from ..plans.rules import APOS, EMOJI, alt
from ..plans.triggers import bordered, trie
from .prose import at, extracted, is_markdown, nothing, settled, unfolded

_that = r" that\s+"
#: (what is said of it, pattern); an anchored pattern takes its repetitions along.
REMOVED_REVISION = [
    ("removed 'it is worth … that'", r"(?U)\b[Ii]t(?: is|" + APOS + "s) worth " + alt("mentioning; noting; pointing out") + _that),
    ("removed 'it is important to … that'", r"(?U)\b[Ii]t(?: is|" + APOS + "s) important to " + alt("note; remember; understand") + _that),
    ("removed 'it should be noted that'", r"(?U)\b[Ii]t should be noted" + _that),
    ("removed 'please note that'", r"(?U)\b[Pp]lease note" + _that),
    ("removed 'Worth noting:'", r"(?U)^(?:\**Worth " + alt("knowing; mentioning; noting") + r"\**:\s*)+"),
    ("removed 'needless to say'", r"(?U)\b[Nn]eedless to say,\s*"),
    ("removed 'Of course,'", r"(?U)^(?:Of course,\s+)+"),
    ("removed 'it goes without saying that'", r"(?U)\b[Ii]t goes without saying" + _that),
    ("removed 'as you can see'", r"(?U)\b[Aa]s you can see,\s*"),
    ("removed 'without further ado'", r"(?U)\b[Ww]ithout further ado,\s*"),
]
COUNT_WORTH = r"(?U)^(\**)(" + alt("Eight; Five; Four; Nine; Seven; Six; Ten; Three; Two") + r"\s+[a-z][-\w]*)\s+worth\s+[\w\s]+?(\**:)\s*$"
THEN_CONFIRMED = r"(?U)\bThen confirmed\b"
OPENERS = [(f"removed '{o},'", rf"(?U)\b{o},\s+") for o in ("In conclusion", "In summary", "To summarize")]
PLEASANTRY = (
    r"(?iU)^\W*(?:"
    + alt("Feel free to reach out; I hope this helps; Hope this helps; Let me know if you have any questions; Let me know if you need anything else; Thanks for reading", r"Happy \w+ing", "Let" + APOS + "s dive in")
    + r"(?:\s*[.!])*\s*)+\W*$"
)
EMOJI_GLUE = EMOJI[:-1] + r"\x{FE0F}\x{200D}]"


def _step(state: Column, said: str, fn) -> Column:
    """state (new, changes) after one rewrite of new."""

    def put(st: Column) -> Column:
        named = F.array(F.lit(said))
        return let(fn(st["new"]), lambda after: F.struct(after.alias("new"), F.when(after != st["new"], F.concat(st["changes"], named)).otherwise(st["changes"]).alias("changes")))

    return let(state, put)


EDIT = "array<struct<line_no:int,old:string,new:string,changes:array<string>>>"


def _start(raw: Column) -> Column:
    return F.struct(raw.alias("new"), F.array().cast("array<string>").alias("changes"))


def _some(raw: Column, patterns: list[str]) -> Column:
    """Whether a rewrite may change the line: one of its patterns matches, which are tried where a trigger of theirs is."""
    return holds(spaced(raw), trie(set().union(*map(bordered, patterns)))) & reduce(Column.__or__, [raw.rlike(p) for p in patterns])


def revision_edit(raw: Column) -> tuple[Column, Column]:
    """Whether a rewrite may change the line, and new and changes (empty where nothing changes)."""
    first = _step(_start(raw), "dropped the 'worth …' wrapper of a list's opening", lambda c: F.regexp_replace(c, COUNT_WORTH, "$1$2$3"))

    def others(st: Column) -> Column:
        out = st
        for said, pattern in REMOVED_REVISION:
            out = _step(out, said, partial(strip_phrase, pattern=pattern))
        out = _step(out, "removed 'Then' before 'confirmed'", lambda c: F.regexp_replace(c, THEN_CONFIRMED, "Confirmed"))
        return F.when(F.size(st["changes"]) > 0, st).otherwise(out)

    return _some(raw, [COUNT_WORTH, THEN_CONFIRMED, *[p for _, p in REMOVED_REVISION]]), let(first, others)


def generation_edit(raw: Column) -> tuple[Column, Column]:
    """As revision_edit(); a null new deletes the line."""

    def bare(c: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(c, EMOJI_GLUE, ""), r"(?U)(#{1,6})\s+", "$1 ")
        heading = c.rlike(r"(?U)^#{1,6}\s") & c.rlike(EMOJI)
        return F.when(heading, F.regexp_replace(py_rstrip(one), "  +", " ")).otherwise(c)

    state = _step(_start(raw), "stripped emoji from a heading", bare)
    for said, pattern in OPENERS:
        state = _step(state, said, partial(strip_phrase, pattern=pattern))
    gone = F.struct(F.lit(None).cast("string").alias("new"), F.array(F.lit("deleted a line of pleasantries")).alias("changes"))
    return raw.rlike(EMOJI) | _some(raw, [PLEASANTRY, *[p for _, p in OPENERS]]), F.when(raw.rlike(PLEASANTRY), gone).otherwise(state)


EDITS = {"revision": revision_edit, "generation": generation_edit}


def edited(corpus: DataFrame, pack: str, *more: str, files: DataFrame | None = None) -> DataFrame:
    """file_ord, path, units and edits of the files, and more of their columns. files: the corpus as extracted() gives it with content, if that is at hand.

    units: the lines with what isn't a newline of their breaks, and newlines. edits: line_no, old, new
    and changes of the prose lines that a rewrite changes; never of source files.
    """
    content = corpus.select(F.col("file_ord").alias("ord"), "path", "content")
    files = files if files is not None else extracted(content.withColumnRenamed("ord", "file_ord"), keep_content=True)
    files = files.withColumn("breaks", F.when(is_markdown(), line_breaks(F.col("content"))))
    newline = F.lit(r"^(?:\r\n|[\r\n])$")
    units = F.zip_with("lines", "breaks", lambda x, found: let(F.coalesce(found, F.lit("")), lambda b: F.struct(F.when(F.rlike(b, newline), x).otherwise(F.concat(x, b)).alias("text"), F.when(F.rlike(b, newline), "\n").otherwise("").alias("newline"))))
    files = files.withColumn("units", F.when(is_markdown(), units))

    def of(x: Column) -> Column:
        def told(old: Column) -> Column:
            may, state = EDITS[pack](old)
            return F.when(may, let(state, lambda st: F.when(F.size(st["changes"]) > 0, F.struct(x["line_no"].alias("line_no"), old.alias("old"), st["new"].alias("new"), st["changes"].alias("changes")))))

        return let(at("units", x["line_no"] - 1)["text"], told)

    made = F.filter(F.transform("prose", of), lambda e: e.isNotNull()).cast(EDIT)
    return settled(files.withColumn("edits", F.when(is_markdown(), made).otherwise(nothing(EDIT))), "file_ord", "path", "units", "edits", *more)


def edits(corpus: DataFrame, pack: str) -> DataFrame:
    """file_ord, path, line_no, old, new, changes."""
    return unfolded(edited(corpus, pack), "edits", "file_ord", "path")


def fix_count(corpus: DataFrame, pack: str) -> DataFrame:
    return edited(corpus, pack).agg(F.coalesce(F.sum(F.size("edits")), F.lit(0)).cast("long").alias("safe_fixes"))


def rewritten(corpus: DataFrame, pack: str) -> DataFrame:
    """file_ord, path and new content of the files that have edits."""
    files = edited(corpus, pack)

    def stretch(k: Column) -> Column:
        """The lines after edit k - 1 and before edit k, then what edit k makes of its line."""
        first = F.when(k == 0, F.lit(1)).otherwise(F.get("edits", k - 1)["line_no"] + 1)
        after = F.when(k == F.size("edits"), F.size("units") + 1).otherwise(F.get("edits", k)["line_no"])
        kept = F.array_join(F.transform(F.slice("units", first, after - first), lambda u: F.concat(u["text"], u["newline"])), "")
        return F.concat(kept, F.coalesce(F.concat(F.get("edits", k)["new"], F.get("units", F.get("edits", k)["line_no"] - 1)["newline"]), F.lit("")))

    content = F.array_join(F.transform(F.sequence(F.lit(0), F.size("edits")), stretch), "")
    return unfolded(files, F.when(F.size("edits") > 0, F.array(F.struct(content.alias("content")))), "file_ord", "path", first="content")
