"""Lines, prose and comment extraction.

A corpus is (file_ord long, path string, content string), one row a file. All that
a line's meaning depends on is in its own file, so everything here is array work
within the row: no window, and no exchange unless there are fewer splits than cores. Where a state runs from line to line
(fences, comments), the lines are cut into segments at the few lines that change
it, and each segment is a slice, so the work stays in proportion to the lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, plain, py_strip, split_lines
from .paths import comment_syntax

FENCE = r"(?U)^\s*(?:```|~~~)"
#: A line that opens a block: a heading, a table row, a bullet, a number, a quotation.
BLOCK_START = r"(?U)^\s*(?:#{1,6}\s|[|>]|[-+*]\s|\d+[).]\s)"
FRONT_MATTER_LINES = 60
PROSE = "array<struct<line_no:int,raw:string,stripped:string,plain:string>>"


def nothing(kind: str) -> Column:
    return F.array().cast(kind)


def told(items: Column, of: Callable[[Column, Column], Column]) -> Column:
    """What of(item, place from 0) gives, nulls left out."""
    return F.filter(F.transform(items, of), lambda x: x.isNotNull())


def at(name: str, i: Column) -> Column:
    """Item i (from 0) of an array column, for use in a lambda. Two mentions of the column: one alone
    would let Catalyst put the array's whole expression there, to be worked out for each item.
    """
    return F.when(F.size(name) > i, F.get(name, i))


def settled(files: DataFrame, *columns: str) -> DataFrame:
    """files with these columns, worked out here once: no filter or projection above is moved below this
    point, where it would copy the expressions that they are made from.
    """
    return files.select(F.inline_outer(F.array(F.struct(*columns))))


def unfolded(files: DataFrame, array: str | Column, *columns: str, first: str = "line_no") -> DataFrame:
    """columns and the fields of each struct of array, one of which (first) is never null.

    Not by inline(): from that Catalyst infers a filter, which copies all that the array is
    made from into each projection below.
    """
    return files.select(*columns, F.inline_outer(array)).where(F.col(first).isNotNull())


def segments(items: str, cuts: Column | str, each: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """each(item, its place from 1, number of its segment, place within the segment from 0) of all items.

    items names an array column; segments begin at the first item and at the places of cuts, in order.
    """
    array, ends = F.col(items), F.col(cuts) if isinstance(cuts, str) else cuts

    def segment(k: Column) -> Column:
        first = F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1))
        after = F.when(k == F.size(ends), F.size(array) + 1).otherwise(F.get(ends, k))
        return let(F.struct(first.alias("first"), (after - first).alias("n")), lambda s: F.transform(F.slice(array, s["first"], s["n"]), lambda x, i: each(x, s["first"] + i, k, i)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends)), segment))


def spread(corpus: DataFrame) -> DataFrame:
    """corpus over at least as many partitions as there are cores. A table that is read in that many
    splits, as any large one is, stays where it is; only a smaller one is exchanged.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus if corpus._jdf.queryExecution().toRdd().getNumPartitions() >= cores else corpus.repartition(cores, "file_ord")


def with_lines(corpus: DataFrame, keep_content: bool = False) -> DataFrame:
    """file_ord, path, kind and lines (an array)."""
    more = ["content"] if keep_content else []
    kind = F.when(comment_syntax(F.col("path")).isNull(), "markdown").otherwise("code")
    return spread(corpus).select("file_ord", "path", kind.alias("kind"), split_lines(F.col("content")).alias("lines"), *more)


def lines(corpus: DataFrame) -> DataFrame:
    """file_ord, path, line_no, raw of every line."""
    rows = corpus.select("file_ord", "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "raw"))
    return rows.select("file_ord", "path", (F.col("pos") + 1).alias("line_no"), "raw")


def is_markdown() -> Column:
    return F.col("kind") == "markdown"


def fenced(files: DataFrame, after: str, name: str) -> DataFrame:
    """files (with lines) with name: line_no, raw, is_fence and in_fence of each line of markdown; fences up to line `after` don't count."""
    here = told(F.col("lines"), lambda x, i: F.when((i >= F.col(after)) & (x.contains("```") | x.contains("~~~")) & x.rlike(FENCE), i + 1))
    own = files.withColumn("fences", F.when(is_markdown(), here).otherwise(nothing("array<int>")))
    rows = segments("lines", "fences", lambda x, n, k, i: F.struct(n.alias("line_no"), x.alias("raw"), ((k > 0) & (i == 0)).alias("is_fence"), ((k % 2 == 1) & (i > 0)).alias("in_fence")))
    return own.withColumn(name, F.when(is_markdown(), rows)).drop("fences")


def annotated(files: DataFrame) -> DataFrame:
    """files (with lines) with fm_end (last line of the front matter, 0 without one) and seen: of each
    line of markdown line_no, raw, is_fence, in_fence, stripped, shown (outside front matter and
    fences) and in_comment.
    """
    mark = lambda x: py_strip(x)
    closing = F.array_position(F.transform(F.slice("lines", F.lit(2), F.lit(FRONT_MATTER_LINES - 1)), lambda x: mark(x).isin("---", "...")), True)
    opened = is_markdown() & mark(F.get("lines", F.lit(0))).eqNullSafe("---") & (closing > 0)
    own = files.withColumn("fm_end", F.when(opened, closing.cast("int") + 1).otherwise(F.lit(0)))
    own = fenced(own, "fm_end", "ruled")
    shown = lambda x: (x["line_no"] > F.col("fm_end")) & ~x["is_fence"] & ~x["in_fence"]
    own = own.withColumn("ruled", F.transform("ruled", lambda x: F.struct("fm_end", x["line_no"].alias("line_no"), x["raw"].alias("raw"), x["is_fence"].alias("is_fence"), x["in_fence"].alias("in_fence"), py_strip(x["raw"]).alias("stripped"), shown(x).alias("shown"))))

    def event(x: Column, i: Column) -> Column:
        """A shown line that opens a comment (1) or closes one (0)."""
        closes = x["stripped"].contains("-->")
        return F.when(x["shown"] & (closes | x["stripped"].startswith("<!--")), F.struct((i + 2).alias("next"), F.when(closes, 0).otherwise(1).alias("state")))

    own = own.withColumn("events", told(F.col("ruled"), event)).withColumn("cuts", F.transform("events", lambda e: e["next"]))
    inside = lambda k: (k > 0) & (at("events", k - 1)["state"] == 1)
    fields = ["line_no", "raw", "is_fence", "in_fence", "stripped", "shown"]
    seen = segments("ruled", "cuts", lambda x, n, k, i: F.struct(*[x[f].alias(f) for f in fields], (x["shown"] & F.coalesce(inside(k), F.lit(False))).alias("in_comment")))
    return own.withColumn("seen", F.when(is_markdown(), seen)).drop("ruled", "events", "cuts")


def _line(n: Column, raw: Column, stripped: Column) -> Column:
    return F.struct(n.alias("line_no"), raw.alias("raw"), stripped.alias("stripped"), plain(raw).alias("plain"))


def _markdown_prose() -> Column:
    kept = F.filter("seen", lambda x: x["shown"] & ~x["in_comment"] & ~x["stripped"].startswith("<!--") & (x["stripped"] != ""))
    return F.transform(kept, lambda x: _line(x["line_no"], x["raw"], x["stripped"]))


# ------------------------------------------------------------------ comments

_pragmas = "@ts- biome- coverage: cspell: eslint flake8: fmt: isort: istanbul jshint mypy: nolint noqa nosec NOSONAR pragma prettier pylint ruff: tslint: type: vi: vim: yapf:".split()
DIRECTIVE = r"(?iU)^(?:-\*-|spell-?checker:|(?:end)?region\b|" + "|".join(_pragmas) + ")"
WORK_MARKER = r"^(?:fixme|todo|BUG|FIXME|HACK|TODO|XXX)\b"


def _marker(c: Column, quoted: str) -> Column:
    """0-based place of a marker in column 0 or after a blank, or null."""
    at = F.regexp_instr(c, F.lit(rf"(?<![^ \t]){quoted}"))
    return F.when(at > 0, at - 1)


def _code_line(raw: Column, i: Column) -> Column:
    """What a line of source says before its state is known: the first marker, and whether it opens or closes a block."""
    spec = F.col("spec")
    found = F.struct(
        raw.alias("raw"),
        F.when(spec.contains("#"), _marker(raw, "#")).alias("hash"),
        F.least(F.when(spec.contains("/"), _marker(raw, "//")), F.when(spec.contains("-"), _marker(raw, "--"))).alias("two"),
        F.when(spec.contains("*"), _marker(raw, r"/\*")).alias("block"),
        F.locate("*/", raw).alias("close"),
        ((i == 0) & raw.startswith("#!")).alias("shebang"),
    )

    def placed(m: Column) -> Column:
        at = F.least(m["hash"], m["two"])
        is_block = m["block"].isNotNull() & (at.isNull() | (m["block"] < at))
        start = F.when(is_block, m["block"]).otherwise(at) + F.when(~is_block & m["hash"].isNotNull() & (at == m["hash"]), 1).otherwise(2)
        return F.struct(m["raw"].alias("raw"), is_block.alias("is_block"), m["close"].alias("close"), m["shebang"].alias("shebang"), F.substring(m["raw"], start + 1, F.lit(1 << 30)).alias("rest"))

    def ended(p: Column) -> Column:
        inner = F.locate("*/", p["rest"])
        opens, closes = p["is_block"] & (inner == 0) & ~p["shebang"], (p["close"] > 0) & ~p["shebang"]
        event = F.when(opens & closes, 2).when(opens, 1).when(closes, 0)  # 2: closes one block and opens another
        return F.struct((i + 1).alias("line_no"), p["raw"].alias("raw"), p["is_block"].alias("is_block"), p["close"].alias("close"), p["rest"].alias("rest"), inner.alias("inner"), p["shebang"].alias("shebang"), event.alias("event"))

    return let(let(found, placed), ended)


def _commented(files: DataFrame) -> DataFrame:
    """files (with lines) with comments: the comment lines of source files, as prose.

    A line maps the state before it (inside a block comment or not) to that after
    it: it sets the state, swaps it, or keeps it. Lines are cut where it may change.
    """
    code = ~is_markdown()
    own = files.withColumn("spec", comment_syntax(F.col("path"))).withColumn("marked", F.when(code, F.transform("lines", _code_line)))
    own = own.withColumn("events", F.filter("marked", lambda x: x["event"].isNotNull())).withColumn("cuts", F.transform("events", lambda e: e["line_no"] + 1))
    states = F.aggregate(
        F.transform("events", lambda e: e["event"]),
        F.struct(F.lit(0).alias("now"), nothing("array<int>").alias("all")),
        lambda acc, e: let(F.when(e == 2, 1 - acc["now"]).otherwise(e), lambda now: F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))),
    )["all"]
    swaps = F.exists("events", lambda e: e["event"] == 2)
    own = own.withColumn("states", F.when(swaps, states).otherwise(F.transform("events", lambda e: e["event"])))

    def said(x: Column, n: Column, k: Column, i: Column) -> Column:
        inside = F.when(x["close"] > 0, F.substring(x["raw"], F.lit(1), x["close"] - 1)).otherwise(x["raw"])
        outside = F.when(x["is_block"] & (x["inner"] > 0), F.substring(x["rest"], F.lit(1), x["inner"] - 1)).otherwise(x["rest"])
        text = F.when((k > 0) & (at("states", k - 1) == 1), inside).otherwise(outside)
        return F.struct(x["line_no"].alias("line_no"), F.when(~x["shebang"], py_strip(F.regexp_replace(py_strip(text), "^[#*/!]+", ""))).alias("text"))

    kept = F.filter(segments("marked", "cuts", said), lambda x: x["text"].rlike("[A-Za-z]") & ~x["text"].rlike(DIRECTIVE) & ~x["text"].rlike(WORK_MARKER))
    return own.withColumn("comments", F.when(code, F.transform(kept, lambda x: _line(x["line_no"], x["text"], x["text"])))).drop("spec", "marked", "events", "cuts", "states")


def extracted(corpus: DataFrame, keep_content: bool = False) -> DataFrame:
    """file_ord, path, kind, n_lines (all lines of markdown, the comment lines of source files), lines,
    seen (see annotated()) and prose: line_no, raw, stripped and plain of what is to be read of the
    file, in order.
    """
    files = _commented(annotated(with_lines(corpus, keep_content))).withColumn("prose", F.when(is_markdown(), _markdown_prose()).otherwise(F.col("comments")).cast(PROSE))
    n = F.when(is_markdown(), F.size("lines")).otherwise(F.size("comments")).cast("long")
    return settled(files.withColumn("n_lines", n), "file_ord", "path", "kind", "n_lines", "lines", "seen", "prose", *(["content"] if keep_content else []))


def readable(corpus: DataFrame) -> DataFrame:
    """file_ord, path, kind, line_no, raw, stripped, plain: prose of markdown and comments of source files."""
    return unfolded(extracted(corpus), "prose", "file_ord", "path", "kind")


def line_counts(corpus: DataFrame) -> DataFrame:
    """file_ord, path, lines."""
    return extracted(corpus).select("file_ord", "path", F.col("n_lines").alias("lines"))
