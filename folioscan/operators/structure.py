"""Structural detectors: shapes that no single line shows. Markdown alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_code, py_strip
from .match import BULLETS, CONFETTI, EMPTY, FOUND, HIT, PHANTOM, hit
from .paths import normal_path
from .prose import fenced, is_markdown, nothing, told, unfolded

BOLD_BULLET = r"(?U)^\s*(?:\d+[).]|[-+*])\s+\*\*[^*]+\*\*"
RUN_LEAST, BREAKS_LEAST = 5, 3
THEMATIC = r"(?U)^\s{0,3}(?:_{3,}|\*{3,}|-{3,})\s*$"
LINK = r"""!?\[[^\]]*\]\(\s*<?([^)>\s]+)>?\s*(?:"[^"]*")?\)"""


def decoded(target: Column) -> Column:
    """Percent escapes read as UTF-8; malformed ones stay, and a plus is a plus."""
    safe = F.regexp_replace(F.regexp_replace(target, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), target)


def _resolved(path: Column, target: Column) -> Column:
    """The path that a target stands for; empty or null if it names none."""
    bare = decoded(F.regexp_replace(target, r"[#?].*$", ""))
    whole = normal_path(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), bare)))
    return F.when(bare != "", whole)


def linked(files: DataFrame) -> DataFrame:
    """files (extracted) with links: the relative link targets of prose, as hits by their place in the line."""

    def of(x: Column) -> Column:
        targets = F.regexp_extract_all(mask_code(x["raw"]), F.lit(LINK), F.lit(1))
        one = lambda t, nth: F.when(~t.rlike(r"^(?:[A-Za-z][-+.A-Za-z0-9]*:|[#/{<])") & ~t.contains("$"), hit(x["line_no"], PHANTOM, nth, F.lit("0d"), F.lit("phantom relative link"), t, x["stripped"]))
        return told(targets, one)

    found = F.flatten(F.transform(F.filter("prose", lambda x: x["raw"].contains("](")), of)).cast(HIT)
    return files.withColumn("links", F.when(is_markdown(), found).otherwise(nothing(HIT)))


def without_present(found: DataFrame, listing: DataFrame) -> DataFrame:
    """found without the links to what listing (path: files) holds, as a file or a folder; all other findings stay."""
    known = listing.select(normal_path(F.col("path")).alias("p"))
    steps = F.split("p", "/")
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("there"))
    there = folders.where("there <> ''").distinct()
    is_link = F.col("pass") == PHANTOM
    # what is no link gets a key of its file's that no path has, so that it meets nothing and all keys together stay spread
    named = found.withColumn("resolved", F.when(is_link, _resolved(F.col("path"), F.col("match"))).otherwise(F.concat(F.lit("\0"), "path"))).where("resolved <> ''")
    return named.join(there, F.col("resolved") == F.col("there"), "left_anti").select(*FOUND)


def phantom_links(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Relative links to what listing (path: files) doesn't hold, as a file or a folder; the first of a line."""
    lost = without_present(unfolded(linked(files), "links", "file_ord", "path", first="class").select(*FOUND), listing)
    first = lost.groupBy("file_ord", "path", "line", "class", "label", "text", "pass").agg(F.min_by("match", "ordinal").alias("match"))
    return first.withColumn("ordinal", F.lit(0)).select(*FOUND)


def _body() -> Column:
    """What counts for an empty section: a heading that the next non-blank line, of its depth or above,
    follows at once. Front matter and comments are lines like any other; fenced lines are body, blank ones too.
    """
    inside = lambda x: x["is_fence"] | x["in_fence"]
    depth = lambda x: F.when(~inside(x), F.length(F.regexp_extract(x["raw"], r"(?U)^(#{1,6})\s+\S", 1))).otherwise(0)
    body = F.transform(F.filter("every", lambda x: inside(x) | (py_strip(x["raw"]) != "")), lambda x: F.struct(x["line_no"].alias("line_no"), x["raw"].alias("raw"), depth(x).alias("depth")))
    return body


def shapes(files: DataFrame) -> DataFrame:
    """files (extracted) with shapes: the findings of empty sections, bold bullets and thematic breaks."""
    own = fenced(files.withColumn("zero", F.lit(0)), "zero", "every").withColumn("body", _body()).drop("zero", "every")
    pairs = F.zip_with("body", F.slice("body", F.lit(2), F.size("body")), lambda x, after: F.struct(x.alias("x"), after["depth"].alias("after"), after.isNull().alias("last")))
    bare = F.filter(pairs, lambda p: (p["x"]["depth"] > 0) & (p["last"] | ((p["after"] > 0) & (p["after"] <= p["x"]["depth"]))))

    def empty(p: Column) -> Column:
        text = py_strip(p["x"]["raw"])
        return hit(p["x"]["line_no"], EMPTY, F.lit(0), F.lit("0c"), F.lit("empty section"), text, text)

    # bullets in a row: the line numbers that match, cut where one doesn't follow the one before
    own = own.withColumn("bold", told(F.col("lines"), lambda x, i: F.when(x.rlike(BOLD_BULLET), i + 1)))
    opens = told(F.col("bold"), lambda n, i: F.when((i == 0) | (F.get("bold", i - 1) != n - 1), i))
    own = own.withColumn("opens", opens)
    runs = F.transform("opens", lambda i, k: F.struct(F.get("bold", i).alias("line"), (F.coalesce(F.get("opens", k + 1), F.size("bold")) - i).alias("n")))

    def run(r: Column) -> Column:
        n = r["n"].cast("string")
        return hit(r["line"], BULLETS, F.lit(0), F.lit("6"), F.lit("bold-term bullet run"), F.concat(n, F.lit(" consecutive bullets")), F.concat(n, F.lit(" consecutive '**Term**: …' bullets starting here")))

    # breaks outside front matter and fences; a rule under text is no break
    ruled = F.filter("seen", lambda x: x["shown"] & x["raw"].rlike(THEMATIC) & (py_strip(F.coalesce(F.get("lines", x["line_no"] - 2), F.lit(""))) == ""))
    own = own.withColumn("ruled", F.transform(ruled, lambda x: x["line_no"]))
    n = F.size("ruled").cast("string")
    many = hit(F.get("ruled", F.lit(0)), CONFETTI, F.lit(0), F.lit("6"), F.lit("separator confetti"), F.concat(n, F.lit(" horizontal rules")), F.concat(n, F.lit(" horizontal rules in one document, first one here")))
    found = F.concat(
        F.transform(bare, empty).cast(HIT),
        F.transform(F.filter(runs, lambda r: r["n"] >= RUN_LEAST), run).cast(HIT),
        F.when(F.size("ruled") >= BREAKS_LEAST, F.array(many)).otherwise(nothing(HIT)).cast(HIT),
    )
    return own.withColumn("shapes", F.when(is_markdown(), found).otherwise(nothing(HIT))).drop("body", "bold", "opens", "ruled")
