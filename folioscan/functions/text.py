"""Text functions as Catalyst expressions: none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it (Java's Unicode \s lacks the four separators).
WS = r"[\s\x1C-\x1F]"
#: Line breaks as Python's str.splitlines sees them, and those of them that aren't newlines.
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
ODD_BREAKS = r"[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


#: The characters that WS stands for.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def py_lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def py_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def let(value: Column, fn) -> Column:
    """fn of a value that the plan then holds once, however often fn reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def holds(c: Column, pattern: str) -> Column:
    """As rlike, for long patterns in lambdas: there rlike makes a new string of the whole pattern for each value, while this keeps the compiled one."""
    return F.regexp_instr(c, F.lit(pattern)) > 0


def spaced(c: Column) -> Column:
    """The text as triggers are looked for in it."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def split_lines(c: Column) -> Column:
    """Lines of a text without their breaks; a closing break opens no further line. A null text has none."""
    own = F.coalesce(c, F.lit(""))
    parts = F.when(own.rlike(ODD_BREAKS), F.split(own, BREAKS, -1)).otherwise(F.split(own, "\n", -1))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(let(parts, lambda got: F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)))


def line_breaks(c: Column) -> Column:
    """The breaks of a text, in order: one less than its lines, or as many."""
    own = F.coalesce(c, F.lit(""))
    return F.when(own.rlike(ODD_BREAKS), F.regexp_extract_all(own, F.lit(BREAKS), F.lit(0))).otherwise(F.array_repeat(F.lit("\n"), F.size(F.split(own, "\n", -1)) - 1))


def mask_code(c: Column) -> Column:
    return F.when(c.contains("`"), F.regexp_replace(c, r"`[^`\n]+`", "`code`")).otherwise(c)


def plain(c: Column) -> Column:
    """Inline code masked, then emphasis marks that touch a word dropped."""
    marks = r"\*{1,3}|_{1,3}"
    return let(mask_code(c), lambda m: F.when(m.contains("*") | m.contains("_"), F.regexp_replace(m, rf"(?U)(?:{marks})(?=\S)|(?<=\S)(?:{marks})", "")).otherwise(m))


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def collision_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z ]", ""))


def words(c: Column) -> Column:
    """Words of a normalised text; an empty one has none."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def spans(c: Column, pattern: str | Column) -> Column:
    """All matches as an array of (s, e, m), with 0-based code point offsets."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(c, pattern, -1), F.length)
    hits = F.regexp_extract_all(c, pattern, F.lit(0))
    start = F.aggregate(
        let(hits, lambda h: F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, m: F.struct(g.alias("g"), m.alias("m")))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"),
        ),
    )
    return start["out"]


def strip_phrase(c: Column, pattern: str) -> Column:
    """Every match removed; a word that now opens its sentence gets a capital."""
    parts = F.split(c, pattern, -1)

    def put(acc: Column, part: Column) -> Column:
        opens = py_strip(acc).eqNullSafe("") | py_rstrip(acc).rlike("[.!?]$")
        return F.concat(acc, F.when(opens & part.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 30))).otherwise(part))

    return F.when(c.rlike(pattern), F.aggregate(F.slice(parts, 2, 1 << 20), F.element_at(parts, 1), put)).otherwise(c)
