"""Path predicates: records, kinds, exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRUNED = frozenset({".git", ".venv", "build", "dist", "next", "node_modules", "target", "vendor"}) - {"next"} | {".next"}
RECORD_DIRS = sorted("adr adrs changelog decisions journal meeting-notes minutes plans postmortems proposals retros rfc rfcs specs superpowers".split())
RECORD_FILE = r"(?i)(?:^|/)(?:HISTORY|CHANGELOG|NEWS\.md|RELEASES|\d{4}-\d{2}-\d{2}[_-])"

_hash = "bash cmake ex exs jl mk nix pl py r rb sh tf toml yaml yml zsh"
_slash = "c cc cjs cpp cs dart go h hh hpp java js jsx kt kts m mjs mm proto rs scala swift ts tsx"
_dash = "hs lua sql"
#: Extension to the signs that open its comments: # line, / for //, - for --, * for a block.
SYNTAX = {e: "#" for e in _hash.split()} | {e: "/*" for e in _slash.split()} | {e: "-" for e in _dash.split()} | {"php": "/#*"}
HASH_NAMES = ("Dockerfile", "GNUmakefile", "Justfile", "Makefile", "justfile", "makefile")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension in lower case, as '' where there is none; leading dots open no extension."""
    return F.lower(F.regexp_extract(F.regexp_replace(basename(path), "^[.]+", ""), r"[.]([^.]*)$", 1))


def comment_syntax(path: Column) -> Column:
    """The comment signs of a source file's language, null for other files."""
    known = F.create_map(*[F.lit(x) for pair in SYNTAX.items() for x in pair])
    return F.when(basename(path).isin(*HASH_NAMES), "#").otherwise(F.try_element_at(known, extension(path)))


def is_markdown(path: Column) -> Column:
    return basename(path).rlike(r"[.](?:md|markdown)$")


def is_minified(path: Column) -> Column:
    return basename(path).contains(".min.")


def is_record(path: Column) -> Column:
    """A point-in-time record: by a directory of its path or by its name."""
    norm = F.concat(F.lit("/"), F.regexp_replace(path, r"^[./]+", ""))
    return reduce(lambda a, b: a | b, [norm.contains(f"/{d}/") for d in RECORD_DIRS]) | norm.rlike(RECORD_FILE)


def is_self(path: Column, own: list[str]) -> Column:
    """An absolute path that is one of own, or lies under one of own that ends in a slash."""
    return reduce(lambda a, b: a | b, [path.startswith(x) if x.endswith("/") else path == x for x in own], F.lit(False))


def excluded(path: Column, substrings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.contains(x) for x in substrings], F.lit(False))


def normal_path(path: Column) -> Column:
    """The path with its . and .. steps resolved."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    done = F.aggregate(
        steps,
        empty,
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def classified(files: DataFrame) -> DataFrame:
    """files with kind: markdown, code, minified or other."""
    p = F.col("path")
    return files.withColumn("kind", F.when(is_markdown(p), "markdown").when(comment_syntax(p).isNotNull(), F.when(is_minified(p), "minified").otherwise("code")).otherwise("other"))


def collect(files: DataFrame, excludes: list[str] = (), own: list[str] = (), include_records: bool = False, include_code: bool = False, named: list[str] = (), base: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus, the records passed over, and the source files passed over.

    named: files that were asked for by name; a source file among them is taken
    without include_code, a minified one too. base: the folder that relative paths
    start from, for own, whose paths are absolute.
    """
    known = classified(files)
    p = F.col("path")
    asked = p.isin(*named) if named else F.lit(False)
    whole = normal_path(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))) if base else p
    take = (F.col("kind") == "markdown") | (F.col("kind").isin("code", "minified") & asked) | ((F.col("kind") == "code") & F.lit(include_code))
    left = known.where((F.col("kind") == "code") & ~asked & ~F.lit(include_code)).drop("kind")
    kept = known.where(take & ~excluded(p, list(excludes)) & ~is_self(whole, list(own))).drop("kind")
    if include_records:
        return kept, kept.where(F.lit(False)), left
    return kept.where(~is_record(p)), kept.where(is_record(p)), left


def class_matches(cls: Column, want: str) -> Column:
    """Exact, or a family: what follows is letters alone. An empty want means all."""
    return F.lit(True) if not want else (cls == want) | (cls.startswith(want) & F.substring(cls, len(want) + 1, 1 << 10).rlike(r"(?U)^\p{L}+$"))


def in_family(cls: str, want: str) -> bool:
    """class_matches() of plain strings."""
    return not want or cls == want or (cls.startswith(want) and cls[len(want) :].isalpha())
