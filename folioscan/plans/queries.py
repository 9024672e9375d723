"""A named query for each operator, over the planted corpus or the documents themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collision_key, normalise, plain, split_lines
from ..operators import echoes, fixes, match, paths, prose, report, structure
from .planted import files, plain_files
from .rules import GENERATION, REVISION, Pack

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHOWN = ["path", "line", "class", "label", "match", "text"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _markdown(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).where(paths.comment_syntax(F.col("path")).isNull())


def _lines(s: SparkSession, d: str) -> DataFrame:
    return prose.lines(_markdown(s, d))


def _seen(s: SparkSession, d: str) -> DataFrame:
    """Every line of markdown with its states."""
    return prose.unfolded(prose.annotated(prose.with_lines(_markdown(s, d))), "seen", "path")


def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    return echoes.paragraphs(prose.extracted(plain_files(s, d)))


def _standing(s: SparkSession, d: str) -> DataFrame:
    return paths.collect(files(s, d), include_code=True)[0]


# --------------------------------------------------------------- files and lines


@query
def corpus_records(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).select("path", paths.is_record(F.col("path")).alias("is_record"))


@query
def corpus_kinds(s: SparkSession, d: str) -> DataFrame:
    return paths.classified(files(s, d)).select("path", "kind")


@query
def path_excludes(s: SparkSession, d: str) -> DataFrame:
    return paths.collect(files(s, d), excludes=["/src1/", "quick"], own=["docs/en/src2/"], include_records=True, include_code=True)[0].select("path")


@query
def corpus_split(s: SparkSession, d: str) -> DataFrame:
    kept, records, left = paths.collect(files(s, d))
    named = lambda df, n: df.select("path", F.lit(n).alias("part"))
    return named(kept, "kept").unionByName(named(records, "record")).unionByName(named(left, "source"))


@query
def line_explode(s: SparkSession, d: str) -> DataFrame:
    return prose.lines(files(s, d)).select("path", "line_no", "raw")


@query
def line_counts(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).select("path", F.size(split_lines(F.col("content"))).cast("long").alias("lines"))


@query
def front_matter(s: SparkSession, d: str) -> DataFrame:
    return prose.annotated(prose.with_lines(_markdown(s, d))).select("path", F.col("fm_end").cast("long").alias("fm_end"))


@query
def fence_state(s: SparkSession, d: str) -> DataFrame:
    return _seen(s, d).where("is_fence or in_fence").select("path", "line_no", "is_fence", "in_fence")


@query
def html_comment_state(s: SparkSession, d: str) -> DataFrame:
    return _seen(s, d).where("shown and (in_comment or startswith(stripped, '<!--'))").select("path", "line_no", "in_comment")


@query
def prose_lines(s: SparkSession, d: str) -> DataFrame:
    return prose.readable(_markdown(s, d)).select("path", "line_no", "raw")


@query
def plain_text(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("path", "line_no", plain(F.col("raw")).alias("plain"))


@query
def normalised_text(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("path", "line_no", normalise(F.col("raw")).alias("normalised"), collision_key(F.col("raw")).alias("key"))


@query
def code_comments(s: SparkSession, d: str) -> DataFrame:
    corpus = files(s, d).where(paths.comment_syntax(F.col("path")).isNotNull())
    return prose.readable(corpus).select("path", "line_no", F.col("raw").alias("comment"))


# --------------------------------------------------------------------- findings


def _only(pack: Pack, *classes: str) -> Pack:
    """The pack's rules of these classes: classes don't bear on one another."""
    return replace(pack, rules=tuple(r for r in pack.rules if r.cls in classes), emoji=pack.emoji and "5" in classes, classes=classes)


def _class_query(pack: Pack, cls: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return match.findings(files(s, d), _only(pack, cls)).where(F.col("class") == cls).select(*SHOWN)

    return run


CLASS_QUERIES = {f"{short}_findings_class_{c.replace('.', '_')}": (pack, c) for short, pack in (("md", REVISION), ("sl", GENERATION)) for c in pack.classes}
QUERIES |= {name: _class_query(*of) for name, of in CLASS_QUERIES.items()}


@query
def suppressed_hits(s: SparkSession, d: str) -> DataFrame:
    text = prose.extracted(_markdown(s, d))
    return match.raw_rule_hits(text, REVISION, GENERATION).select("pack", "path", "line", "label", "match", "suppressed")


@query
def path_suppressed(s: SparkSession, d: str) -> DataFrame:
    return suppressed_hits(s, d).where(F.col("label").isin("walking the reader", "essay scaffold"))


@query
def wrap_findings(s: SparkSession, d: str) -> DataFrame:
    text = prose.extracted(files(s, d))
    one = lambda p: match.rows_of(match.scanned(text, p)).where(F.col("pass") == match.WRAP).select(F.lit(p.name).alias("pack"), *SHOWN)
    return one(REVISION).unionByName(one(GENERATION))


@query
def dedupe_first_wins(s: SparkSession, d: str) -> DataFrame:
    return match.findings(files(s, d), GENERATION).select(*SHOWN)


@query
def revision_findings(s: SparkSession, d: str) -> DataFrame:
    return match.findings(files(s, d), REVISION).select(*SHOWN)


@query
def class_family_filter(s: SparkSession, d: str) -> DataFrame:
    wanted = ("0", "0.5", "1", "10", "0a")
    asked = [c for c in REVISION.classes if any(paths.in_family(c, w) for w in wanted)]
    found = match.findings(files(s, d), _only(REVISION, *asked))
    hits = F.filter(F.array(*[F.when(paths.class_matches(F.col("class"), w), F.lit(w)) for w in wanted]), lambda w: w.isNotNull())
    counts = found.select(F.explode(hits).alias("wanted")).groupBy("wanted").agg(F.count(F.lit(1)).alias("n"))
    return s.createDataFrame([(w,) for w in wanted], "wanted string").join(counts, "wanted", "left").select("wanted", F.coalesce("n", F.lit(0)).alias("findings"))


@query
def phantom_links(s: SparkSession, d: str) -> DataFrame:
    return structure.phantom_links(prose.extracted(files(s, d)), files(s, d).select("path")).select(*SHOWN)


def _shapes(s: SparkSession, d: str, label: str) -> DataFrame:
    return match.rows_of(structure.shapes(prose.extracted(files(s, d))), "shapes").where(F.col("label") == label).select(*SHOWN)


@query
def empty_sections(s: SparkSession, d: str) -> DataFrame:
    return _shapes(s, d, "empty section")


@query
def bold_runs(s: SparkSession, d: str) -> DataFrame:
    return _shapes(s, d, "bold-term bullet run")


@query
def separator_confetti(s: SparkSession, d: str) -> DataFrame:
    return _shapes(s, d, "separator confetti")


@query
def emoji_decoration(s: SparkSession, d: str) -> DataFrame:
    return CLASS_EMOJI(s, d).where("label = 'emoji decoration'")


CLASS_EMOJI = QUERIES["sl_findings_class_5"]

# ------------------------------------------------------------------ corpus-wide


@query
def collisions(s: SparkSession, d: str) -> DataFrame:
    return echoes.collisions(match.findings(files(s, d), REVISION))


@query
def paragraphs(s: SparkSession, d: str) -> DataFrame:
    return _paragraphs(s, d).select("path", "start_line", "text")


@query
def planted_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return echoes.paragraphs(prose.extracted(_markdown(s, d))).select("path", "start_line", "text")


@query
def sentence_echoes(s: SparkSession, d: str) -> DataFrame:
    return echoes.sentence_echoes(_paragraphs(s, d))


@query
def sentence_echo_sites(s: SparkSession, d: str) -> DataFrame:
    return echoes.sites(echoes.sentences(_paragraphs(s, d))).select("key", "path", "start_line")


@query
def near_dup_echoes(s: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal paragraphs, by their first members."""
    return echoes.near_paragraphs(_paragraphs(s, d))[0].drop("a_head")


@query
def near_dup_members(s: SparkSession, d: str) -> DataFrame:
    """The class of every long paragraph."""
    return echoes.near_paragraphs(_paragraphs(s, d), members_only=True)[1]


@query
def echoes_first_per_pair(s: SparkSession, d: str) -> DataFrame:
    return echoes.near_echoes(_paragraphs(s, d))


# ---------------------------------------------------------------------- reports


@query
def density(s: SparkSession, d: str) -> DataFrame:
    return report.density_of(_standing(s, d), REVISION).select("path", "lines", "findings", "per_100_lines")


@query
def clean_files(s: SparkSession, d: str) -> DataFrame:
    return report.clean_files(report.density_of(_standing(s, d), REVISION)).select("path")


@query
def cross_scanner_lines(s: SparkSession, d: str) -> DataFrame:
    corpus = _standing(s, d)
    return report.cross_scanner(match.findings(corpus, REVISION), match.findings(corpus, GENERATION, files(s, d).select("path"))).select("path", "line", "classes")


@query
def class_roll_up(s: SparkSession, d: str) -> DataFrame:
    return report.roll_up(match.findings(_standing(s, d), REVISION))


@query
def class_totals(s: SparkSession, d: str) -> DataFrame:
    return report.class_totals(match.findings(_standing(s, d), REVISION), REVISION.classes)


@query
def report_totals(s: SparkSession, d: str) -> DataFrame:
    kept, records, left = paths.collect(files(s, d))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    text = match.scanned(prose.extracted(kept, keep_content=True), REVISION)
    total = lambda c, name: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(name)
    once = fixes.edited(kept, "revision", "hits", files=text).agg(total("hits", "findings"), F.count(F.lit(1)).alias("files"), total("edits", "safe_fixes"))
    return once.crossJoin(n(records, "records")).crossJoin(n(left, "source_files")).select("findings", "files", "records", "source_files", "safe_fixes")


# --------------------------------------------------------------------- rewrites


@query
def safe_fixes(s: SparkSession, d: str) -> DataFrame:
    corpus = files(s, d)
    one = lambda p: fixes.edits(corpus, p).select(F.lit(p).alias("pack"), "path", "line_no", "old", "new", F.array_join("changes", "; ").alias("changes"))
    return one("revision").unionByName(one("generation"))


@query
def fix_count(s: SparkSession, d: str) -> DataFrame:
    corpus = files(s, d)
    one = lambda p: fixes.fix_count(corpus, p).select(F.lit(p).alias("pack"), "safe_fixes")
    return one("revision").unionByName(one("generation"))


@query
def pleasantry_deletes(s: SparkSession, d: str) -> DataFrame:
    return fixes.edits(files(s, d), "generation").where("new is null").select("path", "line_no", "old")


@query
def heading_emoji_strip(s: SparkSession, d: str) -> DataFrame:
    return fixes.edits(files(s, d), "generation").where("array_contains(changes, 'stripped emoji from a heading')").select("path", "line_no", "old", "new")


@query
def rewritten_files(s: SparkSession, d: str) -> DataFrame:
    corpus = files(s, d)
    one = lambda p: fixes.rewritten(corpus, p).select(F.lit(p).alias("pack"), "path", F.md5("content").alias("content_md5"))
    return one("revision").unionByName(one("generation"))
