"""Aggregates over findings, and the report in its two forms."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import GENERATION, PACKS, Pack
from . import echoes, fixes
from .match import findings, scanned
from .paths import class_matches, collect
from .prose import extracted


def _per_100(files: DataFrame) -> DataFrame:
    """files (file_ord, path, lines, findings) with per_100_lines."""
    per = F.when(F.col("lines") > 0, F.bround(F.lit(100.0) * F.col("findings") / F.col("lines"), 1)).otherwise(F.lit(0.0))
    return files.withColumn("per_100_lines", per)


def density(found: DataFrame, counts: DataFrame) -> DataFrame:
    """file_ord, path, lines, findings, per_100_lines of every file of counts."""
    n = found.groupBy("file_ord").agg(F.count(F.lit(1)).alias("findings"))
    joined = counts.join(n, "file_ord", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return _per_100(joined.select("file_ord", "path", "lines", "findings"))


def density_of(corpus: DataFrame, pack: Pack) -> DataFrame:
    """density() of all findings; where they all come from within the file, in one pass and without an exchange."""
    files = scanned(extracted(corpus), pack)
    if pack.name == GENERATION.name:
        return density(findings(corpus, pack, files=files), files.select("file_ord", "path", F.col("n_lines").alias("lines")))
    return _per_100(files.select("file_ord", "path", F.col("n_lines").alias("lines"), F.size("hits").cast("long").alias("findings")))


def clean_files(dens: DataFrame) -> DataFrame:
    return dens.where("findings = 0").select("file_ord", "path")


def class_totals(found: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """class, class_ord (the order it is shown in), findings; classes without a finding are left out."""
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("findings")).select("class", order.alias("class_ord"), "findings")


def cross_scanner(revision: DataFrame, generation: DataFrame) -> DataFrame:
    """file_ord, path, line and classes (a list such as generation:1, revision:0a): a line that both packs find counts once."""
    both = revision.select("file_ord", "path", "line", F.concat(F.lit("revision:"), "class").alias("c")).unionByName(generation.select("file_ord", "path", "line", F.concat(F.lit("generation:"), "class").alias("c")))
    return both.groupBy("file_ord", "path", "line").agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("classes"))


def roll_up(found: DataFrame) -> DataFrame:
    """class, path, findings: by class and file, by class (path is null) and in all (both are null)."""
    return found.rollup("class", "path").agg(F.count(F.lit(1)).alias("findings"))


class Audit:
    """One run over files (file_ord, path, content): everything lazily, as DataFrames."""

    def __init__(self, files: DataFrame, pack: str = "revision", wanted: str = "", listing: DataFrame | None = None, **rules) -> None:
        self.pack = PACKS[pack]
        self.corpus, self.records, self.left = collect(files, **rules)
        # kept over the report's actions; what is lost with an executor is made again
        self.files = scanned(extracted(self.corpus), self.pack).persist()
        self.found = findings(self.corpus, self.pack, listing, self.files).where(class_matches(F.col("class"), wanted))
        self.density = density(self.found, self.files.select("file_ord", "path", F.col("n_lines").alias("lines")))
        self.fixes = fixes.fix_count(self.corpus, pack)

    def collisions(self) -> DataFrame:
        return echoes.collisions(self.found)

    def echoes(self) -> DataFrame:
        paras = echoes.paragraphs(self.files)
        exact = echoes.sentence_echoes(paras).withColumn("similarity", F.lit(None).cast("double"))
        return exact.unionByName(echoes.near_echoes(paras))

    def edits(self) -> DataFrame:
        return fixes.edits(self.corpus, self.pack.name)

    def rewritten(self) -> DataFrame:
        return fixes.rewritten(self.corpus, self.pack.name)

    def ordered(self) -> DataFrame:
        """Findings in reading order: by file, pass, line and rule."""
        detector = F.when(F.col("pass") <= 1, 0).otherwise(F.col("pass"))
        return self.found.orderBy("file_ord", detector, "line", "pass", "ordinal")

    # ---------------------------------------------------------------- output
    # A report is for a reader, so its rows come to the driver; large corpora
    # write the DataFrames above instead.

    def as_dict(self) -> dict:
        rows = self.ordered().collect()
        dens = self.density.orderBy("file_ord").collect()
        whole = "collisions" if self.pack.name == "revision" else "echoes"
        made = self.collisions().orderBy("phrase") if whole == "collisions" else self.echoes().orderBy(F.col("similarity").isNotNull(), "text")
        repeats = [{k: v for k, v in r.asDict().items() if v is not None} | {"sites": r["sites"].split(", ")} for r in made.collect()]
        return {
            "findings": [{"file": r["path"], "line": r["line"], "class": r["class"], "label": r["label"], "match": r["match"], "text": r["text"]} for r in rows],
            whole: repeats,
            "files": [{"file": r["path"], "lines": r["lines"], "findings": r["findings"], "per_100_lines": r["per_100_lines"]} for r in dens],
            "clean_files": [r["path"] for r in dens if not r["findings"]],
            "safe_fixes": self.fixes.first()[0],
            "skipped_records": [r["path"] for r in self.records.select("path", "file_ord").orderBy("file_ord").collect()],
            "skipped_code_files": self.left.count(),
        }


def render(report: dict, classes: tuple[str, ...]) -> str:
    """The console form of a report."""
    out: list[str] = []
    for cls in classes:
        group = [f for f in report["findings"] if f["class"] == cls]
        if group:
            out.append(f"\n=== class {cls}: {len(group)} ===")
            out += [f"{f['file']}:{f['line']}  [{f['label']}]\n    {f['text'][:160]}" for f in group]
    for kind, name in (("collisions", "phrase"), ("echoes", "text")):
        if kind in report:
            out.append(f"\n=== {kind}: {len(report[kind]) or 'none'} ===")
            for r in report[kind]:
                like = f" (~{int(r['similarity'] * 100)}% alike)" if "similarity" in r else ""
                out.append(f"  {r[name]!r} x{r['count']}{like}: {', '.join(r['sites'])}")
    dense = sorted((s for s in report["files"] if s["findings"]), key=lambda s: -s["per_100_lines"])
    if dense:
        out.append("\n=== density: findings per 100 lines ===")
        out += [f"  {s['file']}: {s['per_100_lines']} ({s['findings']} of {s['lines']} lines)" for s in dense]
    out.append("\nclean: " + (", ".join(report["clean_files"]) or "none"))
    out.append(f"\n{len(report['findings'])} finding(s) in {len(report['files'])} file(s).")
    if report["safe_fixes"]:
        out.append(f"{report['safe_fixes']} line(s) can be rewritten mechanically: --fix, or --fix --dry-run to see them first.")
    if report["skipped_records"]:
        out.append(f"{len(report['skipped_records'])} record(s) passed over; --include-records reads them.")
    if report["skipped_code_files"]:
        out.append(f"{report['skipped_code_files']} source file(s) passed over; --code reads their comments.")
    return "\n".join(out)


def show_edits(rows: list) -> str:
    out, path = [], None
    for r in rows:
        if r["path"] != path:
            path = r["path"]
            out.append(f"\n{path}")
        out += [f"  {r['line_no']}: - {r['old']}", f"  {r['line_no']}: + {'<deleted>' if r['new'] is None else r['new']}", f"      ({'; '.join(r['changes'])})"]
    return "\n".join(out)


def footer(edits: int, dry_run: bool, records: int, source_files: int) -> str:
    """What --fix says in the end."""
    out = f"{edits} rewrite(s) {'to be made' if dry_run else 'made'}"
    out += f"; {records} record(s) passed over" if records else ""
    out += f"; {source_files} source file(s) never rewritten" if source_files else ""
    return out + "."


def nothing_found(records: int, source_files: int) -> str:
    """What is said where there is no file to read."""
    notes = [f"{records} record(s) passed over, --include-records reads them"] * bool(records) + [f"{source_files} source file(s) passed over, --code reads their comments"] * bool(source_files)
    return "no text to audit" + (f" ({'; '.join(notes)})" if notes else "")


def dump(report: dict) -> None:
    json.dump(report, sys.stdout, indent=2)
    print()
