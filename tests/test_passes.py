"""How often a query reads the documents, and links found in one pass with all else."""

from __future__ import annotations

import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import line_breaks
from folioscan.operators import fixes, match, paths, prose, structure
from folioscan.plans.planted import EDITED
from folioscan.plans.queries import QUERIES
from folioscan.plans.rules import EMOJI, GENERATION, REVISION

SF = "/root/testdata/sf0.001"


def _scans(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize(("name", "most"), [("dedupe_first_wins", 2), ("sl_findings_class_0d", 2), ("sl_findings_class_1", 1), ("sl_findings_class_0b", 1), ("sl_findings_class_3", 1), ("sl_findings_class_4", 1), ("sl_findings_class_6", 1), ("suppressed_hits", 1), ("report_totals", 3), ("class_family_filter", 1)])
def test_reads(spark, name, most):
    assert _scans(QUERIES[name](spark, SF)) == most


def test_first_lost_link_of_a_line(spark):
    text = "\n".join([
        "# A",
        "See [b](b.md), [x](x%20y.md \"t\") and [z](z.md): a robust text.",
        "Not `[c](c.md)` nor [d](https://e.f/g) nor [e](#h) nor [f](${g}.md) nor [up](../d) nor [q](?a).",
        "And [here](./b.md#top)[there](../no/../e.md).",
        "```",
        "[in a fence](w.md)",
        "```",
    ])
    corpus = spark.createDataFrame([(1, "d/a.md", text), (2, "d/b.md", "x"), (3, "d/c.py", "# [s](s.md)")], "file_ord long, path string, content string")
    listing = corpus.select("path")
    links = {(r["path"], r["line"], r["match"]) for r in structure.phantom_links(prose.extracted(corpus), listing).collect()}
    assert links == {("d/a.md", 2, "x%20y.md"), ("d/a.md", 4, "../no/../e.md")}
    found = match.findings(corpus, GENERATION).collect()
    assert {(r["path"], r["line"], r["match"]) for r in found if r["class"] == "0d"} == links
    assert [(r["line"], r["match"]) for r in found if r["class"] == "1"] == [(2, "robust")]
    assert len(found) == 3


def test_families_of_plain_strings(spark):
    pairs = [(c, w) for c in (*REVISION.classes, "", "0é", "1b", "0a1") for w in ("", "0", "0.5", "1", "10", "0a", "é")]
    rows = spark.createDataFrame(pairs, "c string, w string")
    for w in {w for _, w in pairs}:
        got = {r[0] for r in rows.where((F.col("w") == w) & paths.class_matches(F.col("c"), w)).select("c").collect()}
        assert got == {c for c, x in pairs if x == w and paths.in_family(c, w)}


def test_unasked_classes_are_not_tried(spark):
    said = QUERIES["class_family_filter"](spark, SF)._jdf.queryExecution().logical().toJSON()
    assert "prior-state reference" in said and "salience superlative" not in said


def test_line_breaks(spark):
    texts = ["", "a", "a\n", "\n", "a\n\nb", "a\r\nb\n", "a\x0bb\u2028c\n", "\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_breaks(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["b"] == re.findall("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", r["t"])


def test_rewrites_hold_their_triggers(spark):
    lines = [old for _, old, _, _ in EDITED] + ["needless to say, x", "**Worth noting**: y", "Of course, z", "**Five ports** worth  opening **:", "(it’s worth noting that a)", "é Please note that b", "NEEDLESS", "In summary, c", "Let's dive in."]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    every = {"revision": [fixes.COUNT_WORTH, fixes.THEN_CONFIRMED, *[p for _, p in fixes.REMOVED_REVISION]], "generation": [EMOJI, fixes.PLEASANTRY, *[p for _, p in fixes.OPENERS]]}
    for pack, patterns in every.items():
        plainly = reduce(lambda a, b: a | b, [F.col("raw").rlike(p) for p in patterns])
        rows = df.select("raw", fixes.EDITS[pack](F.col("raw"))[0].alias("may"), plainly.alias("plainly")).collect()
        assert all(r["may"] == r["plainly"] for r in rows), [r for r in rows if r["may"] != r["plainly"]]
        assert any(r["may"] for r in rows)
