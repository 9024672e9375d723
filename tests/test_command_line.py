"""The command line over real trees of files."""

from __future__ import annotations

import json
import os

import pytest

from folioscan import cli
from folioscan.operators import paths
from folioscan.sources.files import listed, read_files

LONG = "The cache is currently small. " + "word " * 60


@pytest.fixture
def tree(tmp_path, monkeypatch):
    def put(name: str, content: str | bytes) -> None:
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("docs/b.md", "The limit was previously five.\nIn conclusion, it works.\x0cNext page.\r\nIt is worth noting that disks fill up.\n")
    put("docs/a.MD", "Nothing admits this extension.\n")
    put("docs/a.markdown", f"{LONG}\n")
    put("docs/calm.md", "A plain line.\n")
    put("docs/adr/one.md", "It was previously so.\n")
    put("docs/node_modules/x.md", "It was previously so.\n")
    put("docs/.git/y.md", "It was previously so.\n")
    put("src/app.PY", "x = 1  # the limit was previously seven\n")
    put("src/lib.min.js", "// the limit was previously seven\n")
    put("src/notes.txt", "It was previously so.\n")
    put("docs/bad.md", b"caf\xe9 previously\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def run(capsys, *args: str) -> tuple[int, str, str]:
    status = cli.main(list(args))
    got = capsys.readouterr()
    return status, got.out, got.err


def test_files_are_listed_in_order_without_pruned_folders(tree):
    assert [os.path.relpath(p) for p, _ in listed([str(tree)])] == ["docs/a.markdown", "docs/b.md", "docs/bad.md", "docs/calm.md", "docs/adr/one.md", "src/app.PY", "src/lib.min.js"]
    assert listed(["docs/calm.md", "docs/calm.md", "src/notes.txt"]) == [("docs/calm.md", True)] * 2


def test_undecodable_files_are_told_apart(spark, tree):
    rows = {os.path.basename(r["path"]): r for r in read_files(spark, [str(tree / "docs")]).collect()}
    assert rows["bad.md"]["content"] is None and "UnicodeDecodeError" in rows["bad.md"]["error"]
    assert rows["b.md"]["content"].endswith("\r\nIt is worth noting that disks fill up.\n")


def test_json_report(spark, tree, capsys):
    status, out, err = run(capsys, "revision", "docs", "src", "--json", "--check")
    assert out, (status, err)
    got = json.loads(out)
    assert status == 1 and "bad.md" in err
    assert {(f["file"], f["line"], f["class"]) for f in got["findings"]} >= {("docs/b.md", 1, "0a"), ("docs/a.markdown", 1, "0c"), ("docs/b.md", 4, "5")}
    assert got["clean_files"] == ["docs/calm.md"] and got["skipped_records"] == ["docs/adr/one.md"] and got["skipped_code_files"] == 1
    assert [f["file"] for f in got["files"]] == ["docs/a.markdown", "docs/b.md", "docs/calm.md"] and got["safe_fixes"] == 1
    assert next(f for f in got["findings"] if f["file"] == "docs/a.markdown")["text"] == LONG.strip()


def test_console_report_cuts_texts_and_sorts_by_density(spark, tree, capsys):
    status, out, _ = run(capsys, "revision", "docs")
    assert status == 0 and LONG[:160] in out and LONG[:161] not in out
    assert out.index("docs/a.markdown: 100.0") < out.index("docs/b.md: ") and "clean: docs/calm.md" in out
    assert run(capsys, "revision", "docs", "--class", "0c")[1].count("[") == 1


def test_flags_choose_files(spark, tree, capsys):
    found = lambda *a: {f["file"] for f in json.loads(run(capsys, "revision", *a, "--json")[1])["findings"]}
    assert found("docs", "src", "--code", "--include-records", "--exclude", "b.m") == {"docs/a.markdown", "docs/adr/one.md", "src/app.PY"}
    assert found("src/lib.min.js", "docs/b.md") == {"src/lib.min.js", "docs/b.md"}
    assert found("docs", "--own", "docs/b.md") == {"docs/a.markdown"}
    assert run(capsys, "revision", "src")[0] == 2
    assert "2 source" not in run(capsys, "revision", "docs/adr")[2] and "1 record(s)" in run(capsys, "revision", "docs/adr")[2]


def test_fixes_change_nothing_else(spark, tree, capsys):
    before = (tree / "docs/b.md").read_bytes()
    status, out, _ = run(capsys, "generation", "docs", "src", "--code", "--fix", "--dry-run", "--check")
    assert status == 0 and "+ It works." in out and "1 rewrite(s) to be made; 1 record(s) passed over; 1 source file(s)" in out
    assert (tree / "docs/b.md").read_bytes() == before
    assert "1 rewrite(s) made" in run(capsys, "generation", "docs", "--fix")[1]
    assert (tree / "docs/b.md").read_bytes() == b"The limit was previously five.\nIt works.\x0cNext page.\nIt is worth noting that disks fill up.\n"
    assert not list((tree / "docs").glob("*.folioscan-new"))


def test_own_prose_is_passed_over_by_absolute_path(spark):
    files = spark.createDataFrame([(0, "README.md", "x"), (1, "./lib/a.md", "x"), (2, "lib2/a.md", "x")], "file_ord long, path string, content string")
    kept = paths.collect(files, own=["/w/README.md", "/w/lib/"], base="/w")[0]
    assert [r["path"] for r in kept.collect()] == ["lib2/a.md"]
