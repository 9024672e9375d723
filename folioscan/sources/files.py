"""A Python data source that lists and reads text files under paths.

Spark's own file sources hide names that begin with a dot or an underscore and
replace bytes that aren't UTF-8; this one reads every file, in a deterministic
order, and tells undecodable ones apart (content is then null and error says why).
The driver lists names only; files are read by the tasks, in chunks of CHUNK.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.paths import HASH_NAMES, PRUNED, SYNTAX

CHUNK = 256
SCHEMA = "file_ord long, path string, named boolean, content string, error string"


def is_text(path: str) -> bool:
    name = os.path.basename(path)
    return name.endswith((".md", ".markdown")) or name in HASH_NAMES or os.path.splitext(name)[1].lower().lstrip(".") in SYNTAX


def listed(paths: list[str], everything: bool = False, base: str = "") -> list[tuple[str, bool]]:
    """(path, named) in order: a folder's own names sorted, then its subfolders; repeats stay.

    base: the folder that relative paths start from; paths are told as they were given.
    """
    out: list[tuple[str, bool]] = []
    for p in paths:
        if not os.path.isdir(os.path.join(base, p)):
            if everything or is_text(p):
                out.append((p, True))
            continue
        top = os.path.join(base, p)
        for at, folders, names in os.walk(top):
            folders[:] = sorted(set(folders) - PRUNED)
            root = p if at == top else os.path.join(p, os.path.relpath(at, top))
            out += [(os.path.join(root, n), False) for n in sorted(names) if everything or is_text(n)]
    return out


class _Chunk(InputPartition):
    def __init__(self, rows: list[tuple[int, str, bool]]) -> None:
        super().__init__(rows)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioscan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = options.get("paths", options.get("path", "")).split("\n")
        self.base = options.get("base", "")
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        rows = [(i, p, named) for i, (p, named) in enumerate(listed([p for p in self.paths if p], not self.content, self.base))]
        return [_Chunk(rows[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)] or [_Chunk([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, path, named in partition.value:
            content, error = None, None
            if self.content:
                try:
                    with open(os.path.join(self.base, path), "rb") as f:
                        content = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"
            yield i, path, named, content, error


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Readable text files under paths; see SCHEMA."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("folioscan").option("paths", "\n".join(paths)).option("base", os.getcwd()).load()


def list_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file's path under paths, unread: what relative links may point to."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("folioscan").option("paths", "\n".join(paths)).option("base", os.getcwd()).option("content", "false").load().select("path")
