"""A Python data source for trees of many small files.

    spark.dataSource.register(TaskFiles)
    spark.read.format("task_files").option("nameRule", "prefix").load(root)

Rows are ``(task_id, member, size, content)``: one per file below the folders of
``root`` whose names follow the rule.  The files are listed once on the driver
(names and sizes, no contents) and packed into partitions of about ``targetBytes``,
each file counting ``openCostBytes`` more than its size, so that neither a million
tiny files make a million tasks nor a few large ones one task.  Tasks read their
own files and hand them to the engine in Arrow batches of bounded size.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "task_id STRING, member STRING, size BIGINT, content STRING"

#: Folder names that count as tasks, by rule (the column forms are in ``files.NAME_RULES``).
RULES = {
    "prefix": lambda n: n.startswith("task_"),
    "contains": lambda n: "task" in n,
    "contains_ci": lambda n: "task" in n.lower(),
    "not_hidden": lambda n: not n.startswith((".", "__")),
}


def filesystem(root: str):
    """(pyarrow filesystem, path) of a local path or URI."""
    from pyarrow import fs as pafs
    local = root[len("file:"):] if root.startswith("file:") and not root.startswith("file://") else root
    return pafs.FileSystem.from_uri(local if "://" in local else "file://" + os.path.abspath(local))


@dataclass
class Pack(InputPartition):
    """Files of one task: (path, task, member, size)."""

    files: list[tuple[str, str, str, int]]


def packed(files: list[tuple[str, str, str, int]], target: int, open_cost: int) -> list[Pack]:
    """Files, in their order, cut into packs of about ``target`` bytes."""
    packs: list[Pack] = []
    size = target + 1
    for f in files:
        cost = f[3] + open_cost
        if size + cost > target:
            packs.append(Pack([]))
            size = 0
        packs[-1].files.append(f)
        size += cost
    return packs


class TaskFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "TaskFilesReader":
        return TaskFilesReader(self.options)


class TaskFilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.rule = options.get("nameRule", "prefix")
        if self.rule not in RULES:
            raise ValueError(f"unknown name rule {self.rule!r}")
        self.members = [m for m in options.get("members", "").split(",") if m]
        self.target = int(options.get("targetBytes", 64 << 20))
        self.open_cost = int(options.get("openCostBytes", 64 << 10))

    def _wanted(self, rel: str) -> tuple[str, str] | None:
        """(task, member) of a path below the root, if it counts."""
        task, _, member = rel.partition("/")
        if not member or not RULES[self.rule](task):
            return None
        if self.members and not any(fnmatch.fnmatchcase(member, m) for m in self.members):
            return None
        return task, member

    def partitions(self) -> list[Pack]:
        from pyarrow import fs as pafs
        fs, base = filesystem(self.root)
        base = base.rstrip("/")
        found = []
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
            if info.type == pafs.FileType.File:
                want = self._wanted(info.path[len(base) + 1:])
                if want:
                    found.append((info.path, *want, int(info.size or 0)))
        return packed(sorted(found), self.target, self.open_cost) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.root)
        rows, size = [], 0
        for path, task, member, n in partition.files:
            with fs.open_input_stream(path) as f:
                rows.append((task, member, n, f.read().decode("utf-8", "replace")))
            size += n
            if size >= 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["task_id", "member", "size", "content"])


def read_task_files(spark: SparkSession, root: str, name_rule: str = "prefix", members: list[str] | None = None,
                    target_bytes: int = 64 << 20) -> DataFrame:
    """The files of task folders below ``root``; ``members`` are file patterns
    relative to the task's folder (``solutions/*_summary.json``)."""
    spark.dataSource.register(TaskFiles)
    return spark.read.format("task_files").option("nameRule", name_rule).option("members", ",".join(members or [])) \
        .option("targetBytes", target_bytes).load(root)
