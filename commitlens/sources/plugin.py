"""Sources that plug in by name: the log dump as a format of Spark's reader, and repository providers loaded from a module.

    spark.dataSource.register(CommitLogSource)
    spark.read.format("commitlog").option("table", "change_item").option("repo_id", "r").load("/dumps")
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import ADD, COPY, DELETE, EDIT, NONE, RENAME, TYPE_CHANGED
from .logs import END, START

#: The canonical tables that a dump gives; numbers of changesets follow from the graph.
TABLES = {
    "change_set": "repo_id string, changeset_id string, committer string, date timestamp, comment string",
    "change_item": "repo_id string, changeset_id string, item_idx int, kind int, server_path string, from_server_path string",
    "commit_edge": "repo_id string, child string, parent string, parent_idx int",
}
KINDS = {"A": ADD, "D": DELETE, "DD": DELETE, "M": EDIT, "T": TYPE_CHANGED}
#: Bytes of a file that one task reads, and of a read.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Several ranges are one task as long as they come to no more than so many bytes, nor to more than one in so many of the dump.
TASK_BYTES, TASKS = 16 << 20, 256
#: Bytes of a read beyond the end of the range, and rows of a batch.
PAST_BYTES, BATCH = 4 << 10, 10_000
MARK = re.compile(rb"(?<=\n)" + START.encode() + rb"\r?\n")
OCTAL = re.compile(rb"\\([0-3][0-7]{2})")


class Ranges(InputPartition):
    """The records that start in any of the ranges (path, start, end) of a task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def dealt(ranges: list[tuple[str, int, int]]) -> list[Ranges]:
    """Ranges as tasks, which grow with the dump's bytes and not with its ranges: each task costs the driver memory, and a hundred thousand of them more than it may hold."""
    most = min(TASK_BYTES, sum(end - start for _, start, end in ranges) // TASKS)
    tasks: list[list[tuple[str, int, int]]] = []
    held = 0
    for path, start, end in ranges:
        if not tasks or held + end - start > most:
            tasks.append([])
            held = 0
        tasks[-1].append((path, start, end))
        held += end - start
    return [Ranges(t) for t in tasks]


def records(file, start: int, end: int) -> Iterator[str]:
    """Text of the records that start in [start, end), without the marker; a record may end behind it."""
    # one byte more, as a marker follows a line end; the first of a file follows none
    file.seek(max(0, start - 1))
    held, base = (b"\n" if start == 0 else b""), (-1 if start == 0 else start - 1)
    # what is behind the range is read in small steps: mostly the rest of one record
    size = min(READ_BYTES, max(1, end - start) + PAST_BYTES)
    while True:
        more = file.read(size)
        size = min(READ_BYTES, max(PAST_BYTES, end - base - len(held)))
        held += more
        marks = [m for m in MARK.finditer(held)]
        for m, after in zip(marks, [*marks[1:], None][: len(marks)], strict=True):
            at = base + m.start()
            if at >= end:
                return
            if after is None and more:
                break
            if at >= start:
                yield held[m.end() : after.start() if after else len(held)].decode(errors="replace").replace("\r\n", "\n")
        if not more:
            return
        keep = marks[-1].start() - 1 if marks else max(0, len(held) - len(START) - 3)
        held, base = held[keep:], base + keep
        if not marks and base >= end:
            return


def decoded(path: str) -> str:
    """As the column function: quotes go, octal escapes become UTF-8; undecodable paths stay."""
    plain = re.sub('^"|"$', "", path)
    if "\\" not in plain:
        return plain
    try:
        return OCTAL.sub(lambda m: bytes([int(m[1], 8)]), plain.encode()).decode()
    except UnicodeDecodeError:
        return plain


def rows(record: str, table: str, repo_id: str) -> Iterator[tuple]:
    head, _, body = record.partition(END)
    part = head.split("\n")
    id_ = part[0].strip()
    if table == "change_set":
        try:
            date = datetime.fromisoformat(part[2]).astimezone(UTC)
        except (ValueError, IndexError):
            date = None
        yield repo_id, id_, part[1] if len(part) > 1 else None, date, "\n".join(x for x in part[4:] if x)
    elif table == "commit_edge":
        for k, parent in enumerate(part[3].split() if len(part) > 3 else []):
            yield repo_id, id_, parent, k
    else:
        for k, line in enumerate(x for x in body.split("\n") if x.strip()):
            field = [*line.split("\t"), None, None]
            status = field[0]
            kind = RENAME if status.startswith("R") else COPY if status.startswith("C") else KINDS.get(status, NONE)
            path, source = (field[2], field[1]) if kind in (RENAME, COPY) else (field[1], None)
            yield repo_id, id_, k, kind, None if path is None else decoded(path), None if source is None else decoded(source)


class CommitLogReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.schema = schema
        self.path, self.table, self.repo_id = options["path"], options.get("table", "change_item"), options.get("repo_id", "")
        self.size = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return dealt([(f.path, at, min(f.size, at + self.size)) for f in files for at in range(0, f.size, self.size)])

    def read(self, partition: Ranges) -> Iterator:
        """Arrow batches: a row at a time costs more than its parsing."""
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        held = self._rows(partition, fs)
        while batch := list(islice(held, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), schema.types, strict=True)], schema=schema)

    def _rows(self, partition: Ranges, fs) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for path, start, end in partition.ranges:
            with store.open_input_file(path) as file:
                for record in records(file, start, end):
                    yield from rows(record, self.table, self.repo_id)


class CommitLogSource(DataSource):
    """Format ``commitlog``: options ``table`` (change_set, change_item or commit_edge), ``repo_id`` and ``range_bytes``. Large files are read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> str:
        table = self.options.get("table", "change_item")
        if table not in TABLES:
            raise ValueError(f"no table {table!r}; one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> CommitLogReader:
        return CommitLogReader(self.options, schema)


#: What rebuilds a repository: (spark, repo_id, out, options) -> its tables by name, as ``plans.sync`` gives them.
Provider = Callable[[SparkSession, str, str, dict], dict[str, DataFrame]]


def provider(name: str) -> Provider:
    """A provider by ``module:function``, as a project's settings name it."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None) if module and function else None
    if not callable(found):
        raise ValueError(f"no provider {name!r}: expected module:function")
    return found
