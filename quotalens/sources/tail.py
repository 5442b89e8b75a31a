"""JSON-lines files that are still being written, as a streaming source that follows each file by byte offset."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quotalens.session import ship_code

#: Bytes looked at in one step, bytes of a range that one task reads, bytes of the first line that tell files apart.
BLOCK, RANGE, HEAD = 1 << 16, 64 << 20, 4096
SCHEMA = "value string, source_path string, at long"


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that start in bytes [start, end); a line starts at ``origin``, where the batch's part of the file does."""

    path: str
    origin: int
    start: int
    end: int


def _first_line(file: pa.NativeFile) -> str | None:
    """Digest of the first line, or of its first HEAD bytes; None before there is a whole one."""
    file.seek(0)
    head = file.read(HEAD)
    line, found, _ = head.partition(b"\n")
    return hashlib.sha256(line).hexdigest() if found or len(head) == HEAD else None


def _after_last_line(file: pa.NativeFile, size: int) -> int:
    """The byte after the last line end: what follows is a line that is still being written."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class TailReader(DataSourceStreamReader):
    """An offset is a JSON object: path -> [digest of the first line, bytes read]. It always ends after a whole line, so a line
    that is cut by a batch, a trigger or a restart is read once, when it is complete."""

    def __init__(self, path: str, suffix: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.suffix = suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and self.suffix in info.base_name and not info.base_name.startswith((".", "_")) and info.size:
                with self.files.open_input_file(info.path) as file:
                    head, end = _first_line(file), _after_last_line(file, info.size)
                if head and end:
                    found[info.path] = [head, end]
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        made = []
        for path, (head, upto) in sorted(end.items()):
            begin = self._known(path, head, upto, start, end)
            made += [Range(path, begin, at, min(at + RANGE, upto)) for at in range(begin, upto, RANGE)]
        return made

    @staticmethod
    def _known(path: str, head: str, upto: int, start: dict, end: dict) -> int:
        """Bytes of the file that were read before: under its own path if it goes on with the same first line; else, for a file that
        was rotated, under the path it had. A file that was truncated or written anew starts at 0."""
        own_head, own = start.get(path, (None, 0))
        if own_head == head:
            return own if own <= upto else 0
        moved = [n for p, (h, n) in start.items() if h == head and n <= upto and end.get(p, (None,))[0] != head]
        return max(moved, default=0)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(partition.path) as raw:
            file, at = io.BufferedReader(raw, BLOCK), partition.start
            if at > partition.origin:  # a line that began in the range before is that one's
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            values, places, size = [], [], 0
            while at < partition.end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    break  # cut since; the file is read anew from its start
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at, size = at + len(line), size + len(line)
                if size > BLOCK * 16:
                    yield self._batch(values, places, partition.path)
                    values, places, size = [], [], 0
            yield self._batch(values, places, partition.path)

    @staticmethod
    def _batch(values: list[str], places: list[int], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([path] * len(values), pa.string()), pa.array(places, pa.int64())], names=["value", "source_path", "at"])


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def tail_lines(spark: SparkSession, path: str, suffix: str = ".jsonl"):
    """Streaming (value, source_path, at) of every line of the files below ``path`` whose name holds ``suffix``, each once; files whose
    names begin with a dot or an underscore are left out, as Spark leaves them.

    Files may grow at any time, also in the middle of a line; a line is given once it ends. A file that shrank or has another first
    line is a new one, read from its start; a file that was renamed (rotated) with its first line is followed where it was left. Two
    files with one first line are told apart by their paths as long as both are there. What is truncated between two triggers is lost,
    as to any reader. ``path`` may be in any store that pyarrow reads; every executor must reach it. Blank lines are given as they are.
    """
    ship_code(spark)
    spark.dataSource.register(TailedLines)
    return spark.readStream.format("tailed_lines").option("path", path).option("suffix", suffix).load()
