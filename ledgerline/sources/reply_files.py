"""A data source of reply files with the real place of every line, for batches and streams.

``spark.read.format("reply_lines")`` cuts files into byte ranges; a line belongs to the range in which it begins, so a
file gives the same rows however it is cut. ``file`` and ``offset`` order all lines, whatever the partitions.
Where a small ``splitBytes`` would give more than ``RANGES`` ranges, they grow with the data, up to ``SPLIT_BYTES``.
Files are opened where the tasks run, by any file system that pyarrow knows (local or shared folders, object
stores). Blank lines are left out; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the classes travel with the tasks

SCHEMA = "file string, offset bigint, value string"
SPLIT_BYTES = 64 << 20
RANGES = 1024
BATCH_LINES = 2000
BUFFER = 1 << 20
_BLANK = b" \t\r\n\x0b\x0c"


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def _opened(path: str):
    from pyarrow.fs import FileSystem

    files, inner = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files, inner


def list_files(path: str, suffix: str = "") -> dict[str, int]:
    """Size of the file, or of all files below the folder, by path; names that begin with _ or . are left out."""
    from pyarrow.fs import FileSelector, FileType

    files, inner = _opened(path)
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    info = files.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else files.get_file_info(FileSelector(inner, recursive=True))
    store = uri[: uri.rindex(inner.rstrip("/"))]  # what comes before the path inside the file system
    shown = [f for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.base_name.endswith(suffix)]
    return {store + f.path: f.size for f in sorted(shown, key=lambda f: f.path)}


def read_lines(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range with their offsets. The range's last line is read to its end."""
    files, inner = _opened(part.path)
    with io.BufferedReader(files.open_input_file(inner), min(BUFFER, max(part.end - part.start, io.DEFAULT_BUFFER_SIZE))) as stream:
        at = part.start
        if at > 0:  # the line that begins before the range belongs to the range before, also if it ends at its border
            at -= 1
            stream.seek(at)
            at += len(stream.readline())
        else:
            stream.seek(0)
        offsets, values = [], []
        while at < part.end:
            line = stream.readline()
            if not line:
                break
            if line.strip(_BLANK):
                offsets.append(at)
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            at += len(line)
            if len(values) >= BATCH_LINES:
                yield _batch(part.path, offsets, values)
                offsets, values = [], []
        if values:
            yield _batch(part.path, offsets, values)


def _batch(path: str, offsets: list[int], values: list[str]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(values), pa.string()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "offset", "value"])


def cut_files(spans: dict[str, tuple[int, int]], split: int) -> list[Range]:
    """Ranges of the spans (start, end) of files; each is a task, so their number must not grow with the bytes over a small ``split``."""
    total = sum(end - start for start, end in spans.values())
    size = max(split, min(-(-total // RANGES), SPLIT_BYTES))
    return [Range(path, at, min(at + size, end)) for path, (start, end) in sorted(spans.items()) for at in range(start, end, size)]


class ReplyLines(DataSource):
    """Options: path, suffix (of file names), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "reply_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Base:
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_lines(partition)


class _BatchReader(_Base, DataSourceReader):
    def partitions(self) -> list[Range]:
        return cut_files({path: (0, size) for path, size in list_files(self.path, self.suffix).items()}, self.split)


class _StreamReader(_Base, DataSourceStreamReader):
    """An offset is the size of every file so far. A file that has grown is read from its former end on.

    A line without a line feed at a file's end counts as complete when the file is listed, so writers move finished files into place.
    """

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": list_files(self.path, self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known = start["files"]
        return cut_files({path: (known.get(path, 0), size) for path, size in end["files"].items() if size > known.get(path, 0)}, self.split)

    def commit(self, end: dict) -> None:
        pass


def _with_order(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.struct("file", "offset").alias("line_order"))


def scan_reply_files(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value, line_order) of all lines, for ``parse_chat_replies`` and ``parse_generate_replies``."""
    spark.dataSource.register(ReplyLines)
    reader = spark.read.format("reply_lines").options(path=path, suffix=suffix, splitBytes=split_bytes)
    return _with_order(reader.load())


def stream_reply_files(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same rows as a stream over the files that appear or grow."""
    spark.dataSource.register(ReplyLines)
    reader = spark.readStream.format("reply_lines").options(path=path, suffix=suffix, splitBytes=split_bytes)
    return _with_order(reader.load())
