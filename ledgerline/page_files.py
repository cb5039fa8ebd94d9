"""A data source of one file per page, published by a two-phase commit.

Tasks write into folders of their own below a hidden staging folder, ``FOLDER_PAGES`` pages in each. When all have ended,
the driver moves each folder into place, one move a folder, and removes what other attempts have left; if the job fails, it
removes the staging folder. So a reader sees whole tasks of finished jobs only, and a failed task leaves no page behind.
A scan's driver lists the folders only; the pages of a folder are listed and read by the task that has it.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ledgerline.sources.reply_files import _opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "name string, content string"
STAGING = "_staging"
FOLDER_PAGES = 10_000
BATCH_BYTES = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    """A finished task: the folders it has written, relative to the staging folder; each holds a page at least."""

    folders: list[str]


@dataclass
class Folder(InputPartition):
    """The pages of one folder."""

    path: str


class PageFiles(DataSource):
    """Options: path, folderPages. Rows are (name, content); a name may hold no folder."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("pages are added; write to a new folder instead of overwriting one")
        return _Writer(self.options["path"].rstrip("/"), int(self.options.get("folderPages", FOLDER_PAGES)))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Folder]:
        from pyarrow.fs import FileSelector

        files, inner = _opened(self.path)
        found = files.get_file_info(FileSelector(inner))
        return [Folder(f"{self.path}/{f.base_name}") for f in sorted(found, key=lambda f: f.path) if not f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        if partition is None:  # a scan without any folder
            return
        files, folder = _opened(partition.path)
        names, texts, size = [], [], 0
        for page in files.get_file_info(FileSelector(folder)):
            if not page.is_file or page.base_name.startswith(("_", ".")):
                continue
            with files.open_input_stream(page.path) as stream:
                names.append(page.base_name)
                texts.append(stream.read().decode("utf-8", "replace"))
            size += page.size
            if size >= BATCH_BYTES:
                yield _batch(names, texts)
                names, texts, size = [], [], 0
        if names:
            yield _batch(names, texts)


def _batch(names: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "content"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, folder_pages: int = FOLDER_PAGES) -> None:
        self.path, self.job, self.folder_pages = path, uuid.uuid4().hex, folder_pages

    def _folder(self, *parts: str) -> tuple:
        return _opened("/".join([self.path, *parts]))

    def write(self, rows: Iterator) -> Written:
        task = TaskContext.get()
        own = f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}"
        folders, pages = [], 0
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"].startswith((".", "_")):
                raise ValueError(f"not a file name: {row['name']!r}")
            if pages % self.folder_pages == 0:
                folders.append(f"{own}-{len(folders):05d}")
                files, folder = self._folder(STAGING, self.job, folders[-1])
                files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write((row["content"] or "").encode("utf-8", "surrogatepass"))
            pages += 1
        return Written(folders)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)  # a job without pages leaves an empty folder
        for name in [name for message in messages if message is not None for name in message.folders]:
            files, staged = self._folder(STAGING, self.job, name)
            _, target = self._folder(f"{name}-{self.job[:8]}")
            files.move(staged, target)
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        files, staged = self._folder(STAGING, self.job)
        if files.get_file_info(staged).type.name != "NotFound":
            files.delete_dir(staged)


def write_page_files(pages: DataFrame, path: str, name: str = "name", content: str = "content", folder_pages: int = FOLDER_PAGES) -> None:
    """Write a file per row below ``path``, in folders of one task each; all or none become visible."""
    spark: SparkSession = pages.sparkSession
    spark.dataSource.register(PageFiles)
    rows = pages.selectExpr(f"CAST(`{name}` AS string) AS name", f"CAST(`{content}` AS string) AS content")
    rows.write.format("page_files").mode("append").option("folderPages", folder_pages).save(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all pages that ``write_page_files`` has published below ``path``."""
    spark.dataSource.register(PageFiles)
    return spark.read.format("page_files").load(path)
