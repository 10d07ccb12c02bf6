"""Document sink: one file per document, written by the tasks and committed as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "drawlog_documents"
_COMMIT, _PART = "_committed-", "part-"


@dataclass
class _Written(WriterCommitMessage):
    folder: str


@dataclass
class _Folder(InputPartition):
    path: str


class _Writer(DataSourceWriter):
    """Each attempt of a task fills a folder of its own; the commit lists the folders that count.

    The driver handles one folder name per task, never the documents' names.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        files, root = fs.FileSystem.from_uri(self.path)
        folder = f"{_PART}{self.job}-{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}")
        # Chunks of a document follow each other; no more than one is held.
        last, out = (None, None), None
        try:
            for name, chunk, text in rows:
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"no file name: {name!r}")
                if (name, chunk) == last:
                    raise ValueError(f"two documents are named {name!r}")
                if name != last[0]:
                    if out is not None:
                        out.close()
                    target = f"{root}/{folder}/{name}"
                    if files.get_file_info(target).type != fs.FileType.NotFound:
                        raise ValueError(f"two documents are named {name!r}")
                    out = files.open_output_stream(target)
                last = (name, chunk)
                out.write((text or "").encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            files.delete_dir(f"{root}/{folder}")
            raise
        return _Written(folder)

    def _drop(self, keep: set[str]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"{_PART}{self.job}-") and info.base_name not in keep:
                files.delete_dir(info.path)

    def commit(self, messages: list[_Written | None]) -> None:
        folders = sorted(m.folder for m in messages if m is not None)
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        with files.open_output_stream(f"{root}/{_COMMIT}{self.job}") as out:
            out.write(json.dumps(folders).encode())
        self._drop(set(folders))  # what attempts on lost executors left

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(set())


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Folder]:
        files, root = fs.FileSystem.from_uri(self.path)
        commits = [i for i in files.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(_COMMIT)]
        return [_Folder(f) for i in commits for f in json.loads(files.open_input_stream(i.path).read())]

    def read(self, partition: _Folder) -> Iterator[tuple[str, str]]:
        if partition is None:  # nothing was committed
            return
        files, root = fs.FileSystem.from_uri(self.path)
        for info in files.get_file_info(fs.FileSelector(f"{root}/{partition.path}")):
            with files.open_input_stream(info.path) as f:
                yield info.base_name, f.read().decode()


class DocumentFiles(DataSource):
    """Folder of documents, one file each: columns ``filename, document``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "filename string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("documents are only added")
        return _Writer(self.options["path"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def write_documents(
    docs: DataFrame, path: str, fmt: str, name: str = "stored_name", text: str = "text", chunk: str | None = None
) -> None:
    """Write one file per row, named by ``name``, under ``path/fmt``.

    With ``chunk``, a row is a chunk of its document and the file holds the
    chunks of one name by rising number, so a document of any size is written
    with one chunk in memory.

    All or nothing: a failed job leaves no file, and files count once the
    job's commit names their folder.  ``path`` is a folder or address that
    every executor reaches (local or mounted, S3, GCS, HDFS).  Names must be
    unique within a call, as ``allocate_unique_filenames`` gives them; the same
    name twice, an empty one or one with a slash fails the job.  A null text is
    an empty file.
    """
    docs.sparkSession.dataSource.register(DocumentFiles)
    # Equal names meet in one task, and documents are spread evenly.
    number = F.lit(0) if chunk is None else F.col(chunk)
    rows = docs.select(F.col(name).alias("filename"), number.cast("bigint").alias("chunk"), F.col(text).alias("document"))
    rows = rows.repartition("filename").sortWithinPartitions("filename", "chunk")
    rows.write.format(FORMAT).mode("append").save(f"{path}/{fmt}")


def read_documents(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Committed documents of ``path/fmt``: filename, document."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(FORMAT).load(f"{path}/{fmt}")
