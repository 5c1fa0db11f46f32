"""Score files as a data source of Spark: ``spark.read.format("scores").load(folder)`` and ``files.write.format("scores")``.

Reading: the driver lists names and sizes only. Files are dealt to tasks in runs of up to ``run_bytes`` (an option; 64 MB),
and a task sniffs and unzips one file at a time. Rows are (path, error, xml), as ``gp.scored`` takes them: a file that is no
score gives a row with its error, files of no bytes too (Spark's binary reader leaves those out). Storage that fails raises,
so that the task runs again; it isn't taken for a broken file. Names that begin with "." or "_" are left out. A folder
without files gives no rows; one that isn't there raises.

Writing: rows of (path, content), path being the file's name. Null content makes a file of no bytes, a null name raises, other
columns are ignored. A file appears under its name when it is whole, so a task that runs again replaces it by the same; of
rows with one name any one stays.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cadenza.sources import gp

RUN_BYTES = 64 << 20
FILE_COST = 1 << 20  # what opening a file counts for, so that a run holds few small files too


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class Run(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: int


class ScoreReader(DataSourceReader):
    def __init__(self, folder: str, run_bytes: int):
        self.folder, self.run_bytes = folder.rstrip("/"), run_bytes

    def partitions(self) -> list[Run]:
        system, root = opened(self.folder)
        found = sorted((f.path.removeprefix(root).lstrip("/"), f.size or 0) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        runs, held = [Run([])], 0
        for name, size in found:
            if any(part[0] in "._" for part in name.split("/")):
                continue
            if runs[-1].names and held + size + FILE_COST > self.run_bytes:
                runs.append(Run([]))
                held = 0
            runs[-1].names.append(name)
            held += size + FILE_COST
        return runs

    def read(self, partition: Run) -> Iterator[tuple[str, str | None, str | None]]:
        system, root = opened(self.folder)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                data = stream.read()
            yield f"{self.folder}/{name}", *gp.entry_of(data)


class ScoreWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.folder)
        system.create_dir(root, recursive=True)
        n = 0
        for batch in iterator:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if (name := name.as_py()) is None:
                    raise ValueError("a score file needs a name")
                folder, base = posixpath.split(f"{root}/{name}")
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{base}-{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content.as_py() or b"")
                system.move(part, f"{folder}/{base}")
                n += 1
        return Written(n)


class ScoreFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scores"

    def schema(self) -> str:
        return "path string, error string, xml string"

    def reader(self, schema) -> ScoreReader:
        return ScoreReader(self.options["path"], int(self.options.get("run_bytes", RUN_BYTES)))

    def writer(self, schema, overwrite: bool) -> ScoreWriter:
        if overwrite:
            raise ValueError("score files are added to a folder; use mode append")
        return ScoreWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(ScoreFiles)
