"""A batch sink that writes the lines of each graph to a file of its own, in line order.

    spark.dataSource.register(GraphFiles)
    in_line_order(lines).write.format("graph_files").mode("append").save("out/gfa")

A task writes the graphs it gets to a folder that only it knows; when all tasks are done the
driver moves these folders, one a task, into place, so readers see all files of a write or none,
and files of lost or repeated attempts never appear.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from seqloom.operators.export import KEYS

STAGED = "_staged"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def in_line_order(lines: DataFrame) -> DataFrame:
    """Lines of ``export`` so that a graph is in one partition, in its order."""
    return lines.repartition("graph_id").sortWithinPartitions(*KEYS).select("graph_id", "line")


def read_lines(spark: SparkSession, path: str, suffix: str = ".gfa") -> DataFrame:
    """name (of the file, without suffix), line_no, line of all files below ``path``.

    The driver lists the folders, one for each task that wrote; the files, one a graph, are
    listed by the tasks that read them.
    """
    files, root = file_system(path)
    entries = files.get_file_info(pyarrow.fs.FileSelector(root))
    folders = [(f"{path.rstrip('/')}/{e.base_name}",) for e in entries if e.base_name.startswith("part-")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                files, inner = file_system(folder)
                for found in files.get_file_info(pyarrow.fs.FileSelector(inner)):
                    if not found.base_name.endswith(suffix):
                        continue
                    with files.open_input_stream(found.path) as held:
                        lines = held.read().decode().removesuffix("\n").split("\n")
                    name = [found.base_name.removesuffix(suffix)] * len(lines)
                    columns = [pa.array(name), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "line_no", "line"])

    listed = spark.createDataFrame(folders, "folder string").repartition(max(1, len(folders)))
    return listed.mapInArrow(apply, "name string, line_no long, line string")


@dataclass
class Written(WriterCommitMessage):
    """The folder a task has written, or None if it had no rows."""

    folder: str | None


class GraphFiles(DataSource):
    """Options: path, and suffix of the file names (.gfa)."""

    @classmethod
    def name(cls) -> str:
        return "graph_files"

    def schema(self) -> str:
        return "graph_id string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("graph_files needs a path")
        return GraphFilesWriter(self.options["path"], self.options.get("suffix", ".gfa"), overwrite)


class GraphFilesWriter(DataSourceWriter):
    """Writes to ``path``/part-*/<graph_id><suffix>; with mode overwrite what was there goes at the commit."""

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.job = uuid.uuid4().hex

    def _staged(self, root: str) -> str:
        return f"{root}/{STAGED}-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = file_system(self.path)
        folder = None
        for graph_id, rows in groupby(iterator, key=lambda row: row.graph_id):
            if folder is None:
                folder = f"part-{uuid.uuid4().hex}"
                files.create_dir(f"{self._staged(root)}/{folder}", recursive=True)
            with files.open_output_stream(f"{self._staged(root)}/{folder}/{graph_id}{self.suffix}") as out:
                for row in rows:
                    out.write(f"{row.line}\n".encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        if self.overwrite:
            for old in files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        files.create_dir(root, recursive=True)
        for message in messages:
            if message and message.folder:
                files.move(f"{self._staged(root)}/{message.folder}", f"{root}/{message.folder}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, files: pyarrow.fs.FileSystem, root: str) -> None:
        if files.get_file_info(self._staged(root)).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(self._staged(root))
