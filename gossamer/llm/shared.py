"""Files in the shared folder, reached the same way from the driver and from every executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.session import fresh, materialize, prepare

__all__ = ["Notes", "create", "fetch", "filesystem", "fresh", "materialize", "notes", "prepare", "replayable", "row_number", "scratch", "source", "texts_of"]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one, which gossamer.session.clean deletes."""
    uri = fresh(spark, tag)
    files, path = filesystem(uri)
    files.create_dir(path, recursive=True)
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """file:, hdfs:, s3: and the like; a path without a scheme is local."""
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def create(uri: str) -> Iterator[pa.NativeFile]:
    """A new file that gets its name when it is whole, so a lost attempt leaves no half file and a second one replaces the first."""
    files, path = filesystem(uri)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(attempt) as out:
        yield out
    files.move(attempt, path)


def source(uri: str) -> pa.NativeFile:
    """A file opened for reads at any place."""
    files, path = filesystem(uri)
    return files.open_input_file(path)


def fetch(uri: str) -> bytes:
    """All bytes of a file."""
    with source(uri) as file:
        return file.read()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Nodes of a plan whose partitions and rows come out the same whenever it runs.
_STEADY = {"Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias", "View"}


def replayable(df: DataFrame) -> DataFrame:
    """df, if it only reads, filters and projects files; otherwise a written copy.  Either gives its rows the same `row_number` in every job.

    How files are cut into partitions depends on the number of cores that are there; it is fixed to the present one for the session.
    """
    spark = df.sparkSession
    if not int(spark.conf.get("spark.sql.files.minPartitionNum", None) or 0):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan, todo = df._jdf.queryExecution().analyzed(), []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() not in _STEADY or not node.deterministic():
            return materialize(df, "replayable")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return df


def row_number() -> Column:
    """The place of a row of a `replayable` table: its partition above 33 bits for its place there."""
    return F.monotonically_increasing_id()


def notes(rows: DataFrame) -> str:
    """Writes what is said of some rows (row, and other columns) for the tasks that will meet them again, a folder for each partition; returns the URI.

    A task reads its own partition's notes alone, so its share is bounded by its rows and large columns need not be moved to them.
    """
    uri = fresh(rows.sparkSession, "notes")
    dealt = rows.withColumn("task", F.shiftright("row", 33)).repartition("task").sortWithinPartitions("task", "row")
    dealt.write.partitionBy("task").parquet(uri)
    return uri


class Notes:
    """One task's notes: `at[k]` and the columns' k-th values, in the order of the task's rows."""

    def __init__(self, uri: str, task: int):
        files, path = filesystem(f"{uri}/task={task}")
        found = []
        if files.get_file_info(path).type == pafs.FileType.Directory:
            for name in sorted(f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet")):
                with files.open_input_file(name) as file:
                    found.append(pq.ParquetFile(file).read())
        self.table = pa.concat_tables(found).sort_by("row") if found else None
        self.at = self.table.column("row").to_numpy() & ((1 << 33) - 1) if found else np.zeros(0, np.int64)
        self.place = self.begin = 0

    def upto(self, n: int) -> tuple[np.ndarray, pa.Table | None]:
        """(places among the next n rows of the task that have notes, their notes)."""
        end = int(np.searchsorted(self.at, self.begin + n))
        at, some = self.at[self.place : end] - self.begin, self.table.slice(self.place, end - self.place) if self.table is not None else None
        self.place, self.begin = end, self.begin + n
        return at, some
