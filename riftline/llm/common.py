"""What the corpus operators share: reading tables, cutting lineage with written tables, and slicing Arrow columns of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster the session must name it; a local master may use its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="riftline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one computation. On leaving it, whether it ended well or not, all go but those kept for a lazy result.

    While it is open, shuffle files go as soon as the query that wrote them ends, and Arrow batches are small.
    """

    #: Folders kept for lazy results, until release().
    kept: list[str] = []
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        self.before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.spark.conf.set(k, v)
        return self

    def path(self, name: str, keep: bool = False) -> str:
        path = f"{shared_dir(self.spark)}/riftline/{name}-{uuid.uuid4().hex}"
        self.paths[path] = keep
        return path

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Write a table to the shared folder and read it back: later stages survive the loss of any executor."""
        path, schema = self.path(name, keep), df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the tables of this name, which nothing will read again."""
        for path in [p for p in self.paths if p.rsplit("/", 1)[1].startswith(f"{name}-")]:
            delete(self.spark, path)
            del self.paths[path]

    def __exit__(self, failed, *_) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        for path, keep in self.paths.items():
            if keep and not failed:
                Scratch.kept.append(path)
            else:
                delete(self.spark, path)
        self.paths = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written for a lazy result; release() deletes it."""
    with Scratch(df.sparkSession) as scratch:
        return scratch.written(df, name, keep=True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders kept for lazy results, from the since-th on. Those results can then no longer be computed."""
    while len(Scratch.kept) > since:
        delete(spark, Scratch.kept.pop())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about size bytes, with the place of the first; nulls are empty. Only one run is in Python objects at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    at = 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, [(x or "").encode() for x in column.slice(at, to - at).to_pylist()]
        at = to
