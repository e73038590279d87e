"""Intermediate tables in the folder that driver and executors share, and rows dealt to buckets of bounded size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Bytes that a bucket should hold: a task works on one bucket at a time.
BUCKET_BYTES = 64 << 20


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own, and only on one machine.

    On a cluster an unset folder is an error: executors would not see what others wrote.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        if own not in _OWN:
            _OWN[own] = tempfile.mkdtemp(prefix="tapeloom-")
        at = _OWN[own]
    return at.rstrip("/")


#: Tables that are not dropped yet, in the order of their making.
_KEPT: list[Table] = []


class Table:
    """A written table: reading it again needs no upstream stage, whatever executors were lost."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _KEPT.append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files once no later stage reads them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in _KEPT:
            _KEPT.remove(self)


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """What results read is a table too, and stays; of those made inside, the rest is deleted at the end: write results before."""
    before = len(_KEPT)
    try:
        yield
    finally:
        for t in _KEPT[before:][::-1]:
            t.drop()


class Work:
    """Tables of one operator's run, deleted at its end; what its result reads is written as a Table of its own."""

    def __init__(self):
        self.own: list[Table] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.own.append(Table(df, name))
        return self.own[-1].read()

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        for t in self.own:
            t.drop()


def width(spark: SparkSession) -> int:
    """Partitions to deal blocks of rows to: the session's own shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, total_bytes: int | None) -> int:
    """Buckets for so many bytes: the shuffle width, or as many more as keep each near BUCKET_BYTES."""
    return max(width(spark), -(-(total_bytes or 0) // BUCKET_BYTES))


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with a column bucket (0..buckets - 1), each bucket in one task and its rows together."""
    n = width(rows.sparkSession)
    if buckets <= n:
        return rows.repartitionById(n, F.col("bucket"))
    return rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")


def each_bucket(of: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that hands over the rows of one bucket (the first column) at a time."""

    def run(batches):
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and ids[i] != now:
                    yield from of(int(now), held)
                    held = []
                now = ids[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from of(int(now), held)

    return run
