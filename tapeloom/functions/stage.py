"""Written intermediate tables: what several phases read is worked out once, whatever executors are lost later.

Tables go to spark.checkpoint.dir, the folder that the driver and all executors share. What a result reads must stay
until the result is written, so the caller says when: `with stage.kept(): ...` deletes the tables made inside at its end.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, and that only on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tapeloom-"))


def path_of(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table that is written now."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """Tables written inside are deleted at the end."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            spark, path = _MADE.pop()
            p, fs = path_of(spark, path)
            fs.delete(p, True)
