"""Parquet tables in partitions, saved as a whole or not at all.

A save writes the next state of the partitions that it touches beside the table, marks it ready by one rename, and then
swaps partition by partition. A save that is stopped before the mark leaves the old state; one that is stopped after it
is finished by whoever opens the table next. So a repeated save gives the state of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapeloom.functions.stage import path_of, written
from tapeloom.operators import storage as st

#: Partitions that one save may touch: their names go through the driver.
MOST_TOUCHED = 100_000
_SAVES, _READY, _GONE = "_saves", "_saves/ready", "_gone"
_NULL = "__HIVE_DEFAULT_PARTITION__"


class Table:
    """A stored table. by: partition columns as SQL expressions over the rows; they must follow from the key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], by: dict[str, str]):
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), list(key), by
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()
        # a partition column that the rows have too would be stored twice
        if set(by) & set(self.columns):
            raise ValueError("partition columns need names of their own")
        self._finish()

    # -- files

    def _at(self, name: str = ""):
        return path_of(self.spark, f"{self.path}/{name}" if name else self.path)

    def _partitions(self, below: str) -> list[str]:
        """Paths of the partitions in a folder, relative to it: names of as many levels as by has."""
        found = [""]
        for _ in self.by:
            nxt = []
            for name in found:
                p, fs = self._at(f"{below}/{name}".strip("/") if below or name else "")
                if fs.exists(p):
                    nxt += [f"{name}/{s.getPath().getName()}".strip("/") for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName()[0] not in "_."]
            found = nxt
        return found

    def _finish(self) -> None:
        """Swap what a save left ready; forget what it left unfinished."""
        ready, fs = self._at(_READY)
        if fs.exists(ready):
            self._swap()
        saves, fs = self._at(_SAVES)
        if fs.exists(saves):
            fs.delete(saves, True)

    def _swap(self) -> None:
        mark, fs = self._at(f"{_READY}/{_GONE}")
        if fs.exists(mark):
            stream = fs.open(mark)
            gone = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
        else:
            gone = []
        for name in gone:
            p, fs = self._at(name)
            fs.delete(p, True)
        for name in self._partitions(_READY):
            old, fs = self._at(name)
            new, _ = self._at(f"{_READY}/{name}")
            fs.delete(old, True)
            fs.mkdirs(old.getParent())
            if not fs.rename(new, old):
                raise OSError(f"could not move {new} to {old}")
        ready, fs = self._at(_READY)
        fs.delete(ready, True)

    # -- rows

    def read(self) -> DataFrame:
        """All rows, with the partition columns as strings after their own."""
        schema = StructType([*self.schema.fields, *(StructField(name, StringType()) for name in self.by)])
        if not self._partitions(""):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().select(*self.columns)

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumns({k: F.expr(v).cast("string") for k, v in self.by.items()})

    def _touched(self, placed: DataFrame) -> list[tuple]:
        found = [tuple(r) for r in placed.select(*self.by).distinct().limit(MOST_TOUCHED + 1).collect()]
        if len(found) > MOST_TOUCHED:
            raise ValueError(f"a save may touch {MOST_TOUCHED} partitions at most")
        return found

    def _only(self, touched: list[tuple]):
        """A filter of literals on partition columns: other partitions are not even listed."""
        first, *rest = self.by
        groups: dict = {}
        for value, *others in touched:
            groups.setdefault(value, []).append(others)
        same = lambda name, v: F.col(name).isNull() if v is None else F.col(name) == v

        def any_of(name: str, values: list) -> object:
            some = [v for v in dict.fromkeys(values) if v is not None]
            test = F.col(name).isin(some) if some else F.lit(False)
            return test | F.col(name).isNull() if None in values else test

        if not rest:
            return any_of(first, [v for v, *_ in touched])
        if len(rest) == 1:
            return reduce(lambda a, b: a | b, [same(first, v) & any_of(rest[0], [o[0] for o in others]) for v, others in groups.items()])
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [same(n, v) for n, v in zip(self.by, t, strict=True)]) for t in touched])

    def _save(self, state: DataFrame, touched: list[tuple]) -> None:
        if not touched:
            return
        own = uuid.uuid4().hex
        state.repartition(*self.by).write.partitionBy(*self.by).parquet(f"{self.path}/{_SAVES}/{own}")
        self._staged(own, touched)
        self._swap()

    def _staged(self, own: str, touched: list[tuple]) -> None:
        have = {unquote(x) for x in self._partitions(f"{_SAVES}/{own}")}
        before = self._partitions("")
        names = {"/".join(f"{k}={_NULL if v is None else v}" for k, v in zip(self.by, t, strict=True)) for t in touched}
        gone = [x for x in before if unquote(x) in names and unquote(x) not in have]
        mark, fs = self._at(f"{_SAVES}/{own}/{_GONE}")
        stream = fs.create(mark, True)
        stream.write(bytearray(json.dumps(gone).encode()))
        stream.close()
        staged, _ = self._at(f"{_SAVES}/{own}")
        ready, _ = self._at(_READY)
        if not fs.rename(staged, ready):
            raise OSError(f"could not move {staged} to {ready}")

    # -- saves

    def upsert(self, new: DataFrame, keep: Sequence[str] = (), order: Sequence[str] = (), settled: bool = False) -> None:
        """new over the stored rows by key. Of rows of one key in new that with the largest order counts (then any); columns in keep fall back to the stored value where new has null.

        new is read twice, for the partitions it touches and for its rows: it is written first, unless it is settled
        (cheap to read again, and the same each time).
        """
        self._finish()
        if order:
            new = st.newest(new, 1, [F.desc_nulls_last(c) for c in order], self.key)
        placed = self._placed(new) if settled else written(self._placed(new), "table-new")
        touched = self._touched(placed)
        if not touched:
            return
        old = self.read().filter(self._only(touched)).select(*self.columns)
        self._save(self._placed(st.upsert(old, placed.select(*self.columns), self.key, list(keep))), touched)

    def replace(self, new: DataFrame) -> None:
        """Every partition that new has rows of holds those and no others: delete and insert by partition."""
        self._finish()
        placed = written(self._placed(new), "table-new")
        self._save(placed, self._touched(placed))

    def append(self, new: DataFrame) -> None:
        """new beside the stored rows."""
        self._finish()
        placed = written(self._placed(new), "table-new")
        touched = self._touched(placed)
        if touched:
            self._save(self.read().filter(self._only(touched)).unionByName(placed), touched)

    def rewrite(self, change) -> None:
        """The rows that change(rows) leaves: retention and purges, which touch every partition."""
        self._finish()
        before = self._placed(self.rows())
        touched = self._touched(before)
        if touched:
            self._save(written(self._placed(change(before.select(*self.columns))), "table-next"), touched)
