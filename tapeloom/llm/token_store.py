"""Token ids on disk: frequency-ranked, one to four data bytes each, lengths in separate control bytes.

A store is a folder of two tables. `ranks` has the ids by falling frequency. `blocks` has rows of about
BLOCK_TOKENS tokens in ascending id order: `control` holds four 2-bit lengths a byte, `data` the ranks' bytes,
lowest first. Files are written by Spark's committer, so a lost executor leaves no half-written block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import scratch
from tapeloom.llm.bytesets import groups, text_bytes
from tapeloom.llm.vocab import encoder

BLOCK_TOKENS = 1 << 18
BATCH_BYTES = 2 << 20
_SHIFT = np.arange(0, 8, 2, dtype=np.uint8)
#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> _SHIFT) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFT, axis=1) if len(v) else padded
    ends = np.cumsum(code.astype(np.int64) + 1)
    at = ends - code - 1
    data = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        longer = np.flatnonzero(code >= k)
        if not len(longer):
            break
        data[at[longer] + k] = (v[longer] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again: lengths by table lookup, then one masked load each."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    four = np.ndarray((max(len(data), 1),), "<u4", data + b"\0\0\0\0", strides=(1,))
    return four[at] & _MASK[size] if n else np.zeros(0, np.uint32)


def _encode(docs: DataFrame, tokenizer_path: str, end_id: int, wide: bool) -> DataFrame:
    """A row per document with its ids, and a row per task with its id counts."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        enc, counts = encoder(tokenizer_path), np.zeros(1 << 12, np.int64)
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j in groups(offs, BATCH_BYTES):
                got_ids, n = enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                flat = np.insert(got_ids, np.cumsum(n), end_id)
                n += 1
                got = np.bincount(flat, minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
                small, at = flat.astype(kind), np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int32()), pa.array([small[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary()), pa.nulls(j - i, pa.binary())],
                    names=["doc_id", "n", "ids", "counts"],
                )
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, counts[used]]).astype("<i8").tobytes()], pa.binary())],
            names=["doc_id", "n", "ids", "counts"],
        )

    return docs.mapInArrow(run, "doc_id long, n int, ids binary, counts binary")


def _ranked(encoded: DataFrame) -> list[int]:
    """Ids by falling count, then by id: at most the vocabulary's size, whatever the corpus."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                ids, n = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    found = encoded.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return [x["id"] for x in sorted(found, key=lambda x: (-x["n"], x["id"]))]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocab_size: int | None = None, parts: int | None = None) -> None:
    """Encode every whole text, append end_id, and write the store in ascending id order.

    A null text is an empty document (just end_id); a null id comes first; rows with equal ids all stay, in order of a
    hash of their tokens; an empty table gives an empty store; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wide = vocab_size is None or max(vocab_size, end_id + 1) > 1 << 16
    kept = scratch.Table(_encode(rows, tokenizer_path, end_id, wide), "token-ids")
    encoded = kept.read()
    order = _ranked(encoded)
    spark.createDataFrame([(k, x) for k, x in enumerate(order)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    kind = "<u4" if wide else "<u2"

    def run(batches):
        part, inner = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0  # tokens in held

        def block():
            nonlocal inner
            values = shared.value[np.frombuffer(b"".join(held), kind)]
            control, data = pack(values)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([inner], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "inner", "n_tokens", "doc_ids", "sizes", "control", "data"],
            )
            inner += len(values)
            ids.clear(), sizes.clear(), held.clear()
            return out

        for b in batches:
            for doc, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and total + n > BLOCK_TOKENS:
                    yield block()
                    total = 0
                ids.append(doc), sizes.append(n), held.append(x)
                total += n
        if held:
            yield block()

    # the hash only parts rows of one id (or of none), so that they need not share a task
    texts = encoded.filter("counts is null").select("doc_id", "n", "ids", F.xxhash64("ids").alias("h"))
    dealt = texts.repartitionByRange(parts or scratch.width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    dealt.mapInArrow(run, "part int, inner long, n_tokens long, doc_ids array<bigint>, sizes array<int>, control binary, data binary").write.parquet(f"{path}/blocks")
    kept.drop()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids (32-bit, little-endian)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = [x["id"] for x in sorted(spark.read.parquet(f"{path}/ranks").collect(), key=lambda x: x["rank"])]
    shared = spark.sparkContext.broadcast(np.array(order, "<u4"))
    totals = {x["part"]: x["n"] for x in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per file
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    before = spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")

    def run(batches):
        for b in batches:
            for n, docs, sizes, control, data, start in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                ids = shared.value[unpack(control, data, n)]
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + at[:-1]), pa.array(sizes, pa.int64()), pa.array([ids[at[k] : at[k + 1]].tobytes() for k in range(len(docs))], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    joined = blocks.join(F.broadcast(before), "part").select("n_tokens", "doc_ids", "sizes", "control", "data", (F.col("base") + F.col("inner")).alias("start"))
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int) -> DataFrame:
    """Write a store, read it back, and give each document's start, size and checksum."""
    path = f"{scratch.folder(spark)}/token-store-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, vocab_size=vocab_size)
    return read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


__all__ = ["digest", "pack", "read", "unpack", "write"]
