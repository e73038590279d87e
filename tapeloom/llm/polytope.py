"""Near-duplicate vectors by cross-polytope hashing.

A hash is the largest coordinate, with its sign, after three rounds of random signs and a fast Hadamard transform;
a bucket joins several. Each vector also goes to the buckets its closest runner-up coordinates give. Every pair that
shares a bucket is verified in double precision, and counted in the first bucket that it shares: each vector carries
its bucket keys, which are computed once. Identical vectors stand for one another, and buckets of any size are dealt
out as pairs of chunks, so no pair is dropped and no group gathers in one task.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import scratch
from tapeloom.llm.bytesets import mix
from tapeloom.llm.components import components, local_roots

TABLES, ROTATIONS, PROBES = 10, 3, 4
#: Vectors of a bucket that one task compares with as many others at most: a vector of a large bucket is sent once for
#: so many others.
CHUNK = 4096
LEAST = 0.93
U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def buckets(v: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Bucket keys, TABLES x PROBES a row, of unit vectors; salt keeps groups apart."""
    n, dim = v.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = v
    rng = np.random.default_rng(977 + d)
    keys = np.empty((n, TABLES, PROBES), np.uint64)
    row = np.arange(n)
    for t in range(TABLES):
        code, other, gap = np.empty((n, ROTATIONS), np.uint64), np.empty((n, ROTATIONS), np.uint64), np.empty((n, ROTATIONS))
        for r in range(ROTATIONS):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = size.argmax(1)
            best = size[row, top].copy()
            size[row, top] = -1
            second = size.argmax(1)
            code[:, r] = 2 * top + (y[row, top] < 0)
            other[:, r] = 2 * second + (y[row, second] < 0)
            gap[:, r] = 1 - size[row, second] / np.maximum(best, 1e-300)
        near = gap.argsort(1)
        for p in range(PROBES):
            at = code.copy()
            for bit in range(2):
                if p >> bit & 1:
                    at[row, near[:, bit]] = other[row, near[:, bit]]
            key = salt + U(t + 1)
            for r in range(ROTATIONS):
                key = mix(key * U(2 * d + 1) + at[:, r])
            keys[:, t, p] = key
    return keys


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label (text), v (64-bit floats; null if it can link with nothing)."""

    def run(batches):
        for b in batches:
            out = []
            for x, label in zip(b.column(2), b.column(1).to_pylist(), strict=True):
                v = None
                if x.is_valid and label is not None and not x.values.null_count:
                    a = x.values.to_numpy().astype("<f8")
                    if len(a) and np.isfinite(a).all() and a.any():
                        v = (a + 0.0).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def _salt(labels: list[str], dim: int) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) for x in labels], np.uint64) * U(1 << 16) + U(dim))


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hashed(batches):
    """Classes with the bucket keys of their vectors."""
    for b in batches:
        labels, raw = b.column(0).to_pylist(), b.column(4).to_pylist()
        keys: list[bytes | None] = [None] * len(raw)
        for dim in {len(x) for x in raw}:
            at = [k for k, x in enumerate(raw) if len(x) == dim]
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                got = buckets(_unit([raw[k] for k in part]), _salt([labels[k] for k in part], dim // 8))
                for k, x in zip(part, got, strict=True):
                    keys[k] = x.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "keys"])


def _places(batches):
    """key, rep of each bucket that a class goes to."""
    for b in batches:
        reps = b.column(0).to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(len(reps), -1)
        keys = np.sort(keys, 1)
        on = np.ones(keys.shape, bool)
        on[:, 1:] = keys[:, 1:] != keys[:, :-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(np.repeat(reps, on.sum(1)))], names=["key", "rep"])


def _mine(keys: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.uint64) -> np.ndarray:
    """Whether this bucket is the first that the pairs share: the one in which they count."""
    mine, open_ = np.zeros(len(i), bool), np.arange(len(i))
    for t in range(keys.shape[1]):
        if not len(open_):
            break
        least = np.full(len(open_), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(open_), 1 << 16):
            at = open_[lo : lo + (1 << 16)]
            x, y = keys[i[at], t], keys[j[at], t]
            same = x[:, :, None] == y[:, None, :]
            least[lo : lo + (1 << 16)] = np.where(same.any(2), x, least[lo : lo + (1 << 16), None]).min(1)
        found = least < np.iinfo(np.uint64).max
        mine[open_[found]] = least[found] == key
        open_ = open_[~found]
    return mine


def _verify(least: float):
    def group(key: int, rows: list[tuple]) -> tuple[list, list]:
        """rows: mine (0: first chunk, 1: second), rep, weight, label, v, keys."""
        sums: dict[int, int] = {}
        us, vs = [], []
        for _, part in groupby(sorted(rows, key=lambda r: (r[3], len(r[4]), r[0], r[1])), key=lambda r: (r[3], len(r[4]))):
            part = list(part)
            if len(part) < 2:
                continue
            rep, weight = np.array([r[1] for r in part]), np.array([r[2] for r in part])
            unit = _unit([r[4] for r in part])
            side = np.array([r[0] for r in part])
            keys = np.frombuffer(b"".join([r[5] for r in part]), np.uint64).reshape(len(part), -1, PROBES)
            within = not side.any()
            left = np.arange(len(part)) if within else np.flatnonzero(side == 0)
            right = left if within else np.flatnonzero(side == 1)
            got = np.zeros(len(part), np.int64)
            for lo in range(0, len(left), 256):
                li = left[lo : lo + 256]
                x, y = np.nonzero(unit[li] @ unit[right].T >= least)
                i, j = li[x], right[y]
                on = (i < j) if within else (i != j)
                i, j = i[on], j[on]
                if not len(i):
                    continue
                us.append(rep[i]), vs.append(rep[j])
                first = _mine(keys, i, j, np.int64(key).astype(np.uint64))
                np.add.at(got, i[first], weight[j[first]])
                np.add.at(got, j[first], weight[i[first]])
                if len(us) > 64:
                    nodes, roots = local_roots(np.concatenate(us), np.concatenate(vs))
                    us, vs = [nodes], [roots]
            for r, n in zip(rep[got > 0].tolist(), got[got > 0].tolist(), strict=True):
                sums[r] = sums.get(r, 0) + n
        edges = []
        if us:
            nodes, roots = local_roots(np.concatenate(us), np.concatenate(vs))
            edges = [(n, r) for n, r in zip(nodes.tolist(), roots.tolist(), strict=True) if n != r]
        return list(sums.items()), edges

    def run(batches):
        held, at, out = [], None, []

        def flush():
            kind, rep, value = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(rep, pa.int64()), pa.array(value, pa.int64())], names=["kind", "rep", "value"])

        def settle():
            if len(held) > 1:
                links, edges = group(at[0], held)
                out.extend((0, x, y) for x, y in links)
                out.extend((1, x, y) for x, y in edges)

        for b in batches:
            for key, a, c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (key, a, c) != at:
                    settle()
                    held, at = [], (key, a, c)
                    if len(out) > 20_000:
                        yield flush()
                held.append(tuple(row))
        settle()
        if out:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id, kept (vec_id is component_id).

    Rows link when labels are equal and not null and the cosine is least or more; candidates share a bucket, so a few
    true links may be missed (recall is measured in the tests) and none below least is made. Vectors that are null,
    empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of different length. Repeated
    rows each count as a vector; null ids stay and never link. Other columns are not read. An empty table gives an
    empty one. Identical vectors are told by label and a 128-bit hash.
    """
    spark = vectors.sparkSession
    rows = scratch.Table(_prepared(vectors, id_col, vector_col, label_col).withColumn("code", F.unhex(F.md5("v"))), "vectors").read()
    linkable = F.col("code").isNotNull() & F.col("vec_id").isNotNull()
    with scratch.Work() as work:
        alike = rows.filter(linkable).groupBy("label", "code").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
        classes = work.table(alike.mapInArrow(_hashed, "label string, code binary, rep long, weight long, v binary, keys binary"), "vector-classes")
        keyed = classes.select("rep", "keys").mapInArrow(_places, "key long, rep long")
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("k", F.ceil(F.col("n") / CHUNK).cast("int"))
        dealt = (
            keyed.join(shared, "key")
            .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .select("key", "rep", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("int").alias("mine"))
        )
        full = dealt.join(classes.select("rep", "weight", "label", "v", "keys"), "rep").select("key", "a", "b", "mine", "rep", "weight", "label", "v", "keys")
        found = work.table(full.repartition(scratch.width(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_verify(least), "kind int, rep long, value long"), "vector-links")
        links = found.filter("kind = 0").groupBy("rep").agg(F.sum("value").alias("near"))
        comps = components(found.filter("kind = 1").select(F.col("rep").alias("u"), F.col("value").alias("v")), work).select(F.col("node").alias("rep"), "component_id")
        near = (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")
        known = scratch.Table(classes.join(links, "rep", "left").join(comps, "rep", "left").select("label", "code", near, F.coalesce("component_id", "rep").alias("component_id")), "vector-answers").read()
    joined = rows.filter(linkable).join(known, ["label", "code"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
