"""Repeated byte strings, by a blockwise suffix order over a difference cover.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Suffixes need only be told apart
by `length` bytes, so the cover is content-defined: of each such window, the smallest hash among its 32-byte grams
marks one position, and equal windows mark the same one. As in a difference cover, any two suffixes that tie that far
have marked positions at an equal distance. The suffixes with one distance to marked positions of one hash form a
bucket. Marked positions are ranked once, by the text to their right and the reversed text to their left; then one
bucket at a time is put in order, all its long ties resolved by those ranks (and the common lengths of neighbours in
rank), so no suffix is ever compared byte by byte and memory is bounded by the block at hand.

Marked positions whose hash occurs once are dropped before any text is moved. What a task finds repeated among its own
rows it passes on as such and asks of it once, and blocks of texts settle their own ties first and send on one suffix
of each tie, so a passage in a third of all rows reaches its bucket once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import scratch
from tapeloom.llm.bytesets import Rolling, groups, text_bytes

LENGTH, GRAM = 400, 32
#: Texts are cut into stretches of so many bytes, overlapping by a window less a byte; places fit PLACE bits.
STRETCH, PLACE = 8 << 20, 24
#: Marked positions that a task looks through for repetitions of its own before it deals them out, and the suffixes
#: that are settled at a time.
HELD, BLOCK = 1 << 18, 20_000
U = np.uint64


def _stretches(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, row offsets, first row, and the bytes of that row before the stretch."""
    for i, j in groups(offs):
        if offs[j] - offs[i] <= STRETCH:
            yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, 0
            continue
        step = STRETCH - length + 1
        for at in range(0, max(1, int(offs[j] - offs[i]) - length + 1), step):
            part = data[offs[i] + at : min(offs[i] + at + STRETCH, offs[j])]
            yield part, np.array([0, len(part)]), i, at


def marks(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a marked position: its hash and place, the first and the last window."""
    k, n = length - GRAM + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    h = Rolling(data).windows(GRAM)
    h = (h >> U(PLACE) << U(PLACE)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    block = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    m = n - length + 1
    least = np.minimum(back[:m], ahead[k - 1 : k - 1 + m])
    row_end = offs[1:]
    sound = np.zeros(m, bool)
    for a, b in zip(offs[:-1].tolist(), row_end.tolist(), strict=True):
        if b - a >= length:
            sound[a : b - length + 1] = True
    starts = np.flatnonzero(sound)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    value = value[first]
    return value >> U(PLACE), (value & U((1 << PLACE) - 1)).astype(np.int64), starts[first], starts[last]


def _common(texts: list[bytes], width: int, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common length of each text in order with the one before it; -1 where another group begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 4096):
        now, was = order[lo : lo + 4096], order[lo - 1 : lo - 1 + len(order[lo : lo + 4096])]
        a, b = (np.frombuffer(b"".join([texts[k].ljust(width, b"\0") for k in at.tolist()]), np.uint8).reshape(len(at), width) for at in (now, was))
        odd = a != b
        same = np.where(odd.any(1), odd.argmax(1), width)
        out[lo : lo + len(now)] = np.where(group[now] == group[was], np.minimum(same, np.minimum(size[now], size[was])), -1)
    return out


class Ties(NamedTuple):
    """Runs of tied suffixes (occurrence, nearest and farthest distance), and the range of each occurrence's first suffixes."""

    of: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leads: np.ndarray
    low: np.ndarray
    high: np.ndarray


def settle(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH) -> Ties:
    """Which suffixes tie with another over length bytes, and which come first of their tie.

    Occurrence i of a marked position (of hash hashes[i]) has the suffixes that start low[i]..high[i] bytes before it;
    left[i] is the text before it reversed, right[i] the text from it on. Memory is that of the texts and a few numbers
    an occurrence.
    """
    n, k = len(hashes), length - GRAM + 1
    group = hashes.tolist()
    rank = np.array(sorted(range(n), key=lambda i: (group[i], right[i])), np.int64)
    mirror = np.array(sorted(range(n), key=lambda i: (group[i], left[i])), np.int64)
    ahead, behind = _common(right, length, rank, hashes), _common(left, k, mirror, hashes)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    since, leads, least, most = np.full(n, -1), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs = []
    for s in range(k + 1):
        tied = np.zeros(n, bool)
        live = np.flatnonzero((low <= s) & (s <= high)) if s < k else []
        if len(live):
            a[rank], b[mirror] = np.cumsum(ahead < length - s), np.cumsum(behind < s)
            key = a[live] * (n + 1) + b[live]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twin = np.zeros(len(live), bool)
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            tied[live] = twin
            first = np.ones(len(live), bool)
            first[order[1:]] = ~same
            first = live[first]
            least[first[~leads[first]]] = s
            most[first], leads[first] = s, True
        over = np.flatnonzero(~tied & (since >= 0))
        if len(over):
            runs.append(np.stack([over, since[over], np.full(len(over), s - 1)]))
            since[over] = -1
        since[tied & (since < 0)] = s
    return Ties(*(np.concatenate(runs, 1) if runs else np.zeros((3, 0), np.int64)), leads, least, most)


#: A marked position asks whether its hash has another place; it may also speak for places that are known to be
#: repeated, or be one of those.
ASKS, SPEAKS, KNOWN = 0, 1, 2
_MARK = np.dtype([("hash", "<u8"), ("key", "S16"), ("at", "<u4"), ("kind", "u1")])
_SPOT = np.dtype([("hash", "<u8"), ("key", "S16"), ("place", "<i8"), ("low", "<u4"), ("high", "<u4"), ("left", "<u4"), ("right", "<u4")])


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.dtype("V16")).view("S16") if len(column) else np.zeros(0, "S16")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their hashes, each once, and whether the hash has others."""
    rows = rows[np.lexsort((rows["at"], rows["key"], rows["hash"]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:]["hash"] != rows[:-1]["hash"]) | (rows[1:]["key"] != rows[:-1]["key"]) | (rows[1:]["at"] != rows[:-1]["at"])
    rows = rows[fresh]
    same = rows[1:]["hash"] == rows[:-1]["hash"]
    twin = np.zeros(len(rows), bool)
    twin[1:] |= same
    twin[:-1] |= same
    return rows, twin


def _mark_blocks(buckets: int, length: int):
    """Marked positions of texts (key, text), dealt by hash, those known to be repeated by text: bucket, block."""

    def send(held: list[np.ndarray]):
        rows, twin = _distinct(np.concatenate(held))
        known = rows[twin]
        known["kind"] = KNOWN
        speaks = known[np.append(True, known[1:]["hash"] != known[:-1]["hash"])] if len(known) else known
        speaks["kind"] = SPEAKS
        by_text = np.frombuffer(known["key"].astype("S16").tobytes(), "<u8").reshape(-1, 2)[:, 0] if len(known) else np.zeros(0, np.uint64)
        rows = np.concatenate([rows[~twin], speaks, known])
        yield from _dealt(rows, np.concatenate([rows["hash"][: len(rows) - len(known)], by_text]), buckets, [])

    def run(batches):
        held, count = [], 0
        for b in batches:
            keys, (data, offs) = _keys(b.column(0)), text_bytes(b.column(1))
            for part, at, row, before in _stretches(data, offs, length):
                h, _, lo, _ = marks(part, at, length)
                of = np.searchsorted(at, lo, "right") - 1
                out = np.empty(len(h), _MARK)
                out["hash"], out["key"], out["at"], out["kind"] = h, keys[row + of], lo - at[of] + before, ASKS
                held.append(out)
                count += len(out)
                if count >= HELD:
                    yield from send(held)
                    held, count = [], 0
        if held:
            yield from send(held)

    return run


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int, texts: list[bytes]):
    bucket = (by % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    if not len(which):
        return
    cut = np.append(first, len(order))
    own = [order[cut[k] : cut[k + 1]] for k in range(len(which))]
    cols = [pa.array(which), pa.array([rows[x].tobytes() for x in own], pa.binary())]
    names = ["bucket", "rows"]
    if texts:
        cols.append(pa.array([b"".join([texts[k] for k in x.tolist()]) for x in own], pa.binary()))
        names.append("texts")
    yield pa.RecordBatch.from_arrays(cols, names=names)


@scratch.each_bucket
def _repeated(_, batches):
    """Of a bucket, the marked positions whose hash has two places or more: key, positions."""
    rows = np.frombuffer(b"".join([x for b in batches for x in b.column(1).to_pylist()]), _MARK)
    known, (asking, twin) = rows[rows["kind"] == KNOWN], _distinct(rows[rows["kind"] == ASKS])
    spoken = np.isin(asking["hash"], rows["hash"][rows["kind"] == SPEAKS])
    rows = np.concatenate([known, asking[twin | spoken]])
    rows = rows[np.argsort(rows["key"], kind="stable")]
    _, first = np.unique(rows["key"], return_index=True)
    cut = np.append(first, len(rows))
    if len(rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows["key"][i].ljust(16, b"\0") for i in first], pa.binary()), pa.array([rows["at"][cut[k] : cut[k + 1]].tobytes() for k in range(len(first))], pa.binary())], names=["key", "at"]
        )


def _removed(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Rows of byte ranges, one per key, as a batch of the common schema."""
    order = np.argsort(keys, kind="stable")
    which, first = np.unique(keys[order], return_index=True)
    cut = np.append(first, len(order))
    pairs = np.stack([lo, hi], 1).astype("<i8")[order]
    return [x.ljust(16, b"\0") for x in which.tolist()], [pairs[cut[k] : cut[k + 1]].tobytes() for k in range(len(which))]


def _out(bucket, rows, texts, keys, ranges):
    n, m = len(bucket), len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([*bucket, *[None] * m], pa.int32()), pa.array([*rows, *[None] * m], pa.binary()), pa.array([*texts, *[None] * m], pa.binary()), pa.array([*[None] * n, *keys], pa.binary()), pa.array([*[None] * n, *ranges], pa.binary())],
        names=["bucket", "rows", "texts", "key", "ranges"],
    )


_SCHEMA = "bucket int, rows binary, texts binary, key binary, ranges binary"


def _settle_block(part: np.ndarray, left: list[bytes], right: list[bytes], length: int):
    """Ranges of tied suffixes by text (keys, ranges), and the suffixes that stand for the rest: rows, their places in part."""
    ties = settle(part["hash"], part["low"], part["high"], left, right, length)
    at = part["place"][ties.of]
    found = _removed(part["key"][ties.of], at - ties.far, at - ties.near + length) if len(at) else ([], [])
    on = np.flatnonzero(ties.leads)
    leads = part[on]
    leads["low"], leads["high"] = ties.low[on], ties.high[on]
    return found, leads, on.tolist()


def _around(buckets: int, length: int):
    """The suffixes at repeated marked positions (key, text, at): ties within the block are settled, the rest sent on."""

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b.column(1))
            keys, wanted = _keys(b.column(0)), b.column(2).to_pylist()
            for part, at, row, before in _stretches(data, offs, length):
                h, place, lo, hi = marks(part, at, length)
                of = np.searchsorted(at, lo, "right") - 1
                ask = np.concatenate([np.frombuffer(b"".join(wanted[row + k]), "<u4").astype(np.int64) + at[k] - before for k in range(len(at) - 1)])
                on = np.flatnonzero(np.isin(lo, ask))
                raw = part.tobytes()
                for first in range(0, len(on), BLOCK):
                    x = on[first : first + BLOCK]
                    out = np.empty(len(x), _SPOT)
                    out["hash"], out["key"] = h[x], keys[row + of[x]]
                    out["place"] = place[x] - at[of[x]] + before
                    out["low"], out["high"] = place[x] - hi[x], place[x] - lo[x]
                    out["left"], out["right"] = place[x] - lo[x], hi[x] + length - place[x]
                    left = [raw[i:j][::-1] for i, j in zip(lo[x].tolist(), place[x].tolist(), strict=True)]
                    right = [raw[i:j] for i, j in zip(place[x].tolist(), (hi[x] + length).tolist(), strict=True)]
                    (k, ranges), sent, who = _settle_block(out, left, right, length)
                    for batch in _dealt(sent, sent["hash"], buckets, [left[m] + right[m] for m in who]) if len(sent) else ():
                        yield _out(*(c.to_pylist() for c in batch.columns), [], [])
                    if k:
                        yield _out([], [], [], k, ranges)

    return run


def _settled(length: int):
    """A bucket's ties: key, ranges of the bytes that tied suffixes cover."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["key", "ranges"])

    def of(_, batches):
        spots, left, right = [], [], []
        for b in batches:
            for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(r, _SPOT)
                spots.append(x)
                at = np.concatenate([[0], np.cumsum(x["left"].astype(np.int64) + x["right"])]).tolist()
                for k, m in enumerate(x["left"].tolist()):
                    left.append(t[at[k] : at[k] + m])
                    right.append(t[at[k] + m : at[k + 1]])
        all_ = np.concatenate(spots)
        order = np.argsort(all_["hash"], kind="stable")
        first = np.flatnonzero(np.append(True, all_["hash"][order][1:] != all_["hash"][order][:-1]))
        ends = np.append(first[1:], len(order))
        lo = 0
        while lo < len(first):  # a block of whole groups at a time
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + BLOCK, "right")))
            at = order[first[lo] : ends[hi - 1]]
            lo = hi
            part = all_[at]
            while len(part) > BLOCK:  # one group of many: those alike settle among themselves first
                at = at[sorted(range(len(at)), key=lambda k: right[at[k]])]
                part, own, leads = all_[at], [], []
                for k in range(0, len(at), BLOCK):
                    where = at[k : k + BLOCK]
                    found, lead, who = _settle_block(all_[where], [left[m] for m in where.tolist()], [right[m] for m in where.tolist()], length)
                    all_[where[who]] = lead
                    own.append(where[who])
                    if found[0]:
                        yield batch(found)
                at = np.concatenate(own)
                if len(at) > 0.9 * len(part):
                    break
                part = all_[at]
            if len(at) > 1:
                found, _, _ = _settle_block(all_[at], [left[k] for k in at.tolist()], [right[k] for k in at.tolist()], length)
                if found[0]:
                    yield batch(found)

    return scratch.each_bucket(of)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def find(docs: DataFrame, work: scratch.Work, length: int = LENGTH) -> DataFrame:
    """key (128-bit hash of a text), ranges (arrays of byte ranges, unmerged) of texts with bytes to remove; docs: doc_id, text (no nulls).

    The result reads tables of work.
    """
    spark = docs.sparkSession
    long = docs.filter(F.octet_length("text") >= length).withColumn("key", _text_key(F.col("text")))
    seen = work.table(long.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).cast("long").alias("n")), "text-keys")
    size = seen.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    buckets = scratch.bucket_count(spark, 2 * _MARK.itemsize * size // (length - GRAM + 1))
    blocks = long.select("key", "text").mapInArrow(_mark_blocks(buckets, length), "bucket int, rows binary")
    marked = work.table(scratch.dealt(blocks, buckets).mapInArrow(_repeated, "key binary, at binary"), "repeated-marks")
    buckets = scratch.bucket_count(spark, 2 * length * ((marked.agg(F.sum(F.octet_length("at"))).first()[0] or 0) // 4))
    chosen = marked.groupBy("key").agg(F.collect_list("at").alias("at")).join(seen, "key").select("key", F.col("doc_id").alias("own"), "at")
    texts = long.join(chosen, (long["key"] == chosen["key"]) & long["doc_id"].eqNullSafe(chosen["own"])).select(long["key"], "text", "at")
    spots = work.table(texts.mapInArrow(_around(buckets, length), _SCHEMA), "suffixes")
    far = scratch.dealt(spots.filter("bucket is not null").select("bucket", "rows", "texts"), buckets).mapInArrow(_settled(length), "key binary, ranges binary")
    near = spots.filter("key is not null").select("key", "ranges")
    whole = seen.filter("copies > 1").select("key", F.unhex(F.concat(F.lit("00" * 8), _little(F.col("n")))).alias("ranges"))
    return far.unionByName(near).unionByName(whole).groupBy("key").agg(F.collect_list("ranges").alias("ranges"))


def _little(n: Column) -> Column:
    """Hex of a 64-bit number, lowest byte first."""
    h = F.lpad(F.hex(n), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


def merged(ranges: list[bytes]) -> np.ndarray:
    """Disjoint ascending ranges of the same bytes."""
    x = np.frombuffer(b"".join(ranges), "<i8").reshape(-1, 2)
    if not len(x):
        return x
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    end = np.maximum.accumulate(x[:, 1])
    new = np.append(True, x[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([x[first, 0], end[np.append(first[1:], len(x)) - 1]], 1)


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left), spans (byte ranges); with extra, doc_id, text and those columns.

    A null text counts as empty; null ids and repeated rows stay (a repeated row of length bytes or more goes whole,
    as any exact copy does); other columns are not read. kept_sha256 is over the bytes left; in text, the bytes of
    a character that a range cut are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct(*(F.col(c) for c in extra)).alias("rest")] if extra else []))
    with scratch.Work() as work:
        cuts = scratch.Table(find(rows.select("doc_id", "text"), work, length), "removed").read()

    def run(batches):
        for b in batches:
            ids, cols = b.column(0), {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans")}
            data, offs = text_bytes(b.column(1))
            raw = data.tobytes()
            for k, found in enumerate(b.column(2).to_pylist()):
                text = raw[offs[k] : offs[k + 1]]
                spans = merged(found).tolist() if found else []
                kept, at = [], 0
                for i, j in spans:
                    kept.append(text[at:i])
                    at = j
                kept.append(text[at:])
                left = b"".join(kept)
                for name, x in zip(cols, (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), b"".join(x.decode(errors="ignore").encode() for x in kept).decode() if spans else text.decode(), spans), strict=True):
                    cols[name].append(x)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            if extra is None:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))], names=["doc_id", *cols])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols["text"], pa.string()), *b.columns[3:]], names=["doc_id", "text", *b.schema.names[3:]])

    # only texts that are long enough are looked up; the others stay where they are
    long = F.octet_length("text") >= length
    joined = rows.filter(long).withColumn("key", _text_key(F.col("text"))).join(cuts, "key", "left").drop("key")
    joined = joined.unionByName(rows.filter(~long).withColumn("ranges", F.lit(None).cast("array<binary>")))
    if extra is not None:
        more = ["rest"] if extra else []
        kept = joined.select("doc_id", "text", "ranges", *more).mapInArrow(run, joined.select("doc_id", "text", *more).schema)
        return kept.select("doc_id", "text", *(F.col("rest").getField(c).alias(c) for c in extra))
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<array<bigint>>")
