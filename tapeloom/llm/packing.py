"""Token sequences of near-equal length by multiway differencing.

Documents are cut where they fill whole sequences; what is left of each is a part. Parts are dealt to buckets of about
WINDOWS sequences, and each bucket is balanced on its own. Differencing starts with one partial partition a part: that
part in one window, nothing in the others. The two partitions of largest imbalance merge so that the fullest window of
one meets the emptiest of the other, until one partition is left, whose windows are near equal. Where a window exceeds
its capacity, the number of windows rises as long as that costs no more padding than SLACK; what still exceeds it is cut
at the capacity, and the cut parts are balanced again with those of the windows that stay too empty. The last window of a
bucket is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import scratch
from tapeloom.llm.bpe_stream import transducer
from tapeloom.llm.bytesets import groups, text_bytes

#: Windows that a bucket should need: the merges of a bucket cost its parts times its windows.
WINDOWS = 256
#: Share of a window that may stay empty.
SLACK = 1 / 256
BATCH_BYTES = 2 << 20
#: Bits for a row's place in its task, and for a window's in its bucket.
PLACE, WINDOW_PLACE = 40, 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Places in sizes, in k groups of near-equal sums; groups may be empty. Equal sizes keep their order."""
    if k == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    # a partition: its windows that hold something, as (size above the emptiest window, tree of places), largest first
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = max(0, k - len(b))
        both = [(x + y, (s, t)) for (x, s), (y, t) in zip(a[alone:], reversed(b), strict=False)]
        merged = a[:alone] + both + b[: max(0, len(b) - len(both))]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(x - low, t) for x, t in merged]
        heapq.heappush(heap, (-merged[0][0], made, merged))
        made += 1
    out = []
    for _, tree in heap[0][2]:
        found, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                found.append(t)
        out.append(sorted(found))
    return out + [[] for _ in range(k - len(out))]


def balance(sizes: list[int], cap: int, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows of at most cap: lists of (place in sizes, start, length) that hold every part once.

    All windows but those of the last cut lack at most cap * slack. Sizes of 0 get no piece.
    """
    least, done = cap * (1 - slack), []
    parts = [(i, 0, n) for i, n in enumerate(sizes) if n]
    while parts:
        lengths = [n for _, _, n in parts]
        total = sum(lengths)
        if total < cap:
            done += _at_powers(parts, total, cap, least)
            break
        k = -(-total // cap)
        if total < k * least:
            k -= 1  # windows fill up, and what is cut off them needs one more
        found = differencing(lengths, k)
        while total >= (k + 1) * least and max(sum(lengths[i] for i in w) for w in found) > cap:
            k += 1
            found = differencing(lengths, k)
        again = []
        for w in found:
            load = sum(lengths[i] for i in w)
            if load > cap:
                window, rest = _cut([parts[i] for i in w], cap)
                done.append(window)
                again += rest
            elif load >= least:
                done.append([parts[i] for i in w])
            else:
                again += [parts[i] for i in w]
        parts = again
    return done


def _cut(parts: list[tuple[int, int, int]], room: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The first room tokens, longest parts first, and the rest."""
    inside, rest = [], []
    for i, start, n in sorted(parts, key=lambda p: -p[2]):
        if take := min(n, room):
            inside.append((i, start, take))
            room -= take
        if n > take:
            rest.append((i, start + take, n - take))
    return inside, rest


def _at_powers(parts: list[tuple[int, int, int]], total: int, cap: int, least: float) -> list[list[tuple[int, int, int]]]:
    """Less than one window: as it is if nearly full, else windows of falling powers of two."""
    out = []
    while parts and total < least:
        window, parts = _cut(parts, 1 << (total.bit_length() - 1))
        total -= sum(n for _, _, n in window)
        out.append(window)
    return [*out, parts] if parts else out


def _encoded(docs: DataFrame, path: str, end_id: int, cap: int) -> DataFrame:
    """Per row: its ids that fill whole sequences, the rest of them, and numbers that a repeated task gives again.

    row and first count rows and whole sequences within the task, whose own number stands above them.
    """

    def run(batches):
        t = transducer(path)
        kind = "<u2" if max(len(t.bytes_of), end_id + 1) <= 1 << 16 else "<u4"
        row = first = TaskContext.get().partitionId() << PLACE
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j in groups(offs, BATCH_BYTES):
                ids = [np.frombuffer(x + end, "<u4").astype(kind) for x in t.encode_rows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
                n = np.array([len(x) for x in ids])
                cut, ends = n // cap * cap, np.cumsum(n // cap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(j - i)), b.column(0).slice(i, j - i), pa.array(n), pa.array(first + ends - n // cap),
                        pa.array([x[:c].tobytes() for x, c in zip(ids, cut, strict=True)], pa.binary()), pa.array([x[c:].tobytes() for x, c in zip(ids, cut, strict=True)], pa.binary()),
                        pa.array(np.full(j - i, int(kind[-1]), np.int32)),
                    ],
                    names=["row", "doc_id", "n", "first", "whole", "rest", "width"],
                )
                row, first = row + j - i, first + int(ends[-1])

    return docs.mapInArrow(run, "row long, doc_id long, n long, first long, whole binary, rest binary, width int")


class _Rows:
    """Pieces, gathered to batches of bounded size."""

    def __init__(self, limit: int = 8 << 20):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.columns, self.bytes = [[] for _ in NAMES], 0

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)
        self.bytes += len(values[-1])

    def full(self, last: bool = False):
        if self.columns[0] and (last or self.bytes >= self.limit):
            kinds = [pa.int64()] * (len(NAMES) - 1) + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names=NAMES)
            self._clear()


def _wide(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()


def _whole(cap: int):
    """Sequences that one document fills: odd numbers."""

    def run(batches):
        out = _Rows()
        for b in batches:
            for doc, n, first, whole, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in range(0, len(whole), cap * width):
                    out.add(doc, k // width, cap, n, 2 * (first + k // (cap * width)) + 1, 0, _wide(whole[k : k + cap * width], width))
                    yield from out.full()
        yield from out.full(True)

    return run


def _packed(cap: int):
    """Sequences of a bucket's parts: even numbers. Parts are taken in the order of their rows, so a repeated task gives the same."""

    def of(bucket: int, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).sort_by("row")
        doc, n, rest, width = (t.column(c).to_pylist() for c in ("doc_id", "n", "rest", "width"))
        out = _Rows()
        for k, window in enumerate(balance([len(x) // w for x, w in zip(rest, width, strict=True)], cap)):
            at = 0
            for i, start, length in window:
                w = width[i]
                out.add(doc[i], n[i] - len(rest[i]) // w + start, length, n[i], 2 * ((bucket << WINDOW_PLACE) + k), at, _wide(rest[i][start * w : (start + length) * w], w))
                at += length
            yield from out.full()
        yield from out.full(True)

    return of


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, cap: int = 1024, id_col: str = "doc_id", text_col: str = "text", windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, doc_tokens, sequence_id, offset, ids.

    Every text is encoded with a plain byte-level BPE file, end_id follows it, and each id lies in exactly one piece.
    Sequences hold at most cap ids, offsets leave no gap. A sequence lacks at most SLACK of cap or is a power of two
    long. ids are 32-bit little-endian. A null text counts as empty (its end id alone); null ids and repeated rows are
    documents like others; other columns are not read. An empty table gives an empty one.
    """
    if cap < 1 or not 1 <= windows <= 1 << (WINDOW_PLACE - 4):
        raise ValueError("cap is at least 1, windows from 1 to 65,536")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    encoded = scratch.Table(_encoded(rows, tokenizer_path, end_id, cap), "pack-ids").read()
    parts = encoded.filter("length(rest) > 0").select("row", "doc_id", "n", "rest", "width")
    loads = parts.agg(F.sum(F.expr("length(rest) div width")).alias("ids")).first()["ids"] or 0
    buckets = max(1, -(-loads // (cap * windows)))
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    dealt = scratch.dealt(parts.select(bucket.alias("bucket"), "*"), buckets)
    packed = dealt.mapInArrow(scratch.each_bucket(_packed(cap)), PIECES)
    whole = encoded.filter("length(whole) > 0").select("doc_id", "n", "first", "whole", "width").mapInArrow(_whole(cap), PIECES)
    return whole.unionByName(packed)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer_path).withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
