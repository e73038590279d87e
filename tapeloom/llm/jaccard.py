"""Exact Jaccard join of word-shingle sets, using what is known of one set for those like it.

Sets link when their similarity is 0.8 or more. Equal sets are one set. Shingles are ordered rare to frequent, and
linked sets share one of the first fifth of theirs (the prefix), so only prefixes are indexed. Two kinds of relation
save work on the index lists:

* Inside a list, blocks are skipped by size and position: sorted by size, a run of sets ends where no size can reach
  0.8, and a place too far back in both sets leaves too little to share.
* Sets like one already answered take over its answers. First each list's sets are compared with one leader only,
  which gives clusters and each member's difference from its leader. Then clusters, not sets, are paired; the overlap
  of two leaders, plus what their members differ by, bounds every overlap between the clusters. Only pairs of clusters
  that neither link by their leaders nor are excluded by that bound are opened, and their sets compared.
* Clusters that a chain of links has joined are not paired again. They are paired in rounds: at first each with a few
  neighbours on a list, then with more, and in the last round with all that are still apart, so a large group of near
  copies is joined before its pairs, whose number grows with its square, would be written.

Overlaps are first bounded by parity sketches, a thirtieth of the sets; only pairs that these leave open move whole sets.

Sets and shingles are told apart by 64-bit hashes (for 10^10 sets, about three pairs in all would be mistaken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import scratch
from tapeloom.llm.bytesets import MIX, groups, mix, run_hashes, text_bytes, trim, word_hashes
from tapeloom.llm.components import components

WORDS = 5
#: Shingles in this many sets of a batch count as frequent there; so many of the most frequent are ordered by count.
#: The order of the rest is by hash: it decides how fast the join is, not what it finds.
FREQUENT, ORDERED = 4, 1 << 19
#: One shingle of so many serves the first round, which need not be complete.
SAMPLED = 16
#: Bits of the filter that says which sets may have a partner: eight a row, within these powers of two. A full filter
#: costs space, not links; the largest is a broadcast of 128 MB.
FILTER_BITS = (20, 30)
#: Index entries that a task holds before it deals them out.
HELD = 1 << 19
#: Neighbours on a list that a cluster is paired with in each round before the last, which has no such bound.
NEIGHBOURS = (2, 16)
#: Bits of the smallest sketch of a set.
SKETCH = 1024
#: The largest set whose sketch, folded to the smallest, still tells sets apart on the index lists.
FOLDED = 1500
U = np.uint64


def needed(n):
    """Least overlap of a set of n with any set it links with."""
    return (4 * n + 4) // 5


def linked(overlap, a, b):
    return 100 * overlap >= 80 * (a + b - overlap)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending and end to end; the rows' offsets; a hash of each set (0: empty)."""
    words, at = word_hashes(data, offs)
    runs, _, out = run_hashes(words, at, WORDS)
    count, sets = np.diff(at), []
    for k, n in enumerate(count.tolist()):
        if n >= WORDS:
            x = np.sort(runs[out[k] : out[k + 1]])
            sets.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            w = words[at[k] : at[k + 1]]
            sets.append(mix((w * np.array(MIX[:n])).sum(keepdims=True) + MIX[50 + n]))
        else:
            sets.append(runs[:0])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ MIX[60]), dtype=np.uint64)])
    size = np.diff(ends).astype(np.uint64)
    return flat, ends, np.where(size > 0, mix(total[ends[1:]] - total[ends[:-1]] + size * MIX[61]) | U(1), U(0))


def _batches(batches):
    """Rows, sets, offsets, set hashes of each group of rows, whose last column is the text."""
    for b in batches:
        data, offs = text_bytes(b.column(b.num_columns - 1))
        for i, j in groups(offs):
            yield b.slice(i, j - i), *shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _once(flat: np.ndarray, ends: np.ndarray, keys: np.ndarray, of: set) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sets that are not empty, each set once and none in `of`, which takes them up."""
    _, first = np.unique(keys, return_index=True)
    first = np.sort(first[keys[first] != 0])
    if of:
        first = first[[k not in of for k in keys[first].tolist()]]
    return first, np.diff(ends)[first]


def _flat(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[np.arange(size.sum()) + np.repeat(ends[rows] - np.cumsum(size) + size, size)]


def _described(width: int):
    """Of each row (doc_id, row_key, text) its set's size and hash; of each group of rows its frequent shingles and their counts, dealt by hash."""
    names = ["doc_id", "row_key", "n", "key", "bucket", "counts"]

    def run(batches):
        for b, flat, ends, keys in _batches(batches):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends)), pa.array(keys.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            rows, size = _once(flat, ends, keys, set())
            h, c = np.unique(_flat(flat, ends, rows, size), return_counts=True)
            h, c = h[c >= FREQUENT], c[c >= FREQUENT].astype(np.uint64)
            parts = list(_parts((h % U(width)).astype(np.int32)))
            if parts:
                counts = [np.stack([h[on], c[on]]).tobytes() for _, on in parts]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), pa.int64()) for _ in range(4)), pa.array([k for k, _ in parts], pa.int32()), pa.array(counts, pa.binary())], names=names)

    return run


def _summed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate([np.frombuffer(x, "<u8").reshape(2, -1) for x in parts], 1)
    h, back = np.unique(h, return_inverse=True)
    return h, np.bincount(back, c.astype(float)).astype(np.uint64)


def _parts(bucket: np.ndarray):
    """Each bucket that occurs, and the places where it does."""
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    cut = np.append(first, len(order))
    for k, x in enumerate(which.tolist()):
        yield x, order[cut[k] : cut[k + 1]]


def _most_frequent(keep: int):
    """The most frequent shingles of a bucket; blocks are added up as they come."""

    def of(_, batches):
        held, size = [], 0
        for x in (x for b in batches for x in b.column(1).to_pylist()):
            held.append(x)
            size += len(x)
            if size > scratch.BUCKET_BYTES:
                held = [np.stack(_summed(held)).tobytes()]
                size = 0
        h, c = _summed(held)
        top = np.lexsort((h, -c.astype(np.int64)))[:keep]
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([h[top], c[top]]).tobytes()], pa.binary())], names=["top"])

    return scratch.each_bucket(of)


class _Order:
    """Rare before frequent: counts of the frequent shingles, all others 0."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.counts = hashes[at], counts[at]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hashes & U((1 << 22) - 1)] = True

    def __call__(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat), np.uint32)
        on = np.flatnonzero(self.maybe[flat & U((1 << 22) - 1)])
        if len(on) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, flat[on]), len(self.hashes) - 1)
            hit = self.hashes[at] == flat[on]
            out[on[hit]] = self.counts[at[hit]]
        return out


_ENTRY = np.dtype([("key", "<u8"), ("token", "<u4"), ("size", "<u4"), ("pos", "<u4")])


def _prefixes(buckets: int, shared):
    """Index entries of each set's prefix, dealt by shingle: bucket, block."""

    def packed(held: list[tuple]):
        out, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        parts = list(_parts(bucket))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([out[on].tobytes() for _, on in parts], pa.binary())], names=["bucket", "rows"])

    def run(batches):
        order, sent, held, count = _Order(*shared.value), set(), [], 0
        for _, flat, ends, keys in _batches(batches):
            rows, size = _once(flat, ends, keys, sent)
            if not len(rows):
                continue
            if len(sent) < 1 << 17:
                sent.update(keys[rows].tolist())
            h = _flat(flat, ends, rows, size)
            row = np.repeat(np.arange(len(rows)), size)
            often = order(h)
            if often.any():
                h = h[np.lexsort((h, often, row))]
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            on = pos < np.repeat(size - needed(size) + 1, size)
            h, row, pos = h[on], row[on], pos[on]
            out = np.empty(len(h), _ENTRY)
            out["key"], out["token"], out["size"], out["pos"] = keys[rows][row], h >> U(32), size[row], pos
            held.append((out, ((h & U(0xFFFFFFFF)) % U(buckets)).astype(np.int32)))
            count += len(out)
            if count >= HELD:
                yield from packed(held)
                held, count = [], 0
        if held:
            yield from packed(held)

    return run


_PLACE = np.dtype([("key", "<u8"), ("size", "<u4"), ("list", "<u4"), ("token", "<u4"), ("pos", "<u4")])


def _live(buckets: int):
    """Of a bucket, the entries that have a partner, dealt by set (bucket, rows); and leader pairs (a, b)."""

    def of(bucket, batches):
        x = np.frombuffer(b"".join([r for b in batches for r in b.column(1).to_pylist()]), _ENTRY)
        x = x[np.lexsort((x["key"], x["size"], x["token"]))]
        x = x[np.append(True, (x["token"][1:] != x["token"][:-1]) | (x["key"][1:] != x["key"][:-1]))] if len(x) else x
        near = (x["token"][1:] == x["token"][:-1]) & (5 * x["size"][:-1].astype(np.int64) >= 4 * x["size"][1:])
        on = np.zeros(len(x), bool)
        on[1:] |= near
        on[:-1] |= near
        x = x[on]
        if not len(x):
            return
        s = x[x["token"] % SAMPLED == 0]
        if len(s):
            s = s[np.lexsort((s["key"], s["token"]))]
            fresh = np.append(True, s["token"][1:] != s["token"][:-1])
            lead = s[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            a, b = lead["size"].astype(np.int64), s["size"].astype(np.int64)
            ok = (lead["key"] != s["key"]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
            pairs = np.unique(np.stack([lead["key"][ok], s["key"][ok]], 1), axis=0)
            n = len(pairs)
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *(pa.array(pairs[:, k].astype(np.int64)) for k in range(2))], names=["bucket", "rows", "a", "b"])
        out = np.empty(len(x), _PLACE)
        for k in ("key", "size", "token", "pos"):
            out[k] = x[k]
        out["list"] = bucket
        parts = list(_parts((out["key"] % U(buckets)).astype(np.int32)))
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([out[at].tobytes() for _, at in parts], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["bucket", "rows", "a", "b"])
        del x, out
        trim()

    return scratch.each_bucket(of)


@scratch.each_bucket
def _by_set(_, batches):
    """One row per set: key, size, its places on the index lists (list, token, position)."""
    x = np.frombuffer(b"".join([r for b in batches for r in b.column(1).to_pylist()]), _PLACE)
    x = x[np.lexsort((x["list"], x["key"]))]
    which, first = np.unique(x["key"], return_index=True)
    cut = np.append(first, len(x))
    tail = np.stack([x["list"], x["token"], x["pos"]], 1)
    for lo in range(0, len(which), 10_000):
        part = range(lo, min(lo + 10_000, len(which)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which[part].astype(np.int64)), pa.array(x["size"][first[part]].astype(np.int64)), pa.array([tail[cut[k] : cut[k + 1]].tobytes() for k in part], pa.binary())],
            names=["key", "size", "places"],
        )
    trim()


def _filter(keys: DataFrame, power: int) -> np.ndarray:
    """Bit set of the keys (packed, lowest bit first) with 2^power places."""
    place = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(1 << power, bool)
    for r in rows:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        # buckets count from 1, and bucket 1 begins at 1; bucket 0 holds 0 and below
        out[(at + ((r["b"] - 1) * 32768 + 1)) & ((1 << power) - 1)] = True
    return np.packbits(out, bitorder="little")


def _passing(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & U(8 * len(packed) - 1)).astype(np.int64)
    return (packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def parity_bits(flat: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each place, two places a shingle: two sets differ in at least as many shingles as places."""
    m = max(SKETCH, 1 << (2 * len(flat) - 1).bit_length())
    return np.packbits((np.bincount((flat & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(p: bytes, q: bytes) -> int:
    """Places in which two sketches differ; the longer is folded to the shorter."""
    x, y = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(p: bytes | None) -> bytes:
    """A sketch folded to SKETCH bits; zeros where there is none."""
    if p is None:
        return bytes(SKETCH // 8)
    x = np.frombuffer(p, np.uint8)
    while len(x) > SKETCH // 8:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _folded(batches):
    for x in batches:
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([folded(p) if n <= FOLDED else None for n, p in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)], pa.binary())], names=["key", "n", "sketch"])


def _chosen(shared, of):
    """key and of(shingles) of the sets that pass a filter, each once a task."""

    def run(batches):
        sent: set = set()
        for _, flat, ends, keys in _batches(batches):
            rows, _ = _once(flat, ends, keys, sent)
            rows = rows[_passing(shared.value, keys[rows])]
            if len(sent) < 1 << 17:
                sent.update(keys[rows].tolist())
            if len(rows):
                got = [flat[ends[k] : ends[k + 1]] for k in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows].astype(np.int64)), pa.array([len(x) for x in got], pa.int64()), pa.array([of(x) for x in got], pa.binary())], names=["key", "n", "value"])

    return run


def _exact(batches):
    """a, b, overlap, na, nb of rows a, b and the two sets."""
    for x in batches:
        out = []
        for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
            small, big = sorted((np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")), key=len)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            out.append((int((big[at] == small).sum()), len(p) // 8, len(q) // 8))
        cols = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["a", "b", "overlap", "na", "nb"])


def _bounded(batches):
    """a, b, overlap (the most there can be), na, nb, open (whether that could link them) of rows a, b, sizes and sketches."""
    for x in batches:
        na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
        differ = np.array([apart(p, q) for p, q in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)], np.int64)
        most = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(most), x.column(2), x.column(3), pa.array(linked(most, na, nb))], names=["a", "b", "overlap", "na", "nb", "open"])


class _Compare:
    """Overlaps of pairs of sets: sketches first, then the sets of the pairs that those leave open, from the texts again."""

    def __init__(self, rows: DataFrame, live: DataFrame, power: int, work: scratch.Work):
        self.rows, self.sc, self.power, self.work = rows, rows.sparkSession.sparkContext, power, work
        self.sketches = self._table(live, parity_bits, "sketches")

    def _table(self, keys: DataFrame, of, name: str) -> DataFrame:
        """key, n, value of the sets that keys hold (and a few more), each once."""
        shared = self.sc.broadcast(_filter(keys, self.power))
        return self.work.table(self.rows.mapInArrow(_chosen(shared, of), "key long, n long, value binary").dropDuplicates(["key"]), name)

    def exact(self, pairs: DataFrame) -> DataFrame:
        """a, b, overlap, na, nb of pairs (a table)."""
        sets = self._table(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))), lambda x: x.tobytes(), "shingles")
        both = pairs.select("a", "b").join(sets.select(F.col("key").alias("b"), F.col("value").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("value").alias("sa")), "a")
        return self.work.table(both.select("a", "b", "sa", "sb").mapInArrow(_exact, "a long, b long, overlap long, na long, nb long"), "overlaps")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """a, b, overlap, na, nb: the overlap itself, or the most it can be where that is too little to link."""
        s = self.sketches
        both = pairs.select("a", "b").join(s.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("value").alias("vb")), "b").join(s.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("value").alias("va")), "a")
        seen = self.work.table(both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bounded, "a long, b long, overlap long, na long, nb long, open boolean"), "bounds")
        return seen.filter("not open").drop("open").unionByName(self.exact(seen.filter("open").select("a", "b")))


_SET = np.dtype([("key", "<i8"), ("lead", "<i8"), ("part", "<i8"), ("size", "<u4"), ("d", "<u4"), ("places", "<u4")])
_UNIT = np.dtype([("id", "<i8"), ("n", "<u4"), ("known", "<u4"), ("bits", f"V{SKETCH // 8}")])


def _lists(opened: bool):
    """One row per set (key, size, places, lead, part, d, n, sketch) to blocks of the index lists: bucket, sets, places, units.

    A unit is a cluster, named by its leader, or, if opened, a set; n and sketch are the unit's. part names what links
    have joined so far. Each task sends a list a unit's sketch once a block.
    """

    def run(batches):
        for b in batches:
            _, offs = text_bytes(b.column(2))
            for i, j in groups(offs, 4 << 20):
                key, size, places, lead, joined, d, n, sketch = (c.slice(i, j - i).to_pylist() for c in b.columns)
                sets = np.zeros(j - i, _SET)
                sets["key"], sets["lead"], sets["part"], sets["size"], sets["d"] = key, lead, joined, size, d
                units = np.zeros(j - i, _UNIT)
                units["id"], units["n"], units["known"] = key if opened else lead, [x or 0 for x in n], [x is not None for x in sketch]
                units["bits"] = np.frombuffer(b"".join([folded(x) for x in sketch]), _UNIT["bits"])
                count = np.array([len(x) // 12 for x in places])
                row = np.repeat(np.arange(j - i), count)
                lists, token, pos = np.frombuffer(b"".join(places), "<u4").reshape(-1, 3).T
                out = [[], [], [], []]
                for k, on in _parts(lists.astype(np.int32)):
                    own, first = np.unique(row[on], return_index=True)  # places ascend by row within a list
                    part = sets[own]
                    part["places"] = np.diff(np.append(first, len(on)))
                    unit = units[own]
                    unit = unit[np.unique(unit["id"], return_index=True)[1]]
                    for at, x in enumerate((k, part.tobytes(), np.stack([token[on], pos[on]], 1).tobytes(), unit.tobytes())):
                        out[at].append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "sets", "places", "units"])

    return run


_LISTS = "bucket int, sets binary, places binary, units binary"


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of set hashes."""
    return mix(mix(a.astype(np.uint64)) * MIX[62] + b.astype(np.uint64))


def _pair_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_keys(b.column(0).to_numpy(), b.column(1).to_numpy()).astype(np.int64))], names=["key"])


def _cluster_pairs(asked=None, neighbours: int | None = None):
    """Pairs of clusters (of sets, if asked is given) that an index list brings together, no links have joined so far, and neither sizes, positions nor sketches exclude.

    Gives a, b, slack, least, la, lb, more: leaders (or sets), the most that members differ by, the least overlap that
    could link them, the leaders, and whether one has had its neighbours, so that pairs may be left. asked is a filter
    of pairs of leaders: only sets of such clusters are paired. neighbours is the most later partners of a cluster on a
    list (None: all).
    """
    opened = asked is not None

    def of(_, batches):
        sets, places, units = (b"".join([x for b in batches for x in b.column(k).to_pylist()]) for k in (1, 2, 3))
        sets, units = np.frombuffer(sets, _SET), np.frombuffer(units, _UNIT)
        units = units[np.unique(units["id"], return_index=True)[1]]
        size, lead, joined = sets["size"].astype(np.int64), sets["lead"], sets["part"]
        d = np.zeros(len(sets), np.int64) if opened else sets["d"].astype(np.int64)
        row = np.repeat(np.arange(len(sets)), sets["places"])
        token, pos = np.frombuffer(places, "<u4").reshape(-1, 2).astype(np.int64).T
        count, known = units["n"].astype(np.int64), units["known"] > 0
        bits = np.frombuffer(units["bits"].tobytes(), np.uint64).reshape(len(units), -1)
        unit = (sets["key"] if opened else lead)[row]
        order = np.lexsort((unit, token))
        token, unit, row, pos = token[order], unit[order], row[order], pos[order]
        fresh = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])))
        low, high = np.minimum.reduceat(size[row], fresh), np.maximum.reduceat(size[row], fresh)
        rest, most = np.maximum.reduceat(size[row] - pos, fresh), np.maximum.reduceat(d[row], fresh)
        token, unit, owner, part = token[fresh], unit[fresh], lead[row[fresh]], joined[row[fresh]]
        order = np.lexsort((low, token))
        token, unit, owner, part, low, high, rest, most = (v[order] for v in (token, unit, owner, part, low, high, rest, most))
        at, step, found = np.arange(len(token)), 1, []
        had = np.zeros(len(token), np.int64)
        place = np.searchsorted(units["id"], unit)

        def may_link(i: np.ndarray, j: np.ndarray, slack: np.ndarray, least: np.ndarray) -> np.ndarray:
            """Whether the sketches leave a link of the two, or of members that differ by slack, possible."""
            out = np.ones(len(i), bool)
            for lo in range(0, len(i), 8192):
                p, q = place[i[lo : lo + 8192]], place[j[lo : lo + 8192]]
                top = np.minimum((count[p] + count[q] - np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)) // 2, np.minimum(count[p], count[q]))
                more = slack[lo : lo + 8192]
                out[lo : lo + 8192] = ~(known[p] & known[q]) | linked(top, count[p], count[q]) | (top + more >= least[lo : lo + 8192])
            return out

        # a later entry of a list has a larger least size: once it is out of reach, so is the rest of the list
        while True:
            at = at[at + step < len(token)]
            to = at + step
            reach = (token[to] == token[at]) & (4 * low[to] <= 5 * high[at])
            at, to = at[reach], to[reach]
            if not len(at):
                break
            least = (4 * (low[at] + low[to]) + 8) // 9
            ok = (part[at] != part[to]) & (np.minimum(rest[at], rest[to]) >= least)
            i, j, least = at[ok], to[ok], least[ok]
            if opened and len(i):
                keep = _passing(asked.value, pair_keys(np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j])))
                i, j, least = i[keep], j[keep], least[keep]
            if len(i):
                keep = may_link(i, j, most[i] + most[j], least)
                i, j, least = i[keep], j[keep], least[keep]
            if len(i):
                had[i] += 1
                full = had[i] == neighbours if neighbours else np.zeros(len(i), bool)
                swap = unit[i] > unit[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found.append(np.stack([unit[i], unit[j], most[i] + most[j], least, np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j]), full], 1))
            if neighbours:
                at = at[had[at] < neighbours]
            if len(found) > 64:
                found = [_pairs(found)]
            step += 1
        if found:
            out = _pairs(found)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(out[:, k])) for k in range(6)), pa.array(out[:, 6] > 0)], names=["a", "b", "slack", "least", "la", "lb", "more"])
        trim()

    return scratch.each_bucket(of)


_PAIRS = "a long, b long, slack long, least long, la long, lb long, more boolean"


def _pairs(found: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    first = np.flatnonzero(np.append(True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])))
    return np.stack([x[first, 0], x[first, 1], np.maximum.reduceat(x[:, 2], first), np.minimum.reduceat(x[:, 3], first), x[first, 4], x[first, 5], np.maximum.reduceat(x[:, 6], first)], 1)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), group_key, row_key.

    Words are lower-cased in A-Z; a text of fewer than five words is one shingle. Null, empty and word-less texts have
    no shingles and link with nothing; null ids stay, with a null component, and link nothing. Repeated rows stay and
    count as equal sets. Other columns are not read. An empty table gives an empty one. group_key names the group of
    linked sets (null: no shingles), row_key is a hash of the text (xxhash64, null for null): where ids repeat, these
    tell rows apart that component_id cannot.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = rows.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("row_key"), "text")
    width = scratch.width(spark)
    known = scratch.Table(described.mapInArrow(_described(width), "doc_id long, row_key long, n long, key long, bucket int, counts binary"), "shingle-sets").read()
    with scratch.Work() as work:
        groups_of = scratch.Table(_groups(rows, known, work, sc), "shingle-groups").read()
    sets_of = known.filter("counts is null")
    named = sets_of.filter("n > 0").join(groups_of, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "group_key", "row_key")
    none = F.lit(None).cast("long").alias("group_key")
    return named.union(sets_of.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none, "row_key"))


def _groups(rows: DataFrame, known: DataFrame, work: scratch.Work, sc) -> DataFrame:
    """key (a set), group_key, component_id (null: no row of the group has an id), from rows (doc_id, text) and their sets."""
    spark = rows.sparkSession
    sums, width = known.agg(F.sum("n").alias("n"), F.count("n").alias("rows")).first(), scratch.width(spark)
    tops = scratch.dealt(known.filter("counts is not null").select("bucket", "counts"), width).mapInArrow(_most_frequent(max(1, ORDERED // width)), "top binary").collect()
    top = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(bytes(r["top"]), "<u8").reshape(2, -1) for r in tops)], 1)
    buckets = scratch.bucket_count(spark, _ENTRY.itemsize * ((sums["n"] or 0) // 5 + sums["rows"]))
    index = rows.mapInArrow(_prefixes(buckets, sc.broadcast((top[0], top[1].astype(np.uint32)))), "bucket int, rows binary")
    found = work.table(scratch.dealt(index, buckets).mapInArrow(_live(buckets), "bucket int, rows binary, a long, b long"), "shingle-index")
    live = work.table(scratch.dealt(found.filter("bucket is not null").select("bucket", "rows"), buckets).mapInArrow(_by_set, "key long, size long, places binary"), "sets-by-place")
    power = min(max(FILTER_BITS[0], 3 + sums["rows"].bit_length()), FILTER_BITS[1])
    compare = _Compare(rows, live.select("key"), power, work)

    # first round: members against leaders; a leader is smaller (unsigned) than its members
    first = found.filter("bucket is null").select("a", "b").distinct()
    is_link = F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * 80
    near = work.table(compare(work.table(first, "leader-pairs")).filter(is_link), "near")
    unsigned = F.col("a").bitwiseXOR(F.lit(-(1 << 63)))
    led = near.groupBy(F.col("b").alias("key")).agg(F.min(F.struct(unsigned.alias("o"), F.col("a").alias("lead"), (F.col("nb") - F.col("overlap")).alias("d"))).alias("x")).select("key", "x.lead", "x.d")
    led = work.table(led, "leaders")
    for _ in range(2):  # the leader's leader, and his: what members differ by adds up to no less than the difference
        up = led.select(F.col("key").alias("lead"), F.col("lead").alias("above"), F.col("d").alias("more"))
        led = led.join(up, "lead", "left").select("key", F.coalesce("above", "lead").alias("lead"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
    led = work.table(led, "clusters")
    like = led.join(led.select(F.col("key").alias("lead")), "lead", "left_anti").select("key", "lead", "d")  # longer chains: a cluster of one's own

    # then clusters against clusters, by their leaders; the joins carry one row per set
    placed = work.table(live.join(like, "key", "left").select("key", "size", "places", F.coalesce("lead", "key").alias("lead"), F.coalesce("d", F.lit(0)).alias("d")), "placed")
    short = work.table(compare.sketches.select("key", "n", "value").mapInArrow(_folded, "key long, n long, sketch binary"), "short-sketches")
    columns = ["key", "size", "places", "lead", "part", "d", "n", "sketch"]
    links = near.select("a", "b")
    rounds = [*NEIGHBOURS, None]
    while rounds:
        neighbours = rounds.pop(0)
        joined = work.table(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work), "joined")
        parts = joined.select(F.col("node").alias("lead"), F.col("component_id").alias("part"))
        by_lead = placed.join(parts, "lead", "left").withColumn("part", F.coalesce("part", "lead")).join(short.withColumnRenamed("key", "lead"), "lead", "left").select(columns).mapInArrow(_lists(False), _LISTS)
        between = scratch.dealt(by_lead, buckets).mapInArrow(_cluster_pairs(neighbours=neighbours), _PAIRS)
        between = between.groupBy("a", "b").agg(F.max("slack").alias("slack"), F.min("least").alias("least"), F.max("more").alias("more"))
        asked = work.table(between, "cluster-pairs")
        answers = work.table(compare(asked).join(asked, ["a", "b"]), "leader-overlaps")
        links = links.union(answers.filter(is_link).select("a", "b"))
        seen = answers.agg(F.count("a").alias("n"), F.count(F.when(is_link, 1)).alias("links"), F.max("more").alias("more")).first()
        if not seen["more"]:  # nothing was left out
            break
        if 2 * seen["links"] < seen["n"]:  # what is alike links seldom: another round before the last would ask in vain
            rounds = [None]

    # at last the sets of clusters that the leaders leave open and no chain of links has joined
    open_ = answers.filter(~is_link & (F.col("overlap") + F.col("slack") >= F.col("least"))).select("a", "b")
    for neighbours in (NEIGHBOURS[0], None):
        joined = work.table(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work), "joined")
        ends_of = [joined.select(F.col("node").alias(k), F.col("component_id").alias(f"c{k}")) for k in "ab"]
        open_ = open_.join(ends_of[0], "a", "left").join(ends_of[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        open_ = work.table(open_, "open-clusters")
        if open_.isEmpty():
            break
        pairs = sc.broadcast(_filter(open_.select("a", "b").mapInArrow(_pair_keys, "key long"), power))
        ends = open_.select(F.col("a").alias("lead")).union(open_.select(F.col("b").alias("lead"))).distinct()
        parts = joined.select(F.col("node").alias("lead"), F.col("component_id").alias("part"))
        reopened = placed.join(ends, "lead", "left_semi").join(parts, "lead", "left").withColumn("part", F.coalesce("part", "lead")).join(short, "key", "left").select(columns).mapInArrow(_lists(True), _LISTS)
        single = scratch.dealt(reopened, buckets).mapInArrow(_cluster_pairs(pairs, neighbours), _PAIRS)
        single = single.join(open_.select(F.col("a").alias("la"), F.col("b").alias("lb")), ["la", "lb"], "left_semi").select("a", "b").distinct()
        links = links.union(compare(work.table(single, "opened")).filter(is_link).select("a", "b"))

    # one row per set until the end: a set's smallest id, its group's, and back
    sets = work.table(known.filter("counts is null and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "sets")
    clusters = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work).select(F.col("node").alias("key"), F.col("component_id").alias("cluster"))
    grouped = work.table(sets.join(clusters, "key", "left").select("key", "doc_id", F.coalesce("cluster", "key").alias("group_key")), "grouped")
    smallest = work.table(grouped.groupBy("group_key").agg(F.min("doc_id").alias("component_id")), "smallest-ids")
    return grouped.join(smallest, "group_key").select("key", "group_key", "component_id")
