"""A prefix trie of conversations: who shares which first turns, and what a shared prefix saves.

Conversations that are turn for turn alike are one class first, so copies cost one row each and no trie. Classes are
hash-partitioned by the digest of their first turn. A task builds pointer dictionary tries of the classes of one
bucket and sums them up in postorder without recursion. First turns whose subtree holds more rows than LIMIT go
another way: their node is an aggregate, and the rows below it are partitioned again by the next turn, as often as a
subtree is still too large. The totals of those nodes are summed from their children's, deepest first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import scratch, turns

#: Rows of the largest subtree that one task takes, and rows a bucket should hold.
LIMIT = 100_000
#: Bytes of ids that go to the task that hashes them as one row.
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TRIE = f"key binary, parent binary, top boolean, {NODE}"
#: A row of a path: its subtree's key, the subtree's depth, its parent's key and smallest conversation; class; turn.
_PATH = ["key", "base", "parent", "up", "rep", "n", "len", "d", "turn_digest", "words", "ends"]


def classes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation: c and rep, the smallest conversation of equal turns; len."""
    place = F.struct("d", "turn_digest")
    # turns have distinct places, so an xor of hashes of (place, turn) tells sequences apart; 128 bits and the length
    whole = rows.groupBy("c").agg(F.bit_xor(F.xxhash64(place)).alias("s1"), F.bit_xor(F.xxhash64(F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), F.hex("turn_digest"))))).alias("s2"), F.count("*").alias("len"))
    whole = ids.join(whole, "c", "left").select("c", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2"), F.coalesce("len", F.lit(0)).alias("len"))
    found = whole.groupBy("s1", "s2", "len").agg(F.min("c").alias("rep"), F.count("*").alias("n"))
    return whole.join(found, ["s1", "s2", "len"]).select("c", "rep", "n", "len")


def id_hashes(members: DataFrame) -> DataFrame:
    """Per rep: ends, the SHA-256 of its members' decimal ids, ascending and comma-joined.

    A hash is a chain, so one task ends each; it reads chunks of joined ids that the tasks of a range sort made.
    """
    alone = members.filter("n = 1").select("rep", F.sha2(F.col("c").cast("string"), 256).alias("ends"))

    def chunks(batches):
        now, held, size, first = None, [], 0, None
        for b in batches:
            rows = []
            for rep, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (rep != now or size >= CHUNK):
                    rows.append((now, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    first = c
                now = rep
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _batch(rows, [("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        yield _batch([(now, first, ",".join(held))] if held else [], [("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def hashes(batches):
        now, h = None, None
        kinds = [("rep", pa.int64()), ("ends", pa.string())]
        for b in batches:
            rows = []
            for rep, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h is None or rep != now:
                    if h is not None:
                        rows.append((now, h.hexdigest()))
                    now, h = rep, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _batch(rows, kinds)
        yield _batch([(now, h.hexdigest())] if h is not None else [], kinds)

    many = members.filter("n > 1").select("rep", "c").repartitionByRange("rep", "c").sortWithinPartitions("rep", "c").mapInArrow(chunks, "rep long, first long, ids string")
    many = many.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashes, "rep long, ends string")
    return alone.union(many)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


class Trie:
    """Nodes as parallel lists, children as one dictionary a node from a turn's digest to the child."""

    def __init__(self):
        self.kids, self.up, self.depth, self.n, self.conv, self.words, self.ends, self.base = [], [], [], [], [], [], [], []

    def node(self, up: int, depth: int, words: int, base=None) -> int:
        for column, value in ((self.kids, {}), (self.up, up), (self.depth, depth), (self.n, 0), (self.conv, None), (self.words, words), (self.ends, EMPTY), (self.base, base)):
            column.append(value)
        return len(self.kids) - 1

    def postorder(self, root: int) -> list[int]:
        """Children before parents, by a stack: the reverse of an order that takes parents first."""
        out, todo = [], [root]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += self.kids[k].values()
        return out[::-1]


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """All subtrees of one bucket, from their keys' nodes down."""
    t, roots = Trie(), {}
    rows = rows.sort_values(["rep", "d"], kind="stable")
    at = now = None
    for key, base, parent, up, rep, n, length, d, digest, words, ends in zip(*(rows[c] for c in _PATH), strict=True):
        if rep != now:
            now = rep
            if key not in roots:
                roots[key] = t.node(-1, base, words, (key, parent, up))
            at = roots[key]
        else:
            kids = t.kids[at]
            if digest not in kids:
                kids[digest] = t.node(at, d, words)
            at = kids[digest]
        t.n[at] += n
        t.conv[at] = rep if t.conv[at] is None else min(t.conv[at], rep)
        if d == length:
            t.ends[at] = ends
    size = len(t.kids)
    leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for root in roots.values():
        for k in t.postorder(root):
            leaves[k] += not t.kids[k]
            saved[k] += (t.n[k] - 1) * t.words[k]
            if k != root:
                leaves[t.up[k]] += leaves[k]
                saved[t.up[k]] += saved[k]
    top = [b is not None for b in t.base]
    above = [b[2] if b else t.conv[u] for b, u in zip(t.base, t.up, strict=True)]
    columns = {
        "key": [b[0] if b else None for b in t.base], "parent": [b[1] if b else None for b in t.base], "top": top, "conv_id": t.conv, "depth": t.depth, "parent_conv_id": above,
        "n_convs": t.n, "n_children": [len(k) for k in t.kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": t.ends,
    }
    return pd.DataFrame(columns)


def _grown(paths: DataFrame, rows: int) -> DataFrame:
    """Trie nodes of rows whose subtrees are all small, in as many buckets as their number asks for."""
    buckets = max(1, min(scratch.width(paths.sparkSession), -(-rows // 1000)), -(-rows // LIMIT))
    return paths.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: _forest(pdf), _TRIE)


def build(rows: DataFrame, ids: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of conversations given as turns (c, d from 1 without gaps, turn_digest, words).

    ids holds every conversation's c once, those without a turn too. Columns: conv_id (the smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversation, no
    node. Turns and whole sequences are told apart by 128-bit digests.
    """
    with scratch.Work() as work:
        rows = work.table(rows, "trie-turns")
        members = work.table(classes(rows, ids), "trie-classes")
        own = members.filter("c = rep").join(id_hashes(members), "rep", "left").select("rep", "n", "len", "ends")
        own = work.table(own, "trie-own")
        whole = own.agg(F.min("rep"), F.sum("n"), F.max(F.when(F.col("len") == 0, F.col("ends")))).first()
        root_conv, total, root_ends = whole
        if root_conv is None:
            return scratch.Table(rows.sparkSession.createDataFrame([], NODE), "trie").read()
        first = F.first("turn_digest").over(Window.partitionBy("rep").orderBy("d"))
        path = rows.withColumnRenamed("c", "rep").join(own, "rep").select(
            first.alias("key"), F.lit(1).cast("long").alias("base"), F.lit(b"").alias("parent"), F.lit(root_conv).cast("long").alias("up"),
            "rep", "n", "len", F.col("d").cast("long").alias("d"), "turn_digest", "words", F.when(F.col("d") == F.col("len"), F.col("ends")).alias("ends"),
        )
        todo = work.table(path, "trie-paths")
        grown, large, depth = [], [], 1
        while True:
            sizes = work.table(todo.groupBy("key").agg(F.count("*").alias("rows")).groupBy((F.col("rows") > limit).alias("large")).agg(F.sum("rows").alias("rows"), F.collect_list(F.when(F.col("rows") > limit, F.col("key"))).alias("keys")), "trie-sizes")
            over = sizes.filter("large").select(F.explode("keys").alias("key"))
            counts = {r["large"]: r["rows"] for r in sizes.select("large", "rows").collect()}
            if counts.get(False):
                grown.append(work.table(_grown(todo.join(over, "key", "left_anti") if counts.get(True) else todo, counts[False]), "trie-nodes"))
            if not counts.get(True):
                break
            big = todo.join(over, "key", "left_semi")
            here = big.filter(F.col("d") == depth)
            node = here.groupBy("key", "parent", "up").agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.max("ends").alias("ends"))
            large.append(work.table(node, "trie-large"))
            following = F.first("turn_digest").over(Window.partitionBy("rep").orderBy("d"))
            below = big.filter(F.col("d") > depth).withColumn("next", following).withColumnRenamed("key", "above").drop("parent", "up", "base")
            below = below.join(large[-1].select(F.col("key").alias("above"), F.col("conv_id").alias("up")), "above")
            below = below.withColumn("key", F.unhex(F.md5(F.concat("above", "next")))).withColumn("base", F.lit(depth + 1).cast("long")).withColumnRenamed("above", "parent")
            todo = work.table(below.select(*_PATH), "trie-paths")
            depth += 1
        empty = rows.sparkSession.createDataFrame([], _TRIE)
        nodes = empty
        for g in grown:
            nodes = nodes.unionByName(g)
        tops = nodes.filter("top").select("parent", "n_leaves", "saved_tokens", "depth")
        out = nodes.select([x.split()[0] for x in NODE.split(", ")])
        for k in range(len(large), 0, -1):
            sums = tops.filter(F.col("depth") == k + 1).groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("parent", "key")
            node = large[k - 1].join(sums, "key", "left").select(
                "parent", "conv_id", F.lit(k).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"),
                (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
            )
            node = work.table(node, "trie-large")
            tops = tops.unionByName(node.select("parent", "n_leaves", "saved_tokens", "depth"))
            out = out.unionByName(node.drop("parent"))
        sums = tops.filter("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
        root = sums.select(
            F.lit(root_conv).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"),
            "n_children", "n_leaves", "saved_tokens", F.lit(root_ends or EMPTY).alias("ends_sha256"),
        )
        return scratch.Table(out.unionByName(root), "trie").read()


def shared(conversations: DataFrame, block: int = 20, kinds: int = 4, limit: int = LIMIT) -> DataFrame:
    """The trie of the conversations as turns.rebuilt() makes them, from rows (conv_id, turn, role, text).

    Turns are ordered by number, null first, then by role and text; null roles and texts are empty; repeated rows are
    turns of their own. Rows without conv_id are left out; other columns are not read. An empty table gives no node.
    """
    with scratch.Work() as work:
        lean = work.table(turns.ordered(conversations), "turns")
        rows, ids = turns.rebuilt(lean, block, kinds)
        return build(rows, ids, limit)
