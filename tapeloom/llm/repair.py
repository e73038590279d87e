"""Repair of damaged conversations by an error-correcting parse of their roles.

Ordinary conversations are grouped, sorted and parsed one at a time as they stream through a task. A conversation of
more than GIANT bytes is range-sorted over many tasks. Each reads its block from every symbol of the grammar that may
stand before it; the blocks' results join in order to one audit. Then the turns stream past that audit once more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import earley, scratch
from tapeloom.llm.earley import ACCEPTED, SYMBOLS, TRUNCATED, Chart

#: Bytes of a conversation that one task holds at a time.
GIANT = 16 << 20
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
LEGAL = ("su", "ua", "au")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, gone: each row damaged by crc32('conv_id:turn') mod 20.

    0 drops it (it stays as a row that only names its conversation), 1 empties its text, 2 takes its . ! ? away,
    3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *said).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "again")


class _Faults:
    """Counts of one conversation's rows in order, and what the parse has to know of each."""

    def __init__(self):
        self.n = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.turn = None
        self.turns = 0
        self.initial, self.first, self.last = None, None, None

    def row(self, turn, role: str, text: str, seen: bool) -> tuple[str, bool, int]:
        bare = text.rstrip(WHITE)
        cut = bool(bare) and not seen and bare[-1] not in ".!?"
        self.n["blank"] += not bare
        self.n["duplicate"] += bool(bare) and seen
        self.n["truncated"] += cut
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            self.turn = turn
        now = earley.initial(role)
        if self.last is None:
            self.first = now
        elif self.last + now not in LEGAL:
            self.n["illegal"] += 1
        self.last = now
        return now, not bare or seen, TRUNCATED * cut

    def report(self, cost: int) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.n[c] if c not in ("gaps", "cost") else (gaps if c == "gaps" else cost) for c in COUNTS]


def _best(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(ends[x] for x in ACCEPTED if x in ends)


def _lines(turns) -> Iterator[bytes]:
    for k, (_, role, text) in enumerate(turns):
        yield ("\n" * bool(k) + f"{role}:{text}").encode()


def hashed(turns) -> str:
    h = hashlib.sha256()
    for line in _lines(turns):
        h.update(line)
    return h.hexdigest()


def _repaired(rows: list[tuple]) -> tuple[_Faults, int, str]:
    """Counts, cost and audit of (turn, role, text) in order."""
    faults, chart, seen = _Faults(), Chart(), set()
    for turn, role, text in rows:
        known = (role, text) in seen
        seen.add((role, text))
        chart.turn(*faults.row(turn, role, text, known))
    cost, audit = _best(chart.ends(ACCEPTED))
    return faults, cost, audit


class _Out:
    """Rows gathered to record batches."""

    def __init__(self, schema: str, limit: int = 8 << 20):
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        self.names, self.kinds = zip(*((n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))), strict=True)
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.rows, self.bytes = [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size + 100

    def full(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.bytes > self.limit):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), self.kinds, strict=True)], names=self.names)
            self._clear()


def _conversations(batches) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of sorted batches; rows that are gone only name their conversation."""
    now, rows, begun = None, [], False
    for b in batches:
        for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not begun or conv != now:
                if begun:
                    yield now, rows
                now, rows, begun = conv, [], True
            if not gone:
                rows.append((turn, role, text))
    if begun:
        yield now, rows


def _ordinary(report: bool):
    def run(batches):
        out = _Out(REPORT if report else TURNS)
        for conv, rows in _conversations(batches):
            faults, cost, audit = _repaired(rows)
            left = earley.applied(audit, ((r, t) for _, r, t in rows))
            if report:
                out.add((conv, *faults.report(cost), audit, hashed(left)), len(audit))
            else:
                for k, (edit, role, text) in enumerate(left):
                    out.add((conv, k, edit, role, text), len(text))
            yield from out.full()
        yield from out.full(True)

    return run


_BLOCK = "conv_id long, part int, rows long, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, begin int, end int, cost long, audit binary"
_ORDER = ("turn", "role", "text")


def _blocks(batches):
    """A row for each pair of symbols before and after a task's block of a conversation, with the block's counts."""
    out, part = _Out(_BLOCK), TaskContext.get().partitionId()
    now = faults = charts = before = None
    n = 0

    def done():
        shared = (now, part, n, faults.low or 0, faults.high or 0, faults.turns, faults.first, faults.last, *(faults.n[c] for c in ("blank", "duplicate", "truncated", "illegal")))
        for x, chart in charts.items():
            for made, (cost, audit) in chart.ends().items():
                packed = zlib.compress(audit.encode(), 1)
                out.add((*shared, x, made, cost, packed), len(packed))

    for b in batches:
        for conv, turn, role, text, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if charts is None or conv != now:
                if charts is not None:
                    done()
                    yield from out.full()
                now, faults, n, before = conv, _Faults(), 0, None
                charts = {x: Chart(x) for x in SYMBOLS}
            known = turn != first or before == (turn, role, text)
            before = (turn, role, text)
            read = faults.row(turn, role, text, known)
            n += 1
            for chart in charts.values():
                chart.turn(*read)
    if charts is not None:
        done()
    yield from out.full(True)


def _joined(blocks):
    """One report row, without its hash, of a giant conversation's blocks."""
    import pandas as pd

    blocks = blocks.sort_values("part", kind="stable")
    now, n, turns, low, high, last = {earley.EMPTY: (0, "")}, dict.fromkeys(COUNTS, 0), 0, None, None, None
    for _, block in blocks.groupby("part", sort=True):
        head = block.iloc[0]
        ends: dict[int, dict[int, tuple[int, str]]] = {x: {} for x in SYMBOLS}
        for x, made, cost, audit in zip(block["begin"], block["end"], block["cost"], block["audit"], strict=True):
            ends[x][made] = (cost, zlib.decompress(audit).decode())
        now = earley.joined(now, [ends])
        for c in ("blank", "duplicate", "truncated", "illegal"):
            n[c] += int(head[c])
        n["illegal"] += last is not None and last + head["first"] not in LEGAL
        last = head["last"]
        if head["turns"]:
            turns += int(head["turns"]) - (high == head["low"])
            low, high = head["low"] if low is None else low, head["high"]
    cost, audit = _best(now)
    n |= {"cost": cost, "gaps": 0 if low is None else int(high - low + 1 - turns)}
    conv = blocks["conv_id"].iloc[0]
    return pd.DataFrame({"conv_id": [None if pd.isna(conv) else conv], **{c: [int(n[c])] for c in COUNTS}, "audit": [audit]}).astype({"conv_id": "Int64"})


def _past_audit(report: bool):
    """Sorted rows (conv_id, kind, audit, turn, role, text), each conversation's audit first: hashes or turns."""

    def run(batches):
        out = _Out("conv_id long, repaired_sha256 string" if report else TURNS)
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(stream, None)
        while ahead is not None:
            conv, _, audit, *_ = ahead
            ahead = next(stream, None)

            def own():
                nonlocal ahead
                while ahead is not None and ahead[1] == 1 and ahead[0] == conv:
                    yield ahead[4], ahead[5]
                    ahead = next(stream, None)

            rows = own()
            left = earley.applied(audit, rows)
            if report:
                out.add((conv, hashed(left)))
            else:
                for k, (edit, role, text) in enumerate(left):
                    out.add((conv, k, edit, role, text), len(text))
                    yield from out.full()
            for _ in rows:  # none is left: the audit reads every row
                pass
            yield from out.full()
        yield from out.full(True)

    return run


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _giants(rows: DataFrame, ids: DataFrame, work: scratch.Work, report: bool) -> DataFrame:
    own = rows.filter("not gone").join(F.broadcast(ids) if ids.count() < 100_000 else ids, _same(rows["conv_id"], ids["giant"]), "left_semi").select("conv_id", *_ORDER)
    own = work.table(own, "repair-giants")
    key = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    keyed = own.withColumn("key", key)
    # a null turn stands before all others, and min() would skip it
    first = keyed.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("f"))
    known = keyed.join(first, _same(keyed["conv_id"], first["c"]) & (keyed["key"] == first["k"])).select("conv_id", *_ORDER, F.col("f.turn").alias("first"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = known.repartitionByRange(scratch.width(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = REPORT.rsplit(", ", 1)[0]
    audits = work.table(work.table(ranged.mapInArrow(_blocks, _BLOCK), "repair-blocks").groupBy("conv_id").applyInPandas(_joined, schema), "repair-audits")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    stream = audits.select("conv_id", F.lit(0).alias("kind"), "audit", *none).unionByName(own.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *_ORDER))
    stream = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text")
    if not report:
        return stream.mapInArrow(_past_audit(False), TURNS)
    hashes = stream.mapInArrow(_past_audit(True), "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return audits.join(hashes, _same(audits["conv_id"], hashes["c"])).drop("c")


def _repair(rows: DataFrame, giant: int, report: bool) -> DataFrame:
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"),
    )
    size = F.when(F.col("gone"), 0).otherwise(F.octet_length("role") + F.octet_length("text") + 100)
    with scratch.Work() as work:
        rows = work.table(rows, "repair-rows")
        ids = work.table(rows.groupBy("conv_id").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > giant).select(F.col("conv_id").alias("giant")), "repair-ids")
        huge = bool(ids.take(1))
        rest = rows.join(ids, _same(rows["conv_id"], ids["giant"]), "left_anti") if huge else rows
        rest = rest.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
        out = rest.mapInArrow(_ordinary(report), REPORT if report else TURNS)
        if huge:
            out = out.unionByName(_giants(rows, ids, work, report))
        return scratch.Table(out, "repaired").read()


def report(rows: DataFrame, giant: int = GIANT) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text, and gone where rows only name their conversation. Rows are taken by turn, null
    first, then by role and text, so repeated rows stand together. A null role or text is one space; rows whose conv_id
    is null are one conversation, with a null id. Cheapest edits: keep 0, delete 3 (blank and repeated rows must go),
    rerole to user or assistant 2, insert an empty turn of either 2, and 1 for each kept or rerole'd truncated row; of
    equal cost the audit that is least in ASCII. A conversation without rows has zeros, an empty audit and the hash of
    an empty string. Other columns are not read; an empty table gives an empty one. A hash is a chain, so one task ends
    each conversation's, in memory of its audit.
    """
    return _repair(rows, giant, True)


def repaired(rows: DataFrame, giant: int = GIANT) -> DataFrame:
    """The turns that the repair leaves: conv_id, place (from 0), edit (K, R or I), role, text; as report() has it."""
    return _repair(rows, giant, False)
