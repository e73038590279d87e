"""Rolling features kept from night to night: an extension, the screening application works all of them out anew.

A table of tails holds each ticker's newest bars, as many as the longest window needs, and how many bars it has. A night
reads the tails and the new bars, never the years behind them. A ticker whose new bars are not all newer than its tail
(a late session, a correction, a ticker without a tail) is worked out from its stored bars again; so is one whose
history was pulled anew after a split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.stage import kept, written
from tapeloom.operators import indicators as ind
from tapeloom.operators import storage as st
from tapeloom.sinks.stores import BARS
from tapeloom.sinks.tables import Table

KEY = ["market", "ticker"]
BAR = ["d", "o", "h", "l", "c", "v"]
FEATURES = ["ma10", "ma20", "ma50", "ma150", "ma200", "hi252", "lo252", "vol50", "ma200_22", "rs_raw"]
#: Bars of a tail: the longest window is 252 and the longest lag 252.
TAIL = 260


def tails(spark: SparkSession, path: str) -> Table:
    """Each ticker's newest bars, oldest first, and its number of bars."""
    bar = "struct<d: date, o: double, h: double, l: double, c: double, v: double>"
    return Table(spark, path, f"market string, ticker string, k long, bars array<{bar}>", KEY, {"by_market": "market", "by_hash": "pmod(hash(ticker), 16)"})


def features(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "market string, ticker string, d date, k long, " + ", ".join(f"{c} double" for c in FEATURES), [*KEY, "d"], {"by_market": "market", "by_month": "date_format(d, 'yyyy-MM')"})


def _worked_out(bars: DataFrame) -> DataFrame:
    """Features of bars that carry `before`, the number of a ticker's bars before the first of them here."""
    x = ind.features(bars)
    return x.withColumn("k", F.col("k") + F.col("before"))


def _tail(bars: DataFrame) -> DataFrame:
    """The next tails of bars with `before`."""
    listed = F.sort_array(F.collect_list(F.struct(*BAR)))
    return bars.groupBy(*KEY).agg((F.max("before") + F.count("*")).alias("k"), F.slice(listed, -TAIL, TAIL).alias("last"), listed.alias("every")).select(*KEY, "k", F.when(F.size("every") > TAIL, F.col("last")).otherwise(F.col("every")).alias("bars"))


def _keep(own: DataFrame, out: Table, tail_table: Table, since: bool) -> None:
    """Save the features of bars (with `before`, and with `last` where only newer ones count) and the tails after them."""
    own = written(own, "upkeep-bars")
    x = _worked_out(own)
    x = x.filter(F.col("d") > F.col("last")) if since else x
    out.upsert(x.select(*KEY, "d", "k", *FEATURES))
    tail_table.upsert(_tail(own.select(*KEY, *BAR, "before")), settled=True)


def night(bars: Table, tail_table: Table, out: Table, fresh: DataFrame) -> None:
    """Store fresh bars (BARS) and keep features and tails in step. A night that was stopped may be run again."""
    with kept():
        fresh = written(fresh.select(*(x.split()[0] for x in BARS.split(", "))), "upkeep-fresh")
        bars.upsert(fresh, settled=True)
        stored = tail_table.rows().withColumn("last", F.col("bars")[F.size("bars") - 1]["d"])
        known = fresh.groupBy(*KEY).agg(F.min("d").alias("first")).join(stored, KEY, "left")
        known = written(known.withColumn("late", F.coalesce(F.col("first") <= F.col("last"), F.lit(True))), "upkeep-known")
        due = known.filter("not late").withColumn("before", F.col("k") - F.size("bars"))
        old = due.select(*KEY, "before", "last", F.explode("bars").alias("b")).select(*KEY, *(f"b.{c}" for c in BAR), "before", "last")
        new = fresh.join(due.select(*KEY, "before", "last"), KEY).select(*KEY, *BAR, "before", "last")
        _keep(old.unionByName(new), out, tail_table, True)
        late = known.filter("late").select(*KEY)
        if not late.isEmpty():
            _keep(bars.rows().join(late, KEY, "left_semi").withColumn("before", F.lit(0)), out, tail_table, False)


def repulled(bars: Table, tail_table: Table, out: Table, affected: DataFrame, fresh: DataFrame) -> None:
    """Replace the histories of affected tickers (ticker) by fresh ones and work their features out again; a ticker without fresh bars keeps its own."""
    with kept():
        fresh = written(fresh, "upkeep-fresh")
        hit = written(affected.select("ticker").distinct().join(fresh.select("ticker").distinct(), "ticker", "left_semi"), "upkeep-hit")
        bars.rewrite(lambda rows: st.repull(rows, hit, fresh.select(rows.columns)))
        out.rewrite(lambda rows: rows.join(hit, "ticker", "left_anti").select(rows.columns))
        _keep(bars.rows().join(hit, "ticker", "left_semi").withColumn("before", F.lit(0)), out, tail_table, False)
