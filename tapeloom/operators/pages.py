"""What pages over the saved tables read: the newest board, one ticker's rows, runs by market, outcomes, groups and levels; and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.storage import newest

# Day formats of pages, tried in order; runs and outcomes a page shows; the band of "close to the pivot".
DAY_FORMATS, RUNS, CLOSE_BAND = ("d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "d/M/yyyy"), 20, (-12.0, 3.0)


def parse_day(text: Column) -> Column:
    """A day as pages print it (`31 Dec, 2026`, `2026-12-31`, `31/12/2026`), null where no format fits."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in DAY_FORMATS))


def host(url: Column) -> Column:
    """The host of an address without a leading www., empty where there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^www\.", ""), F.lit(""))


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")


def newest_board(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates of the newest run (run_id, run_day): joined on run_id."""
    last = runs.orderBy(F.desc("run_day"), F.desc("run_id")).limit(1)
    return candidates.join(F.broadcast(last.select("run_id", F.col("run_day").alias("as_of"))), "run_id")


def candidate_detail(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Each ticker's row of the newest run that has it, with the run's day as as_of."""
    x = candidates.join(runs.select("run_id", F.col("run_day").alias("as_of")), "run_id")
    return newest(x, 1, [F.desc("as_of"), F.desc("run_id")], ["ticker"])


def newest_by(runs: DataFrame, key: str) -> DataFrame:
    """The newest saved run (created, then id) of each market or strategy; runs without one go."""
    return newest(runs.filter(F.col(key).isNotNull()), 1, [F.desc("created"), F.desc("id")], [key])


def board_groups(board: DataFrame) -> DataFrame:
    """Rows with group and place: swings that have crossed the pivot are `triggered`, others `at_buy_point`; of the rest those from 12 % below to 3 % above it are `close` (by anticipation, then nearness); else the bucket.

    board: ticker, bucket, price, pivot, ready, rs_rank. Within other groups places follow the rank; ties by ticker.
    """
    off = F.when(F.col("pivot") > 0, (F.col("price") / F.col("pivot") - 1) * 100)
    near = F.coalesce((off > CLOSE_BAND[0]) & (off < CLOSE_BAND[1]), F.lit(False))
    swing = F.col("bucket") == "swing"
    group = F.when(swing & F.coalesce(off >= 0, F.lit(False)), "triggered").when(swing, "at_buy_point").when(near, "close").otherwise(F.col("bucket"))
    x = board.withColumns({"off_pivot": off, "group": group})
    is_close = F.col("group") == "close"
    order = [F.when(is_close, F.coalesce("ready", F.lit(-1))).desc_nulls_last(), F.when(is_close, F.abs("off_pivot")).asc_nulls_last(), F.desc_nulls_last("rs_rank"), F.asc("ticker")]
    return x.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(*order)))


def tier(x: Column, high: float, low: float) -> Column:
    """`high`, `middle` or `low`: ranks at 90 and 70, shares above the 200-day mean at 60 and 40."""
    return F.when(x >= high, "high").when(x >= low, "middle").otherwise("low")


def chart_levels(board: DataFrame, statistics: DataFrame) -> DataFrame:
    """market, ticker, level, price: the stop, and what the market's expectancy and mean win come to from the pivot; only where the pivot is above the stop."""
    risk = F.col("pivot") - F.col("stop")
    x = board.filter("pivot > stop").join(statistics.select("market", "expectancy", "mean_win"), "market", "left")
    levels = {"stop": F.col("stop"), "expectancy": F.col("pivot") + F.col("expectancy") * risk, "mean_win": F.col("pivot") + F.col("mean_win") * risk}
    kinds = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("level"), v.alias("price"))) for k, v in levels.items())))
    return x.select("market", "ticker", F.explode(kinds).alias("l")).select("market", "ticker", "l.*")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest n saved runs of any label, newest first."""
    return runs.orderBy(F.desc("created"), F.desc("id")).limit(n)


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("id") == run_id)


def latest_review(reviews: DataFrame) -> DataFrame:
    """The newest review (created, then id), or no row."""
    return reviews.orderBy(F.desc("created"), F.desc("id")).limit(1)


def latest_factor_tables(rows: DataFrame) -> DataFrame:
    """Of each factor the rows of its newest batch (computed): factors of an older batch stay beside those of a newer one."""
    newest_batch = rows.groupBy(F.col("factor").alias("_f")).agg(F.max("computed").alias("_c"))  # one row a factor
    return rows.join(F.broadcast(newest_batch), (F.col("factor") == F.col("_f")) & (F.col("computed") == F.col("_c"))).drop("_f", "_c")


def top_swings(board: DataFrame, n: int = 5) -> DataFrame:
    """The first n swings of each market by quality, then rank, for the brief."""
    order = Window.partitionBy("market").orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("rs_rank"), "ticker")
    return board.filter("bucket = 'swing'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def guarded(written: DataFrame, board: DataFrame, key: list[str]) -> DataFrame:
    """Rows that someone else wrote about the board, without those on tickers that it does not have, and one of each ticker (the first by its place)."""
    one = newest(written, 1, [F.asc("place")], key)
    return one.join(board.select(*key).distinct(), key, "left_semi")
