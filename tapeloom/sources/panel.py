"""Daily bars from the driver's line items, the same in Spark and SQL.

A supplier is a ticker. A day's discounts, in points around five, move its price by half a unit each, with a drift by
ticker; every price is a multiple of a quarter, so sums and means are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Shares of a line item's unit: brings a day's value near the floors of real markets.
LOTS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, ticker, d, o, h, l, c, v: one row per ticker and trading day, no nulls."""
    s = F.col("l_suppkey")
    own = ["market", "ticker", "l_suppkey"]
    # dealt by ticker once: days, closes and every later window of a ticker's own bars read that one exchange
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.when(s % 2 == 0, "MY").otherwise("US").alias("market"),
            F.concat(F.lit("T"), F.lpad(s.cast("string"), 6, "0"), F.when(s % 2 == 0, ".KL").otherwise("")).alias("ticker"),
            "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_quantity", (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("x"),
        )
        .repartition("market", "ticker")
    )
    daily = lines.groupBy(*own, "d").agg(F.sum("x").alias("x"), F.sum("l_quantity").alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy(*own).orderBy("d")
    moved = daily.withColumn("c", F.greatest(F.lit(2.0), 60 + 0.5 * F.sum(F.col("x") + s % 5 - 1).over(w)))
    opened = moved.withColumn("p", F.coalesce(F.lag("c").over(w), F.col("c"))).withColumn("o", F.when(F.col("n") % 2 == 0, F.col("c")).otherwise(F.col("p") + 0.25 * (F.dayofmonth("d") % 3)))
    return opened.select(
        "market",
        "ticker",
        "d",
        "o",
        (F.greatest("o", "c") + 0.25 * (F.col("v").cast("long") % 5)).alias("h"),
        F.greatest(F.lit(0.5), F.least("o", "c") - 0.25 * (F.col("v").cast("long") % 4)).alias("l"),
        "c",
        (F.col("v") * LOTS).alias("v"),
    )


BARS_SQL = """
WITH daily AS (
  SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS x, sum(l_quantity) AS v, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
moved AS (SELECT *, greatest(2.0::DOUBLE, 60 + 0.5::DOUBLE * sum(x + s % 5 - 1) OVER (PARTITION BY s ORDER BY d)) AS c FROM daily),
before AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY s ORDER BY d), c) AS p FROM moved),
opened AS (SELECT *, CASE WHEN n % 2 = 0 THEN c ELSE p + 0.25::DOUBLE * (day(d) % 3) END AS o FROM before),
bars AS (
  SELECT CASE WHEN s % 2 = 0 THEN 'MY' ELSE 'US' END AS market,
         'T' || lpad(CAST(s AS VARCHAR), 6, '0') || CASE WHEN s % 2 = 0 THEN '.KL' ELSE '' END AS ticker, d, o,
         greatest(o, c) + 0.25::DOUBLE * (CAST(v AS BIGINT) % 5) AS h,
         greatest(0.5::DOUBLE, least(o, c) - 0.25::DOUBLE * (CAST(v AS BIGINT) % 4)) AS l, c, v * 2500 AS v FROM opened)"""


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars on a common clock: a ticker's k-th bar is dated the k-th day of 2000 on, and one bar in 701 is missing."""
    w = Window.partitionBy("market", "ticker").orderBy("d")
    k = F.row_number().over(w)
    x = bars(spark, sf_dir).withColumn("k", k).filter((F.col("k") + F.ascii(F.substring("ticker", 7, 1)) * 37) % 701 != 0)
    return x.withColumn("d", F.date_add(F.lit("2000-01-01").cast("date"), F.col("k"))).drop("k")


SESSION_SQL = BARS_SQL.replace("bars AS (", "own AS (") + """,
keyed AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d) AS k FROM own),
bars AS (SELECT market, ticker, CAST(DATE '2000-01-01' + CAST(k AS INTEGER) AS DATE) AS d, o, h, l, c, v FROM keyed WHERE (k + ascii(substr(ticker, 7, 1)) * 37) % 701 <> 0)"""
