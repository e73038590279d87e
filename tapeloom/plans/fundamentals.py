"""Queries of fundamentals, over quarters made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import fundamentals as fu
from tapeloom.plans.indicators import _r
from tapeloom.registry import query
from tapeloom.sources.panel import table

QUARTERS_SQL = """WITH cents AS (SELECT c_mktsegment || '-' || CAST(c_nationkey % 5 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS od,
  CAST(round(o_totalprice * 100) AS BIGINT) AS x, o_orderkey % 7 - 2 AS f FROM orders JOIN customer ON o_custkey = c_custkey),
quarters AS (SELECT ticker, CAST(date_trunc('quarter', od) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q_end, CAST(sum(x) AS DOUBLE) AS revenue,
  CAST(sum(x * f) AS DOUBLE) AS net_income, CAST(sum(x * f) AS DOUBLE) / 1e6 AS eps FROM cents GROUP BY 1, 2)"""
GROWTH_SQL = QUARTERS_SQL + """,
w AS (SELECT *, row_number() OVER o - 1 AS i, CASE WHEN lead(revenue, 4) OVER o > 0 THEN (revenue / lead(revenue, 4) OVER o - 1) * 100 END AS rev,
  CASE WHEN lead(net_income, 4) OVER o > 0 THEN (net_income / lead(net_income, 4) OVER o - 1) * 100 END AS ni,
  CASE WHEN lead(eps, 4) OVER o > 0 THEN (eps / lead(eps, 4) OVER o - 1) * 100 END AS ep, CASE WHEN revenue > 0
  THEN net_income / revenue * 100 END AS m FROM quarters WINDOW o AS (PARTITION BY ticker ORDER BY q_end DESC)),
v AS (SELECT *, lead(rev) OVER o AS rev1, lead(ni) OVER o AS ni1, lead(ep) OVER o AS ep1, m - lead(m, 4) OVER o AS md FROM w WINDOW o AS (PARTITION BY ticker ORDER BY q_end DESC)),
g AS (SELECT *, coalesce(ni > ni1, false) AS acc, coalesce(ep > ep1, false) AS eacc FROM v WHERE i = 0 AND coalesce(rev, rev1, ni, ni1) IS NOT NULL)"""


def quarters(spark, sf_dir):
    """ticker, q_end, revenue, net_income, eps by customer segment and quarter."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("ticker"))
    x = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("od"), F.round(F.col("o_totalprice") * 100).cast("long").alias("x"), (F.col("o_orderkey") % 7 - 2).alias("f"))
    q = F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", "od")), 3), 1)
    joined = x.join(c, x["o_custkey"] == c["c_custkey"])
    return joined.groupBy("ticker", q.alias("q_end")).agg(F.sum("x").cast("double").alias("revenue"), F.sum(F.col("x") * F.col("f")).cast("double").alias("net_income"), (F.sum(F.col("x") * F.col("f")).cast("double") / 1e6).alias("eps"))


@query(GROWTH_SQL + """ SELECT ticker, q_end AS quarter_end, round(rev, 6) AS rev_yoy, round(rev1, 6) AS rev_yoy_prev, round(ni, 6) AS ni_yoy, round(ni1, 6) AS ni_yoy_prev,
  acc AS accelerating, eacc AS eps_accelerating, round(m, 6) AS margin, round(md, 6) AS margin_delta FROM g""")
def growth_metrics(spark, sf_dir):
    x = fu.growth(quarters(spark, sf_dir))
    return x.select("ticker", "quarter_end", *(_r(F.col(c), c) for c in ("rev_yoy", "rev_yoy_prev", "ni_yoy", "ni_yoy_prev")), "accelerating", "eps_accelerating", *(_r(F.col(c), c) for c in ("margin", "margin_delta")))


@query(GROWTH_SQL + """, b AS (SELECT ticker, m AS roe, [coalesce(ep, ni) >= 25, rev >= 20, CASE WHEN ep1 IS NOT NULL OR ni1 IS NOT NULL THEN eacc OR acc END, md > 0,
  m >= 17] AS boxes FROM g),
k AS (SELECT *, len(list_filter(boxes, lambda z: z IS NOT NULL)) AS known, len(list_filter(boxes, lambda z: z)) AS good FROM b)
SELECT ticker, CASE WHEN known >= 3 THEN CASE WHEN good / known >= 0.8 THEN 'A' WHEN good / known >= 0.6 THEN 'B' WHEN good / known >= 0.4 THEN 'C'
  WHEN good / known >= 0.2 THEN 'D' ELSE 'E' END END AS grade FROM k""")
def fundamental_grades(spark, sf_dir):
    return fu.scorecard(fu.growth(quarters(spark, sf_dir)).withColumn("roe", F.col("margin"))).select("ticker", "grade")


@query(QUARTERS_SQL + """ SELECT split_part(ticker, '-', 1) AS segment, row_number() OVER (PARTITION BY split_part(ticker, '-', 1) ORDER BY q_end DESC) - 1 AS slot, q_end,
  sum(revenue) AS val FROM quarters GROUP BY 1, 3 QUALIFY slot < 12""")
def quarter_grid(spark, sf_dir):
    q = quarters(spark, sf_dir).groupBy(F.split_part("ticker", F.lit("-"), F.lit(1)).alias("ticker"), F.col("q_end").alias("end")).agg(F.sum("revenue").alias("val"))
    return fu.quarter_grid(q).select(F.col("ticker").alias("segment"), F.col("slot").cast("long").alias("slot"), "q_end", "val")


FACTS_SQL = """WITH facts AS (SELECT 'S' || CAST(l_suppkey % 20 AS VARCHAR) AS ticker, ['Revenues', 'SalesRevenueNet', 'Other'][l_orderkey % 3 + 1] AS tag, CASE
  WHEN l_orderkey % 2 = 0 THEN 'CY' || CAST(year(l_shipdate) AS VARCHAR) || CASE WHEN l_orderkey % 5 = 0 THEN ''
  ELSE 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) END END AS frame,
 CAST(date_trunc('quarter', l_shipdate) AS DATE) AS st, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS en,
  CAST(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS DATE) AS filed, CAST(l_quantity AS DOUBLE) AS val FROM lineitem)"""


def _facts(spark, sf_dir):
    k, ship = F.col("l_orderkey"), F.col("l_shipdate")
    tag = F.element_at(F.array(F.lit("Revenues"), F.lit("SalesRevenueNet"), F.lit("Other")), (k % 3 + 1).cast("int"))
    frame = F.when(k % 2 == 0, F.concat(F.lit("CY"), F.year(ship).cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Q"), F.quarter(ship).cast("string")))))
    start = F.to_date(F.date_trunc("quarter", ship))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("ticker"), tag.alias("tag"), frame.alias("frame"), start.alias("start"), F.date_sub(F.add_months(start, 3), 1).alias("end"), F.date_add(F.to_date(ship), F.col("l_linenumber")).alias("filed"), F.col("l_quantity").cast("double").alias("val"))


@query(FACTS_SQL + """ SELECT ticker, en AS q_end, val FROM facts WHERE tag IN ('Revenues', 'SalesRevenueNet') AND CASE WHEN frame IS NOT NULL THEN regexp_matches(frame,
  '^CY[0-9]{4}Q[1-4]$') ELSE date_diff('day', st, en) BETWEEN 75 AND 100 END AND en >= DATE '1997-12-31'
 QUALIFY row_number() OVER (PARTITION BY ticker, en ORDER BY CASE tag WHEN 'Revenues' THEN 1 ELSE 2 END, filed DESC, val) = 1""")
def filed_flow_series(spark, sf_dir):
    return fu.flow_series(_facts(spark, sf_dir), ["Revenues", "SalesRevenueNet"], "2001-12-31").select("ticker", F.col("end").alias("q_end"), "val")


@query(FACTS_SQL + """ SELECT ticker, en AS q_end, val FROM facts WHERE tag = 'SalesRevenueNet' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY en DESC, filed DESC,
  val DESC) = 1""")
def filed_latest_instant(spark, sf_dir):
    return fu.latest_instant(_facts(spark, sf_dir), ["Absent", "SalesRevenueNet", "Other"]).select("ticker", F.col("end").alias("q_end"), "val")
