"""Queries of what readers of the board ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import board as bd
from tapeloom.operators import indicators as ind
from tapeloom.operators import market as mk
from tapeloom.operators import reads as rd
from tapeloom.operators import weekly as wk
from tapeloom.plans.board import SETUP_SQL, WEEKS_SQL
from tapeloom.plans.indicators import FEATURES_SQL, _full, _r
from tapeloom.plans.market import WEEK_SQL
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars, table



def _price(x: str) -> str:
    exact = f"CAST({x} AS DECIMAL(24, 8))"  # ties of decimals, not of doubles
    return f"CAST(CASE market WHEN 'MY' THEN round({exact}, 3) ELSE round({exact}, 2) END AS DOUBLE)"


@query(FEATURES_SQL + f""", ix AS (SELECT market, d, sum(c) / count(c) AS b FROM bars WHERE day(d) <> 13 GROUP BY 1, 2), near AS (SELECT features.*,
  last_value(b IGNORE NULLS) OVER (PARTITION BY market, ticker ORDER BY d) AS b1, {_full('stddev_samp', 'c', 20)} AS sd,
  row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) AS back FROM features LEFT JOIN ix USING (market, d)), tail AS (SELECT *,
  c / b1 AS ratio FROM near WHERE back <= 130),
based AS (SELECT *, first_value(ratio) OVER (PARTITION BY market, ticker ORDER BY d) AS base FROM tail)
SELECT ticker, d AS t, {_price('o')} AS o, {_price('c')} AS c, {_price('ma20')} AS m20, {_price('ma50')} AS m50, {_price('ma150')} AS m150,
  {_price('ma200')} AS m200, {_price('ma20 + 2 * sd')} AS bbu, {_price('ma20 - 2 * sd')} AS bbl, round(ratio / base, 4) AS rs,
  CAST(floor(v) AS BIGINT) AS v, CAST(floor(vol50) AS BIGINT) AS v50 FROM based""")
def candle_payload(spark, sf_dir):
    b = bars(spark, sf_dir)
    x = rd.candle_payload(b, mk.benchmark(b).filter(F.dayofmonth("d") != 13))
    return x.select("ticker", F.explode("candles").alias("x")).select("ticker", *(f"x.{k}" for k in "t o c m20 m50 m150 m200 bbu bbl rs v v50".split()))


@query(FEATURES_SQL + """, u AS (SELECT market, ticker, unnest([
 CASE WHEN NOT t1 THEN {'r': 'price_above_150_200', 'h': c, 'w': greatest(ma150, ma200)} END, CASE WHEN NOT t2
  THEN {'r': 'ma150_above_ma200', 'h': ma150, 'w': ma200} END, CASE WHEN NOT t3 THEN {'r': 'ma200_rising_1m', 'h': ma200, 'w': ma200_22} END,
 CASE WHEN NOT t4 THEN {'r': 'ma50_above_150_200', 'h': ma50, 'w': greatest(ma150, ma200)} END, CASE WHEN NOT t5
  THEN {'r': 'price_above_ma50', 'h': c, 'w': ma50} END, CASE WHEN NOT t6
  THEN {'r': 'above_52w_low_30pct', 'h': (c / lo252 - 1) * 100, 'w': 30.0::DOUBLE} END,
 CASE WHEN NOT t7 THEN {'r': 'within_25pct_of_52w_high', 'h': (1 - c / hi252) * 100, 'w': 25.0::DOUBLE} END, CASE WHEN NOT t8
  THEN {'r': 'rs_rank_ge_70', 'h': CAST(rs_rank AS DOUBLE), 'w': 70.0::DOUBLE} END]) AS x FROM templated)
SELECT ticker, x.r AS rule, round(coalesce(x.h, -1), 6) AS have, round(coalesce(x.w, -1), 6) AS want FROM u WHERE x IS NOT NULL""")
def template_gaps(spark, sf_dir):
    x = rd.gaps(ind.template(ind.with_rank(ind.newest(ind.features(bars(spark, sf_dir))))))
    return x.select("ticker", "rule", *(_r(F.coalesce(k, F.lit(-1.0)), k) for k in ("have", "want")))


@query(WEEK_SQL + """, l AS (SELECT *, count(*) OVER (PARTITION BY market, ticker) AS weeks FROM risen QUALIFY row_number() OVER (PARTITION BY market, ticker
  ORDER BY week DESC) = 1)
SELECT ticker, weeks, round(ma30w, 6) AS ma30w, rising, c > ma30w AS above, round((c / ma30w - 1) * 100, 6) AS pct, c > ma30w AND rising AS stage2,
  CASE WHEN c > ma30w AND rising THEN 'stage 2' WHEN c > ma30w THEN 'base' ELSE 'below' END AS label FROM l WHERE weeks > 30 AND ma30w IS NOT NULL""")
def weekly_stage(spark, sf_dir):
    x = rd.stage(wk.weekly_facts(bars(spark, sf_dir)))
    return x.select("ticker", "weeks", _r(F.col("ma30w"), "ma30w"), "rising", "above", _r(F.col("pct"), "pct"), "stage2", "label")


@query(FEATURES_SQL + WEEKS_SQL + """, pos AS (SELECT market, ticker, row_number() OVER (ORDER BY market, ticker) AS id, d AS entry_d, c AS entry, c * 0.9375::DOUBLE AS stop, CASE
  WHEN ascii(ticker[7]) % 2 = 0 THEN c * 1.03125::DOUBLE END AS pv FROM (SELECT *, row_number() OVER (PARTITION BY market, ticker
  ORDER BY d DESC) AS r FROM bars) WHERE r = 12),
x AS (SELECT pos.*, n.c, n.c10, n.ma50, n.v, n.vol50, distribution_weeks, date_diff('day', entry_d, DATE '2001-11-10') AS held FROM pos
  JOIN newest n USING (market, ticker) JOIN dist_weeks USING (market, ticker) WHERE n.k >= 60)
SELECT id, ticker, round(c, 2) AS last_price, held, coalesce(held >= 5 AND c < entry * 1.02::DOUBLE AND c >= stop, false) AS time_stop,
  c < stop AS stop_violated, coalesce(entry >= pv AND c < pv, false) AS failed_breakout, distribution_weeks, coalesce(c >= pv * 1.15::DOUBLE
  AND held <= 21, false) AS sell_strength, coalesce(vol50 > 0 AND v > 1.5 * vol50, false) AS heavy_volume FROM x""")
def position_signals(spark, sf_dir):
    """Positions entered eleven bars ago, half of them with a pivot."""
    from pyspark.sql import Window

    from tapeloom.functions.frames import newest_first

    b = bars(spark, sf_dir)
    c = F.col("c")
    then = b.withColumn("r", F.row_number().over(newest_first())).filter("r = 12")
    positions = then.select("market", "ticker", F.row_number().over(Window.orderBy("market", "ticker")).alias("id"), F.col("d").alias("entry_d"), c.alias("entry"), (c * 0.9375).alias("stop"), F.when(F.ascii(F.substring("ticker", 7, 1)) % 2 == 0, c * 1.03125).alias("pivot"))
    x = rd.open_positions(positions, ind.newest(ind.features(b)), b, "2001-11-10")
    picked = ("time_stop", "stop_violated", "failed_breakout", "distribution_weeks", "sell_strength")
    return x.select(F.col("id").cast("long").alias("id"), "ticker", "last_price", F.col("held").cast("long").alias("held"), *(f"signals.{k}" for k in picked), "heavy_volume")


_WAS_SQL = SETUP_SQL.replace("FROM opened)", "FROM opened WHERE d <= DATE '2001-09-15')")


@query(f"""WITH a AS ({SETUP_SQL} SELECT market, ticker FROM board), b AS ({_WAS_SQL} SELECT market, ticker FROM board)
SELECT market, ticker, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT market, ticker, 'dropped' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def board_changes(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rd.changes(bd.board(b), bd.board(b.filter("d <= date '2001-09-15'")))


@query(SETUP_SQL + " SELECT market, bucket, count(*) AS n FROM board GROUP BY 1, 2")
def bucket_counts(spark, sf_dir):
    return rd.bucket_counts(bd.board(bars(spark, sf_dir)))


@query("""WITH runs AS (SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN event_type END AS strategy, CAST(ts AS DATE) AS created, CASE
  WHEN user_id % 7 > 0 THEN value END AS expectancy FROM events)
SELECT id, coalesce(strategy, 'breakout') AS strategy, row_number() OVER (ORDER BY expectancy DESC NULLS LAST, coalesce(strategy,
  'breakout')) AS place FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY coalesce(strategy, 'breakout') ORDER BY created DESC,
  id DESC) = 1)""")
def newest_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("strategy"), F.to_date("ts").alias("created"), F.when(F.col("user_id") % 7 > 0, F.col("value")).alias("expectancy"))
    return rd.newest_runs(runs).select("id", "strategy", F.col("place").cast("long").alias("place"))


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, s_name AS name, s_suppkey % 3 = 0 AS shariah,
  'Industry & ' || CAST(s_nationkey AS VARCHAR) AS industry, CASE WHEN s_suppkey % 4 > 0 THEN 'Main Market' ELSE '-' END AS board FROM supplier""")
def listing_table(spark, sf_dir):
    """A page a nation with two tables: one of other columns, and the listing with a banner row and each row twice."""
    s = F.col("s_suppkey")
    name = F.concat("s_name", F.when(s % 3 == 0, " [s]").otherwise(""))
    category = F.concat(F.lit("Industry &amp; "), F.col("s_nationkey").cast("string"), F.when(s % 4 > 0, ", Main Market").otherwise(""))
    # pages print codes in full: rows are told apart by them, and SQL's four places come last
    code = F.lpad(s.cast("string"), F.greatest(F.lit(4), F.length(s.cast("string"))), F.lit("0"))
    row = F.concat(F.lit("<tr><td>"), code, F.lit("</td><td class='n'><a href='/x'>"), name, F.lit("</a></td><td>"), category, F.lit("</td></tr>\n"))
    body = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), row.alias("r")).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("r")), "").alias("rows"))
    head = "<p>x</p><TABLE><tr><th>Code</th><th>Price</th></tr><tr><td>9999</td><td>1.0</td></tr></TABLE><table id='t'><tr><th>Code</th><th>Name</th><th>Category</th></tr><tr><td>Advertisement</td></tr>"
    pages = body.select("page", F.concat(F.lit(head), "rows", "rows", F.lit("</table>")).alias("html"))
    x = rd.universe_table(rd.pick_table(rd.page_tables(pages), ["Code", "Category"], ["Price"], ["page"]))
    return x.select(F.lpad("code", 4, "0").alias("code"), "name", "shariah", "industry", F.coalesce("board", F.lit("-")).alias("board"))
