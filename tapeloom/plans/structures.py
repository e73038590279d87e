"""Queries of swings and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.operators import structures as st
from tapeloom.plans.indicators import FEATURES_SQL, _r
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars


def _swings_sql(lookback: int) -> str:
    return BARS_SQL + f""",
tail AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) <= {lookback}),
placed AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY market, ticker) AS n FROM tail),
swings AS (SELECT *, i >= 5 AND i < n - 5 AND h = max(h) OVER (PARTITION BY market, ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS high,
  i >= 5 AND i < n - 5 AND l = min(l) OVER (PARTITION BY market, ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS low FROM placed)"""


@query(_swings_sql(120) + " SELECT ticker, d, CASE WHEN high THEN h END AS swing_high, CASE WHEN low THEN l END AS swing_low FROM swings WHERE high OR low")
def swing_points(spark, sf_dir):
    return st.swings(bars(spark, sf_dir), 120).filter("high or low").select("ticker", "d", F.when(F.col("high"), F.col("h")).alias("swing_high"), F.when(F.col("low"), F.col("l")).alias("swing_low"))


#: Contractions of each ticker, after the swings of 75 bars.
VCP_SQL = """,
highs AS (SELECT market, ticker, i AS hi_i, h AS hi, lead(i) OVER (PARTITION BY market, ticker ORDER BY i) AS next_i,
  row_number() OVER (PARTITION BY market, ticker ORDER BY i DESC) AS back FROM swings WHERE high AND n >= 40),
pairs AS (SELECT a.market, a.ticker, hi_i, (hi - min(b.l)) / hi * 100 AS depth FROM highs a JOIN swings b ON a.market = b.market
  AND a.ticker = b.ticker AND b.low AND b.i > hi_i AND (next_i IS NULL OR b.i < next_i) GROUP BY a.market, a.ticker, hi_i, hi),
kept AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY hi_i) AS k, count(*) OVER (PARTITION BY market, ticker) AS m,
  lag(depth) OVER (PARTITION BY market, ticker ORDER BY hi_i) AS was FROM pairs WHERE depth > 0 AND depth < 40),
legs AS (SELECT market, ticker, max(m) AS m, max(CASE WHEN k = 1 THEN depth END) AS first, max(CASE WHEN k = m THEN depth END) AS last,
  count(*) FILTER (depth >= was) AS worse FROM kept GROUP BY 1, 2),
pv AS (SELECT market, ticker, max(hi) AS pv FROM highs WHERE back <= 2 GROUP BY 1, 2),
recent AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) AS r FROM bars),
vol AS (SELECT market, ticker, count(*) AS n, avg(v) FILTER (r <= 5) AS v5, avg(v) FILTER (r > 5 AND r <= 55) AS v50 FROM recent GROUP BY 1, 2 HAVING count(*) >= 40),
contractions AS (SELECT market, ticker, coalesce(m, 0) AS contractions, last, coalesce(n >= 55 AND v5 < 0.6::DOUBLE * v50, false) AS dry_up, pv AS pvt,
  coalesce(m >= 2 AND last < first AND last < 12.05::DOUBLE AND worse <= 1 AND n >= 55 AND v5 < 0.6::DOUBLE * v50 AND pv IS NOT NULL, false) AS vcp
FROM vol LEFT JOIN legs USING (market, ticker) LEFT JOIN pv USING (market, ticker))"""


@query(_swings_sql(75) + VCP_SQL + " SELECT ticker, contractions, round(last, 6) AS last_depth, dry_up, round(pvt, 6) AS pivot, vcp FROM contractions")
def volatility_contractions(spark, sf_dir):
    x = st.contractions(bars(spark, sf_dir))
    return x.select("ticker", F.size("depths").cast("long").alias("contractions"), _r(F.get("depths", F.size("depths") - 1), "last_depth"), "dry_up", _r(F.col("pivot"), "pivot"), "vcp")


@query(FEATURES_SQL + """, s AS (SELECT *, h - l AS span, abs(c - o) AS body, least(o, c) - l AS lower_, h - greatest(o, c) AS upper_ FROM features)
SELECT ticker, d, coalesce(span > 0 AND body < 0.15::DOUBLE * span, false) AS doji, coalesce(span > 0 AND lower_ > 2 * body AND upper_ < body,
  false) AS hammer, coalesce(span > 0 AND upper_ > 2 * body AND lower_ < body, false) AS shooting_star,
 coalesce(span > 0 AND c > o AND c1 < o1 AND c > o1 AND o < c1, false) AS bullish_engulfing, coalesce(span > 0 AND c < o AND c1 > o1 AND c < o1
  AND o > c1, false) AS bearish_engulfing, coalesce(h < h1 AND l > l1, false) AS inside_day,
 span = min(span) OVER (PARTITION BY market, ticker ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS nr7, coalesce(l > h1, false) AS gap_up FROM s""")
def candle_shapes(spark, sf_dir):
    return st.candle_shapes(ind.features(bars(spark, sf_dir))).select("ticker", "d", "doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "inside_day", "nr7", "gap_up")


BOTTOM_SQL = """bprice AS (SELECT market, ticker, c AS price FROM swings WHERE i = n - 1 AND n >= 45),
lows AS (SELECT market, ticker, i AS i1, l AS l1, lead(i) OVER w AS i2, lead(l) OVER w AS l2 FROM swings WHERE low
  AND n >= 45 WINDOW w AS (PARTITION BY market, ticker ORDER BY i)),
bmid AS (SELECT a.*, (SELECT max(h) FROM swings s WHERE s.market = a.market AND s.ticker = a.ticker AND s.high AND s.i > i1 AND s.i < i2) AS middle
  FROM lows a WHERE i2 - i1 >= 10 AND abs(l1 - l2) / l1 <= 0.03::DOUBLE),
r_bottom AS (SELECT market, ticker, i1, i2, middle FROM bmid JOIN bprice USING (market, ticker) WHERE middle >= least(l1, l2) * 1.06::DOUBLE
  AND price > middle * 0.97::DOUBLE QUALIFY row_number() OVER (PARTITION BY market, ticker ORDER BY i1) = 1)"""


@query(_swings_sql(120) + ", " + BOTTOM_SQL + " SELECT ticker, i1, i2, round(middle, 6) AS middle FROM r_bottom")
def double_bottoms(spark, sf_dir):
    return st.double_bottoms(bars(spark, sf_dir)).select("ticker", F.col("i1").cast("long").alias("i1"), F.col("i2").cast("long").alias("i2"), _r(F.col("middle"), "middle"))


TOP_SQL = """tprice AS (SELECT market, ticker, c AS price, n AS size FROM swings WHERE i = n - 1 AND n >= 45),
tops AS (SELECT market, ticker, i AS i1, h AS h1, lead(i) OVER w AS i2, lead(h) OVER w AS h2 FROM swings WHERE high
  AND n >= 45 WINDOW w AS (PARTITION BY market, ticker ORDER BY i)),
tmid AS (SELECT a.*, (SELECT min(l) FROM swings s WHERE s.market = a.market AND s.ticker = a.ticker AND s.low AND s.i > i1 AND s.i < i2) AS middle
  FROM tops a WHERE i2 - i1 >= 10 AND abs(h1 - h2) / h1 <= 0.03::DOUBLE),
r_top AS (SELECT market, ticker, i1, i2, middle FROM tmid JOIN tprice USING (market, ticker) WHERE i2 >= size - 40 AND middle <= greatest(h1,
  h2) * 0.94::DOUBLE AND price < greatest(h1, h2) * 0.99::DOUBLE QUALIFY row_number() OVER (PARTITION BY market, ticker ORDER BY i1) = 1)"""


@query(_swings_sql(120) + ", " + TOP_SQL + " SELECT ticker, i1, i2, round(middle, 6) AS middle FROM r_top")
def double_tops(spark, sf_dir):
    return st.double_tops(bars(spark, sf_dir)).select("ticker", F.col("i1").cast("long").alias("i1"), F.col("i2").cast("long").alias("i2"), _r(F.col("middle"), "middle"))


@query(_swings_sql(250) + """, t AS (SELECT *, greatest(h - l, abs(h - lag(c) OVER (PARTITION BY market, ticker ORDER BY i)), abs(l - lag(c) OVER (PARTITION BY market, ticker
  ORDER BY i))) AS tr FROM swings),
atr AS (SELECT market, ticker, avg(tr) FILTER (i >= n - 14) AS atr, max(c) FILTER (i = n - 1) AS price, max(n) AS size FROM t GROUP BY 1, 2),
points AS (SELECT market, ticker, h AS p FROM swings WHERE high UNION ALL SELECT market, ticker, l FROM swings WHERE low),
gaps AS (SELECT *, lag(p) OVER (PARTITION BY market, ticker ORDER BY p) AS was FROM points JOIN atr USING (market, ticker)),
isl AS (SELECT *, sum(CASE WHEN p - was > greatest(was * 0.015::DOUBLE, 0.5 * atr) THEN 1 ELSE 0 END) OVER (PARTITION BY market, ticker ORDER BY p) AS z FROM gaps),
zone AS (SELECT market, ticker, z, min(p) - 0.25 * max(atr) AS lo, max(p) + 0.25 * max(atr) AS hi, max(price) AS price, max(size) AS size FROM isl GROUP BY 1, 2, 3),
ins AS (SELECT zone.*, s.i, lag(s.i) OVER (PARTITION BY zone.market, zone.ticker, z ORDER BY s.i) AS was FROM zone
  JOIN swings s ON s.market = zone.market AND s.ticker = zone.ticker AND s.l <= hi AND s.h >= lo),
vis AS (SELECT market, ticker, z, lo, hi, price, size, count(*) FILTER (was IS NULL OR i - was > 3) AS touches, sum(CASE WHEN was IS NULL
  OR i - was > 3 THEN CASE WHEN i >= size - 63 THEN 2 ELSE 1 END ELSE 0 END) AS weighted, max(i) AS last FROM ins GROUP BY 1, 2, 3, 4, 5, 6, 7),
sided AS (SELECT *, (lo + hi) / 2 AS mid, CASE WHEN (lo + hi) / 2 < price THEN 'support' ELSE 'resistance' END AS side, weighted >= 3 AS strong FROM vis WHERE touches >= 2)
SELECT ticker, side, row_number() OVER (PARTITION BY market, ticker, side ORDER BY strong DESC, abs(mid - price), mid) AS place, round(lo, 6) AS lo,
  round(hi, 6) AS hi, touches, CAST(weighted AS BIGINT) AS weighted, strong, size - 1 - last AS last_touch FROM sided QUALIFY place <= 2""")
def support_resistance(spark, sf_dir):
    x = st.zones(bars(spark, sf_dir))
    return x.select("ticker", "side", F.col("place").cast("long").alias("place"), _r(F.col("lo"), "lo"), _r(F.col("hi"), "hi"), "touches", F.col("weighted").cast("long").alias("weighted"), "strong", F.col("last_touch").cast("long").alias("last_touch"))
