"""Queries of the market's state and the weekly view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.operators import market as mk
from tapeloom.operators import weekly as wk
from tapeloom.plans.indicators import FEATURES_SQL, _r
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars

INDEX_SQL = BARS_SQL + """,
ix0 AS (SELECT market, d, sum(c) / count(c) AS c, sum(v) AS v FROM bars GROUP BY 1, 2),
ix AS (SELECT *, row_number() OVER w AS k, lag(c) OVER w AS c1, lag(v) OVER w AS v1 FROM ix0 WINDOW w AS (PARTITION BY market ORDER BY d)),
dist AS (SELECT a.market, a.d, CASE WHEN a.k >= 25 THEN (SELECT count(*) FROM ix b WHERE b.market = a.market AND b.k BETWEEN a.k - 24 AND a.k
  AND b.c < b.c1 * 0.998::DOUBLE AND b.v > b.v1 AND b.v1 > 0 AND a.c < b.c * 1.05::DOUBLE) END AS dist_days FROM ix a)"""


@query(INDEX_SQL + " SELECT market, d, dist_days FROM dist WHERE dist_days IS NOT NULL")
def distribution_days(spark, sf_dir):
    return mk.distribution(mk.benchmark(bars(spark, sf_dir))).filter("dist_days is not null").select("market", "d", F.col("dist_days").cast("long").alias("dist_days"))


#: The light of each market and day from two indices with the market's volume.
REGIME_SQL = BARS_SQL + """,
each AS (SELECT market, 'IX.ALL' AS ticker, d, c FROM bars UNION ALL SELECT market, 'IX.EVEN', d, c FROM bars WHERE CAST(substr(ticker, 7, 1) AS INTEGER) % 2 = 0),
total AS (SELECT market, d, sum(v) AS v FROM bars GROUP BY 1, 2),
ix0 AS (SELECT market, ticker, d, sum(c) / count(c) AS c FROM each GROUP BY 1, 2, 3),
ix AS (SELECT ix0.*, v, row_number() OVER w AS k, lag(c) OVER w AS c1, lag(v) OVER w AS v1, avg(c) OVER (w ROWS 49 PRECEDING) AS m50,
  avg(c) OVER (w ROWS 199 PRECEDING) AS m200, list(c) OVER (w ROWS 39 PRECEDING) AS cs, list(v) OVER (w ROWS 39 PRECEDING) AS vs
  FROM ix0 JOIN total USING (market, d) WINDOW w AS (PARTITION BY market, ticker ORDER BY d)),
dist AS (SELECT a.market, a.ticker, a.d, count(*) FILTER (b.c < b.c1 * 0.998::DOUBLE AND b.v > b.v1 AND b.v1 > 0 AND a.c < b.c * 1.05::DOUBLE) AS n
  FROM ix a JOIN ix b ON b.market = a.market AND b.ticker = a.ticker AND b.k BETWEEN a.k - 24 AND a.k WHERE a.k >= 200 GROUP BY 1, 2, 3),
lows AS (SELECT *, len(cs) AS n, list_position(cs, list_min(cs)) AS p FROM ix WHERE k >= 200),
rises AS (SELECT *, list_filter(range(p + 3, n + 1), lambda i: cs[i] / cs[i - 1] - 1 >= 0.015::DOUBLE AND vs[i] > vs[i - 1] AND vs[i - 1] > 0) AS hits FROM lows),
judged AS (SELECT market, ticker, d, CASE WHEN c > m50 THEN 1 ELSE 0 END + CASE WHEN c > m200 THEN 1 ELSE 0 END AS score, coalesce(p >= 6
  AND p < n - 2 AND list_min(cs) <= list_max(cs[1:p - 1]) * 0.94::DOUBLE AND hits[1] >= n - 4, false) AS ft FROM rises),
days AS (SELECT market, d, sum(score) AS score, 2 * count(*) AS checks, max(n) AS dist_days, bool_or(ft) AS recent_ft FROM judged
  JOIN dist USING (market, ticker, d) GROUP BY 1, 2),
first AS (SELECT *, CASE WHEN score = checks THEN 2 WHEN 2 * score >= checks THEN 1 ELSE 0 END AS g FROM days),
step AS (SELECT *, CASE WHEN dist_days >= 6 THEN greatest(0, g - 1) WHEN g = 0 AND recent_ft THEN 1 ELSE g END AS s FROM first),
regime AS (SELECT market, d, CASE s WHEN 2 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS light, CASE s WHEN 2 THEN 1.0 WHEN 1 THEN 0.5
  ELSE 0.0 END AS risk_pct, CAST(dist_days AS BIGINT) AS dist_days, recent_ft FROM step)"""


def regime(b):
    """The market's light by day, of its two stand-in indices."""
    return mk.regime(mk.regime_frame(mk.indices(b), b))


@query(REGIME_SQL + " SELECT market, d, light, risk_pct, dist_days, recent_ft FROM regime")
def regime_by_date(spark, sf_dir):
    return regime(bars(spark, sf_dir)).withColumn("dist_days", F.col("dist_days").cast("long"))


@query(INDEX_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM (SELECT market, d, c, v
  FROM ix QUALIFY row_number() OVER (PARTITION BY market ORDER BY d DESC) <= 40)),
u AS (SELECT *, lag(c) OVER (PARTITION BY market ORDER BY i) AS p, lag(v) OVER (PARTITION BY market ORDER BY i) AS q FROM t),
lo AS (SELECT market, i AS li, c AS lc FROM t QUALIFY row_number() OVER (PARTITION BY market ORDER BY c, i) = 1)
SELECT market, d, i - li + 1 AS day_of_rally, round((c / p - 1) * 100, 6) AS pct, i >= n - 5 AS recent FROM u JOIN lo USING (market) WHERE li >= 5
  AND li < n - 3 AND i >= li + 3 AND c / p - 1 >= 0.015::DOUBLE AND v > q AND q > 0
 AND lc <= (SELECT max(c) FROM t WHERE t.market = lo.market AND t.i < li) * 0.94::DOUBLE QUALIFY row_number() OVER (PARTITION BY market ORDER BY i) = 1""")
def follow_through_day(spark, sf_dir):
    x = mk.follow_through(mk.benchmark(bars(spark, sf_dir)))
    return x.select("market", "d", F.col("day_of_rally").cast("long").alias("day_of_rally"), _r(F.col("pct"), "pct"), "recent")


@query(FEATURES_SQL + """ SELECT market, round(count(*) FILTER (c > ma200) / count(*) * 100, 6) AS above_200, round(count(*) FILTER (c > ma50) / count(*) * 100,
  6) AS above_50, count(*) FILTER (c >= hi252 * 0.998::DOUBLE) AS new_highs, count(*) FILTER (c <= lo252 * 1.002::DOUBLE) AS new_lows,
  count(*) AS universe FROM newest WHERE k >= 200 GROUP BY market""")
def market_breadth(spark, sf_dir):
    x = mk.breadth(ind.newest(ind.features(bars(spark, sf_dir))))
    return x.select("market", _r(F.col("above_200"), "above_200"), _r(F.col("above_50"), "above_50"), "new_highs", "new_lows", "universe")


_LAG = ", ".join(f"lag(c, {n}) OVER (PARTITION BY market, industry ORDER BY d) AS c{n}" for n in (21, 63, 126, 189, 252))


@query(BARS_SQL + f""", g0 AS (SELECT market, substr(ticker, 7, 1) AS industry, d, sum(c) / count(c) AS c FROM bars GROUP BY 1, 2, 3 UNION ALL SELECT market, 'IX', d,
  sum(c) / count(c) FROM bars GROUP BY 1, 3),
g1 AS (SELECT *, row_number() OVER (PARTITION BY market, industry ORDER BY d) AS k, {_LAG} FROM g0),
g2 AS (SELECT *, c / c21 - 1 AS short, c / c63 - 1 AS long, 0.4::DOUBLE * (c / c63) + 0.2::DOUBLE * (c / c126) + 0.2::DOUBLE * (c / c189) + 0.2::DOUBLE * (c / c252) AS raw FROM g1 QUALIFY row_number() OVER (PARTITION BY market, industry ORDER BY d DESC) = 1),
g AS (SELECT a.*, a.short - coalesce(b.short, 0) AS s, a.long - coalesce(b.long, 0) AS l FROM g2 a JOIN g2 b ON b.market = a.market
  AND b.industry = 'IX' WHERE a.industry <> 'IX' AND a.k >= 260)
SELECT market, industry, round(raw, 4) AS rs_raw, round(s, 6) AS rel_short, round(l, 6) AS rel_long, CASE WHEN l >= 0 AND s >= 0 THEN 'leading'
  WHEN l >= 0 THEN 'weakening' WHEN s >= 0 THEN 'improving' ELSE 'lagging' END AS quadrant,
 s > l AND s > 0 AS rotating_in, s < l AND s < 0 AS rotating_out, row_number() OVER (PARTITION BY market ORDER BY raw DESC, industry) AS place FROM g""")
def sector_rotation(spark, sf_dir):
    b = bars(spark, sf_dir)
    newest = lambda x: ind.newest(ind.features(x))
    whole = newest(mk.group_bars(b.withColumn("industry", F.lit("IX"))))
    x = mk.rotation(newest(mk.group_bars(b.withColumn("industry", F.substring("ticker", 7, 1)))), whole)
    return x.select("market", F.col("ticker").alias("industry"), F.round("rs_raw", 4).alias("rs_raw"), _r(F.col("rel_short"), "rel_short"), _r(F.col("rel_long"), "rel_long"), "quadrant", "rotating_in", "rotating_out", F.col("place").cast("long").alias("place"))


WEEK_SQL = BARS_SQL + """,
wk0 AS (SELECT market, ticker, CAST(d + CAST((12 - isodow(d)) % 7 AS INTEGER) AS DATE) AS week, arg_min(o, d) AS o, max(h) AS h, min(l) AS l,
  arg_max(c, d) AS c, sum(v) AS v, max(d) AS last FROM bars GROUP BY 1, 2, 3),
wk AS (SELECT * FROM wk0 QUALIFY week < max(week) OVER (PARTITION BY market, ticker) OR last >= week),
facts AS (SELECT *, CASE WHEN count(c) OVER w = 30 THEN avg(c) OVER w END AS ma30w FROM wk WINDOW w AS (PARTITION BY market, ticker
  ORDER BY week ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
risen AS (SELECT *, coalesce(ma30w > lag(ma30w, 10) OVER (PARTITION BY market, ticker ORDER BY week), false) AS rising FROM facts)"""


@query(WEEK_SQL + " SELECT ticker, week, o, h, l, c, v, round(ma30w, 6) AS ma30w, rising FROM risen")
def weekly_bars(spark, sf_dir):
    return wk.weekly_facts(bars(spark, sf_dir)).select("ticker", "week", "o", "h", "l", "c", "v", _r(F.col("ma30w"), "ma30w"), "rising")


@query(WEEK_SQL + """, lagged AS (SELECT market, ticker, week, lag(ma30w) OVER (PARTITION BY market, ticker ORDER BY week) AS m, lag(rising) OVER (PARTITION BY market,
  ticker ORDER BY week) AS r FROM risen)
SELECT b.ticker, b.d, round(m, 6) AS ma30w, coalesce(r, false) AS rising, coalesce(b.c > m, false) AS above FROM bars b ASOF LEFT
  JOIN lagged ON b.market = lagged.market AND b.ticker = lagged.ticker AND b.d >= lagged.week""")
def weekly_aligned(spark, sf_dir):
    return wk.aligned(bars(spark, sf_dir)).select("ticker", "d", _r(F.col("ma30w"), "ma30w"), "rising", "above")
