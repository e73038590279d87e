"""Queries of chart patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import charts
from tapeloom.plans.indicators import _r
from tapeloom.plans.structures import BOTTOM_SQL, TOP_SQL, _swings_sql
from tapeloom.registry import query
from tapeloom.sources.panel import bars

_T = _swings_sql(120) + ", price AS (SELECT market, ticker, c AS price, n AS size FROM swings WHERE i = n - 1)"
CUP_SQL = """cup0 AS (SELECT *, greatest(0, n - 110) AS off, n - 10 - greatest(0, n - 110) AS m FROM swings WHERE n >= 60), cup1 AS (SELECT *, i - off AS j
  FROM cup0 WHERE m >= 40),
cup AS (SELECT market, ticker, max(m) AS m, max(h) FILTER (j >= 0 AND j < m // 4) AS rim, min(l) FILTER (j >= 0 AND j < m) AS low,
  max(c) FILTER (j = m - 1) AS rt, max(h) FILTER (i >= n - 10) AS hh, min(l) FILTER (i >= n - 10) AS hl, avg(v) FILTER (i >= n - 10) AS hv,
  avg(v) AS av FROM cup1 GROUP BY 1, 2),
cupat AS (SELECT cup.*, (SELECT min(j) FROM cup1 x WHERE x.market = cup.market AND x.ticker = cup.ticker AND j >= 0 AND j < cup.m AND x.l = cup.low) AS lowj FROM cup),
r_cup AS (SELECT market, ticker, 'cup and handle' AS name, rim AS pv FROM cupat WHERE (rim - low) / rim BETWEEN 0.12::DOUBLE AND 0.35::DOUBLE
  AND lowj BETWEEN m // 5 AND 4 * m // 5 AND rt >= rim * 0.95::DOUBLE AND (hh - hl) / hh <= 0.12::DOUBLE AND hv < av)"""
TIGHT_SQL = """pk AS (SELECT market, ticker, h AS peak, i AS pki FROM swings WHERE n >= 55 AND i >= n - 30 QUALIFY row_number() OVER (PARTITION BY market, ticker
  ORDER BY h DESC, i) = 1),
tf AS (SELECT market, ticker, max(peak) AS peak, count(*) FILTER (i >= pki - 40 AND i < pki) AS np, min(l) FILTER (i >= pki - 40 AND i < pki) AS base,
  avg(v) FILTER (i >= pki - 40 AND i < pki) AS pvol, min(l) FILTER (i >= pki) AS fl, avg(v) FILTER (i >= pki) AS fv,
  max(c) FILTER (i = n - 1) AS price FROM swings JOIN pk USING (market, ticker) WHERE n - 1 - pki BETWEEN 4 AND 15 GROUP BY 1, 2),
r_tight AS (SELECT market, ticker, 'high tight flag' AS name, peak AS pv FROM tf WHERE np >= 15 AND peak / base - 1 >= 0.9::DOUBLE
  AND (peak - fl) / peak <= 0.25 AND price >= peak * 0.78::DOUBLE AND fv < pvol)"""
FLAG_SQL = """bf AS (SELECT market, ticker, max(c) FILTER (i = n - 8) AS top, max(c) FILTER (i = n - 18) AS c18, max(c) FILTER (i = n - 23) AS c23,
  max(h) FILTER (i >= n - 8) AS fh, min(l) FILTER (i >= n - 8) AS fl, max(c) FILTER (i = n - 1) AS price FROM swings WHERE n >= 30 GROUP BY 1, 2),
r_flag AS (SELECT market, ticker, 'bull flag' AS name, fh AS pv FROM bf WHERE (top / c18 - 1 >= 0.2::DOUBLE OR top / c23 - 1 >= 0.2::DOUBLE)
  AND (fh - fl) / fh <= 0.1::DOUBLE AND price >= fl AND (market, ticker) NOT IN (SELECT (market, ticker) FROM r_tight))"""
TRI_SQL = """tri0 AS (SELECT market, ticker, count(*) FILTER (high) AS a, count(*) FILTER (low) AS b FROM swings WHERE n >= 45 GROUP BY 1, 2),
  tri1 AS (SELECT market, ticker, count(*) AS nh, max(h) AS top, min(h) AS lt FROM swings WHERE n >= 45 AND high AND i >= n - 60 GROUP BY 1, 2),
tri2 AS (SELECT market, ticker, l, lag(l) OVER (PARTITION BY market, ticker ORDER BY i) AS was FROM swings WHERE n >= 45 AND low AND i >= n - 60),
  tri3 AS (SELECT market, ticker, count(*) AS nl, bool_and(coalesce(l > was, true)) AS rising FROM tri2 GROUP BY 1, 2),
r_tri AS (SELECT market, ticker, 'ascending triangle' AS name, top AS pv FROM tri0 JOIN tri1 USING (market, ticker) JOIN tri3 USING (market, ticker)
  JOIN price USING (market, ticker) WHERE a >= 2 AND b >= 2 AND nh >= 2 AND nl >= 2 AND (top - lt) / top <= 0.02::DOUBLE AND rising
  AND price.price >= lt * 0.94::DOUBLE)"""
HEAD_SQL = """hs0 AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY i DESC) AS r FROM swings WHERE n >= 45 AND high),
hs AS (SELECT market, ticker, max(h) FILTER (r = 3) AS h1, max(i) FILTER (r = 3) AS i1, max(h) FILTER (r = 2) AS h2, max(h) FILTER (r = 1) AS h3,
  max(i) FILTER (r = 1) AS i3 FROM hs0 GROUP BY 1, 2),
nk AS (SELECT hs.*, (SELECT min(l) FROM swings s WHERE s.market = hs.market AND s.ticker = hs.ticker AND s.low AND s.i > i1 AND s.i < i3) AS neck FROM hs),
r_head AS (SELECT market, ticker, 'head and shoulders' AS name, neck AS pv FROM nk JOIN price USING (market, ticker) WHERE neck IS NOT NULL
  AND h2 > h1 * 1.03::DOUBLE AND h2 > h3 * 1.03::DOUBLE AND abs(h1 - h3) / h1 <= 0.04::DOUBLE AND i3 >= size - 30
  AND price.price < h2 * 0.97::DOUBLE)"""


@query(_T + ", " + ", ".join((CUP_SQL, TIGHT_SQL, FLAG_SQL, TRI_SQL, HEAD_SQL, BOTTOM_SQL, TOP_SQL)) + " SELECT ticker, name, round(pv, 6) AS pivot FROM (SELECT * FROM r_cup UNION ALL SELECT * FROM r_tight UNION ALL SELECT * FROM r_flag UNION ALL SELECT * FROM r_tri UNION ALL SELECT * FROM r_head UNION ALL SELECT market, ticker, 'double bottom', middle FROM r_bottom UNION ALL SELECT market, ticker, 'double top', middle FROM r_top)")
def chart_patterns(spark, sf_dir):
    return charts.chart_patterns(bars(spark, sf_dir)).select("ticker", "name", _r(F.col("pivot"), "pivot"))
