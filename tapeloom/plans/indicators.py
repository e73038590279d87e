"""Queries of the rolling indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions.frames import full, over
from tapeloom.operators import indicators as ind
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars


def _full(f: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY market, ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {f}({x}) {frame} END"


def _w(lo: int, hi: int = 0) -> str:
    edge = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING"
    return f"OVER (PARTITION BY market, ticker ORDER BY d ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


OWN_SQL = "OVER (PARTITION BY market, ticker ORDER BY d)"
FEATURES_SQL = BARS_SQL + f""",
f0 AS (SELECT *, row_number() {OWN_SQL} AS k, {", ".join(f"{_full('avg', 'c', n)} AS ma{n}" for n in (10, 20, 50, 150, 200))},
  max(h) {_w(-251)} AS hi252, min(l) {_w(-251)} AS lo252, CASE WHEN count(v) {_w(-50, -1)} = 50 THEN avg(v) {_w(-50, -1)} END AS vol50,
  {", ".join(f"lag(c, {n}) {OWN_SQL} AS c{n}" for n in (1, 5, 6, 10, 20, 21, 63, 126, 189, 252))},
  lag(h) {OWN_SQL} AS h1, lag(l) {OWN_SQL} AS l1, lag(o) {OWN_SQL} AS o1, lag(v) {OWN_SQL} AS v1 FROM bars),
features AS (SELECT *, lag(ma200, 22) {OWN_SQL} AS ma200_22,
  CASE WHEN k >= 126 AND c63 IS NOT NULL THEN
    (coalesce(0.4::DOUBLE * (c / c63), 0) + coalesce(0.2::DOUBLE * (c / c126), 0) + coalesce(0.2::DOUBLE * (c / c189), 0) + coalesce(0.2::DOUBLE * (c / c252), 0))
    / (0.4::DOUBLE + CASE WHEN c126 IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN c189 IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN c252 IS NULL
  THEN 0 ELSE 0.2::DOUBLE END) END AS rs_raw FROM f0),
newest AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) = 1),
pct AS (SELECT *, CASE WHEN rs_raw IS NOT NULL THEN (rank() OVER (PARTITION BY market
  ORDER BY rs_raw ASC NULLS LAST) + (count(*) OVER (PARTITION BY market,
  rs_raw) - 1) / 2.0::DOUBLE) / count(rs_raw) OVER (PARTITION BY market) END AS rs_pct FROM newest),
ranked AS (SELECT *, CASE WHEN rs_raw IS NOT NULL THEN CAST(greatest(1, least(99, round_even(rs_pct * 99, 0))) AS INTEGER) END AS rs_rank FROM pct),
checked AS (SELECT *,
  CASE WHEN k >= 260 THEN c > ma150 AND c > ma200 WHEN k >= 152 THEN c > ma150 END AS t1, CASE WHEN k >= 260 THEN ma150 > ma200 END AS t2,
  CASE WHEN k >= 260 THEN coalesce(ma200 > ma200_22, false) END AS t3, CASE WHEN k >= 260 THEN ma50 > ma150 AND ma50 > ma200 WHEN k >= 152 THEN ma50 > ma150 END AS t4,
  c > ma50 AS t5, c >= lo252 * 1.30::DOUBLE AS t6, c >= hi252 * 0.75::DOUBLE AS t7, coalesce(rs_rank >= 70, false) AS t8 FROM ranked WHERE k >= 126),
templated AS (SELECT *, {" + ".join(f"coalesce(CAST(t{i} AS INTEGER), 0)" for i in range(1, 9))} AS passed,
  {" + ".join(f"CASE WHEN t{i} IS NULL THEN 0 ELSE 1 END" for i in range(1, 9))} AS total FROM checked)"""
R6 = "round({0}, 6) AS {1}"


def _features(spark, sf_dir):
    return ind.features(bars(spark, sf_dir))


def _newest(spark, sf_dir):
    return ind.newest(_features(spark, sf_dir))


def _templated(spark, sf_dir):
    return ind.template(ind.with_rank(_newest(spark, sf_dir)))


def _r(x, name):
    return F.round(x, 6).alias(name)


@query(BARS_SQL + " SELECT market, ticker, d, o, h, l, c, v FROM bars")
def panel_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query(BARS_SQL + f""", b AS (SELECT *, {_full('avg', 'c', 20)} AS mid, {_full('stddev_samp', 'c', 20)} AS sd FROM bars) SELECT ticker, d, round(mid, 6) AS mid,
  round(mid + 2 * sd, 6) AS upper, round(mid - 2 * sd, 6) AS lower, round(4 * sd / mid, 6) AS bandwidth FROM b""")
def bollinger_bands(spark, sf_dir):
    x = bars(spark, sf_dir).withColumn("mid", full(F.avg, "c", 20)).withColumn("sd", full(F.stddev_samp, "c", 20))
    return x.select("ticker", "d", _r(F.col("mid"), "mid"), _r(F.col("mid") + 2 * F.col("sd"), "upper"), _r(F.col("mid") - 2 * F.col("sd"), "lower"), _r(4 * F.col("sd") / F.col("mid"), "bandwidth"))


@query(FEATURES_SQL + " SELECT ticker, d, round(ma50, 6) AS ma50, round(ma150, 6) AS ma150, round(ma200, 6) AS ma200, round(ma200_22, 6) AS ma200_22 FROM features")
def moving_averages(spark, sf_dir):
    return _features(spark, sf_dir).select("ticker", "d", *(_r(F.col(x), x) for x in ("ma50", "ma150", "ma200", "ma200_22")))


@query(FEATURES_SQL + " SELECT market, ticker, round(rs_raw, 6) AS rs_raw, rs_rank FROM ranked")
def momentum_ranks(spark, sf_dir):
    return ind.with_rank(_newest(spark, sf_dir)).select("market", "ticker", _r(F.col("rs_raw"), "rs_raw"), "rs_rank")


RULES = ["price_above_150_200", "ma150_above_ma200", "ma200_rising_1m", "ma50_above_150_200", "price_above_ma50", "above_52w_low_30pct", "within_25pct_of_52w_high", "rs_rank_ge_70"]


@query(FEATURES_SQL + f""" SELECT ticker, {', '.join(f't{i + 1} AS {r}' for i, r in enumerate(RULES))}, passed, total, concat_ws(',',
  {', '.join(f'CASE WHEN NOT t{i + 1} THEN {chr(39)}{r}{chr(39)} END' for i, r in enumerate(RULES))}) AS failed, passed = total AS pass_all
  FROM templated""")
def trend_template(spark, sf_dir):
    return _templated(spark, sf_dir).select("ticker", "checks.*", "passed", "total", "failed", "pass_all")


@query(FEATURES_SQL + f", a AS (SELECT *, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM features) SELECT ticker, d, round({_full('avg', 'tr', 14)}, 6) AS atr FROM a")
def average_true_range(spark, sf_dir):
    x = _features(spark, sf_dir)
    return x.select("ticker", "d", _r(ind.atr(), "atr"))


@query(BARS_SQL + f" SELECT ticker, d, round(avg(h / l - 1) {_w(-19)} * 100, 6) AS adr_pct, round((max(h) {_w(-251)} - c) / max(h) {_w(-251)}, 6) AS below_high FROM bars")
def daily_range_and_high_distance(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "d", _r(over(F.avg, F.col("h") / F.col("l") - 1, -19) * 100, "adr_pct"), _r((over(F.max, "h", -251) - F.col("c")) / over(F.max, "h", -251), "below_high"))


@query(FEATURES_SQL + f""", s AS (SELECT *, c AS entry, greatest(min(l) {_w(-9)}, c * 0.92::DOUBLE) AS s0 FROM features) SELECT ticker, d, round(CASE WHEN s0 >= entry
  THEN entry * 0.92::DOUBLE ELSE s0 END, 6) AS stop FROM s""")
def suggested_stop(spark, sf_dir):
    floor = F.col("c") * 0.92
    x = _features(spark, sf_dir).withColumn("s0", F.greatest(over(F.min, "l", -9), floor))
    return x.select("ticker", "d", _r(F.when(F.col("s0") >= F.col("c"), floor).otherwise(F.col("s0")), "stop"))


PP_SQL = FEATURES_SQL + f", p AS (SELECT *, max(CASE WHEN c < c1 THEN v END) {_w(-10, -1)} AS most FROM features) SELECT ticker, d FROM p WHERE k >= 52 AND c > c1 AND c > ma50 AND h > l AND (c - l) >= 0.62::DOUBLE * (h - l) AND l <= ma10 * 1.02::DOUBLE AND v > most"


@query(PP_SQL)
def pocket_pivots(spark, sf_dir):
    return ind.pocket_pivot(_features(spark, sf_dir)).filter("pocket_pivot").select("ticker", "d")


def _bounce_sql(window, min_bars, lag, tag, span, cap):
    return FEATURES_SQL + f""",
b AS (SELECT *, lag(ma{window}, {lag}) {OWN_SQL} AS was, sum(CASE WHEN c > ma{window} THEN 1 ELSE 0 END) {_w(-39)} AS above,
  last_value(CASE WHEN l <= ma{window} * 1.005::DOUBLE THEN v END IGNORE NULLS) {_w(-tag, -1)} AS tag_v, min(l) {_w(1 - span)} AS stop FROM features)
SELECT ticker, d, round(stop, 6) AS stop, round((c - stop) / c * 100, 6) AS risk_pct FROM b
WHERE k >= {min_bars} AND ma{window} > was AND above >= 30 AND tag_v < vol50 AND c > c1 AND c > ma{window} AND h > l
  AND (c - l) >= 0.5::DOUBLE * (h - l) AND stop < c AND (c - stop) / c * 100 < {cap} + 0.05::DOUBLE"""


@query(_bounce_sql(20, 60, 5, 4, 6, 8.0))
def ma20_bounces(spark, sf_dir):
    return ind.bounce(_features(spark, sf_dir), 20, 60, 5, 4, 6, 8.0).filter("bounce").select("ticker", "d", _r(F.col("stop"), "stop"), _r(F.col("risk_pct"), "risk_pct"))


@query(_bounce_sql(50, 120, 10, 5, 7, 10.0))
def ma50_bounces(spark, sf_dir):
    return ind.bounce(_features(spark, sf_dir), 50, 120, 10, 5, 7, 10.0).filter("bounce").select("ticker", "d", _r(F.col("stop"), "stop"), _r(F.col("risk_pct"), "risk_pct"))


@query(FEATURES_SQL + """ SELECT ticker, d, round((h - l) / h * 100, 6) AS risk_pct FROM features WHERE k >= 70 AND vol50 > 0 AND h > l AND (o > h1
  OR (o / c1 - 1) * 100 >= 4) AND (c / c1 - 1) * 100 >= 6 AND v / vol50 >= 3 AND c >= o AND c1 / c63 <= 1.10::DOUBLE
  AND (h - l) / h * 100 < 12.05::DOUBLE""")
def episodic_pivots(spark, sf_dir):
    return ind.episodic_pivot(_features(spark, sf_dir)).filter("episodic").select("ticker", "d", _r(F.col("risk_pct"), "risk_pct"))


@query(FEATURES_SQL + """ SELECT ticker, d FROM features WHERE k >= 60 AND (c / c1 - 1) * 100 >= 4 AND v / vol50 >= 1.5 AND v > v1 AND abs(c1 / c6 - 1) <= 0.03::DOUBLE
  AND c <= ma20 * 1.15::DOUBLE""")
def momentum_bursts(spark, sf_dir):
    return ind.momentum_burst(_features(spark, sf_dir)).filter("burst").select("ticker", "d")


@query(FEATURES_SQL + f""", g AS (SELECT *, max(h) {_w(-9)} - min(l) {_w(-9)} AS r1, max(h) {_w(-19, -10)} - min(l) {_w(-19, -10)} AS r0, max(h) {_w(-39)} AS hi40
  FROM features) SELECT ticker, d, round(r1 / nullif(r0, 0), 6) AS ratio, coalesce(r0 > 0 AND r1 < 0.6::DOUBLE * r0 AND c >= hi40 * 0.90::DOUBLE,
  false) AS tight FROM g WHERE k >= 25""")
def tightening(spark, sf_dir):
    x = _features(spark, sf_dir).withColumns(ind.tightening()).filter("k >= 25")
    return x.select("ticker", "d", _r(F.try_divide("r1", "r0"), "ratio"), F.coalesce((F.col("r0") > 0) & (F.col("r1") < 0.6 * F.col("r0")) & (F.col("c") >= F.col("hi40") * 0.9), F.lit(False)).alias("tight"))


@query(FEATURES_SQL + f""", g AS (SELECT *, sum(CASE WHEN v > vol50 AND c > c1 THEN 1 ELSE 0 END) {_w(-23)} AS a, sum(CASE WHEN v > vol50 AND c < c1 THEN 1
  ELSE 0 END) {_w(-23)} AS b FROM features)
SELECT ticker, d, CAST(a AS BIGINT) AS accumulation, CAST(b AS BIGINT) AS distribution, CASE WHEN a >= b + 3 THEN 'accumulation' WHEN b >= a + 3
  THEN 'distribution' ELSE 'balanced' END AS verdict FROM g WHERE k >= 75""")
def volume_profiles(spark, sf_dir):
    return ind.volume_profile(_features(spark, sf_dir)).filter("k >= 75").select("ticker", "d", "accumulation", "distribution", "verdict")


@query(FEATURES_SQL + f""", g AS (SELECT *, max(h) {_w(-19)} AS hi, min(l) {_w(-19)} AS lo FROM features)
SELECT ticker, d, round((c / c5 - 1) * 100, 6) AS chg5, round((c / c20 - 1) * 100, 6) AS chg20, round(CASE WHEN hi > lo
  THEN (c - lo) / (hi - lo) * 100 ELSE 50 END, 6) AS place, round(c / c63 - 1, 6) AS momentum FROM g WHERE k > 21""")
def movement(spark, sf_dir):
    hi, lo = over(F.max, "h", -19), over(F.min, "l", -19)
    x = _features(spark, sf_dir).withColumn("hi", hi).withColumn("lo", lo).filter("k > 21")
    place = F.when(F.col("hi") > F.col("lo"), F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")) * 100).otherwise(F.lit(50.0))
    return x.select("ticker", "d", _r((F.col("c") / F.col("c5") - 1) * 100, "chg5"), _r((F.col("c") / F.col("c20") - 1) * 100, "chg20"), _r(place, "place"), _r(F.col("c") / F.col("c63") - 1, "momentum"))


@query(FEATURES_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY market, ticker) AS n FROM features),
b AS (SELECT *, greatest(coalesce(max(CASE WHEN c < ma200 AND k > n - 504 THEN k END) OVER (PARTITION BY market, ticker), 0), n - 504) AS start FROM n),
u AS (SELECT *, max(h) OVER (PARTITION BY market, ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM b WHERE k > start AND n >= 260),
i AS (SELECT *, sum(CASE WHEN peak IS NULL OR h > peak THEN 1 ELSE 0 END) OVER (PARTITION BY market, ticker ORDER BY d) AS i FROM u),
r AS (SELECT market, ticker, i, count(*) AS size FROM i GROUP BY ALL)
SELECT market, ticker, CAST(sum(size) AS BIGINT) AS sessions, CAST(CASE WHEN sum(size) < 20 THEN 0
  ELSE count(*) FILTER (size >= 16) END AS BIGINT) AS bases FROM r GROUP BY market, ticker""")
def base_counts(spark, sf_dir):
    return ind.base_count(_features(spark, sf_dir))


@query(FEATURES_SQL + """, g AS (SELECT market, substr(ticker, 7, 1) AS industry, median(rs_rank) AS m, count(*) AS n FROM ranked WHERE rs_rank IS NOT NULL GROUP BY 1,
  2 HAVING count(*) >= 3)
SELECT market, industry, n, round(m, 6) AS median_rank, CAST(greatest(1, least(99, round_even((rank() OVER (PARTITION BY market
  ORDER BY m) + (count(*) OVER (PARTITION BY market, m) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY market) * 99,
  0))) AS INTEGER) AS group_rank FROM g""")
def industry_group_ranks(spark, sf_dir):
    from tapeloom.operators.cross_section import group_ranks

    x = ind.with_rank(_newest(spark, sf_dir)).withColumn("industry", F.substring("ticker", 7, 1))
    return group_ranks(x, "industry").select("market", "industry", "n", _r(F.col("median_rank"), "median_rank"), "group_rank")


assert config.FULL_BARS == 260 and config.RANK_FLOOR == 55
