"""Queries of the board: setups, candidates, the capped board, entries inside bases, exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.operators import board as bd
from tapeloom.operators import exits
from tapeloom.operators import indicators as ind
from tapeloom.plans.indicators import FEATURES_SQL, _full, _r, _w
from tapeloom.plans.structures import VCP_SQL, _swings_sql
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars


def _floor(key: str) -> str:
    return f"CASE market {' '.join(f'WHEN {m!r} THEN {v[key]}::DOUBLE' for m, v in config.MARKETS.items())} END"


def _clamp(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


def _bounce_cte(n: int, least: int, lag: int, tag: int, span: int, cap: float) -> str:
    """Flag and stop of the newest bars: the nearest bar that touched the mean must be on light volume."""
    return f"""
m{n}w AS (SELECT *, lag(ma{n}, {lag}) OVER (PARTITION BY market, ticker ORDER BY d) AS was, sum(CASE WHEN c > ma{n} THEN 1 ELSE 0 END) {_w(-39)} AS above,
  last_value(CASE WHEN l <= ma{n} * 1.005::DOUBLE THEN v END IGNORE NULLS) {_w(-tag, -1)} AS tag_v, min(l) {_w(1 - span)} AS low FROM features),
m{n} AS (SELECT x.market, x.ticker, x.d, x.low AS stop{n}, coalesce(x.k >= {least} AND x.ma{n} > x.was AND x.above >= 30 AND x.tag_v < x.vol50
  AND x.c > x.c1 AND x.c > x.ma{n} AND x.h > x.l
  AND (x.c - x.l) >= 0.5::DOUBLE * (x.h - x.l) AND x.low < x.c AND (x.c - x.low) / x.c * 100 < {cap} + 0.05::DOUBLE, false) AS hit{n}
  FROM m{n}w x),"""


SETUP_SQL = FEATURES_SQL + _swings_sql(75)[len(BARS_SQL) :] + VCP_SQL + f""",
tr AS (SELECT *, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM features),
windows AS (SELECT market, ticker, d, max(h) {_w(-9)} - min(l) {_w(-9)} AS r1, max(h) {_w(-19, -10)} - min(l) {_w(-19, -10)} AS r0,
  max(h) {_w(-39)} AS hi40, min(l) {_w(-9)} AS low10, max(c) {_w(-9, -1)} AS best9,
  (max(h) {_w(-74)} - min(l) {_w(-74)}) / max(h) {_w(-74)} * 100 AS depth75, max(h) {_w(-4)} AS high5, min(l) {_w(-7)} AS low8,
  round(avg(h / l - 1) {_w(-19)} * 100, 2) AS adr, avg(c * v) {_w(-19)} AS value20, {_full('avg', 'tr', 14)} AS atr,
  sum(CASE WHEN v > vol50 AND c > c1 THEN 1 ELSE 0 END) {_w(-23)} AS accumulation, sum(CASE WHEN v > vol50 AND c < c1 THEN 1 ELSE 0 END) {_w(-23)} AS distribution FROM tr),""" + "".join(_bounce_cte(*x) for x in bd.BOUNCES.values()) + f"""
setups AS (SELECT * FROM templated JOIN windows USING (market, ticker, d) JOIN m20 USING (market, ticker, d) JOIN m50 USING (market, ticker, d)
  JOIN contractions USING (market, ticker)
  WHERE c >= {_floor('price')} AND value20 >= {_floor('value')} AND rs_rank >= {config.RANK_FLOOR} AND passed >= total - 2),
s1 AS (SELECT *, CASE WHEN c >= pvt * 0.8::DOUBLE THEN pvt END AS pv, passed = total AS pass_all, CASE WHEN vol50 > 0 THEN round(v / vol50,
  2) END AS vol_ratio, round(last, 1) AS tail,
  coalesce(k >= 70 AND vol50 > 0 AND h > l AND (o > h1 OR (o / c1 - 1) * 100 >= 4) AND (c / c1 - 1) * 100 >= 6 AND v / vol50 >= 3 AND c >= o
  AND c1 / c63 <= 1.10::DOUBLE AND (h - l) / h * 100 < 12.05::DOUBLE, false) AS episodic,
  coalesce(k >= 60 AND (c / c1 - 1) * 100 >= 4 AND v / vol50 >= 1.5 AND v > v1 AND abs(c1 / c6 - 1) <= 0.03::DOUBLE AND c <= ma20 * 1.15::DOUBLE, false) AS burst0,
  coalesce(k >= 25 AND r0 > 0 AND r1 < 0.6::DOUBLE * r0 AND c >= hi40 * 0.9::DOUBLE, false) AS tight FROM setups),
s2 AS (SELECT *, coalesce(round((c / pv - 1) * 100, 1) > 5, false) OR coalesce(round((c / ma50 - 1) * 100, 1) > 25, false) AS extended,
  coalesce(c / pvt - 1 BETWEEN {-config.BUY_BELOW}::DOUBLE AND {config.BUY_ABOVE}::DOUBLE, false) AS near,
  coalesce(k >= 12 AND best9 >= pv AND c < pv * 0.99::DOUBLE, false) AS failed_breakout, pass_all AND hit20 AS live20, pass_all AND hit50 AS live50, coalesce(pv, c) AS poc,
  CAST(round_even(greatest(0, least(100, 25 * {_clamp('(35 - depth75) / 20')} + CASE WHEN tail IS NULL THEN 0
  ELSE 25 * {_clamp('(12 - tail) / 9')} END + CASE WHEN vol50 > 0 THEN CASE WHEN dry_up THEN 15 ELSE 0 END + 15 * {_clamp('v / vol50 - 1')} ELSE 0 END
    + 20 * {_clamp('1 - (hi252 - coalesce(pvt, c)) / hi252 / 0.15::DOUBLE')})), 0) AS INTEGER) AS quality FROM s1),
s3 AS (SELECT *, CASE WHEN NOT pass_all THEN 'forming' WHEN vcp THEN CASE WHEN near AND NOT extended AND adr >= {_floor('adr')} THEN 'swing'
  ELSE 'watchlist' END WHEN contractions >= 2 THEN 'watchlist' ELSE 'position' END AS first,
  concat_ws(',', CASE WHEN NOT t5 THEN 'below_50ma' END, CASE WHEN failed_breakout THEN 'failed_breakout' END, CASE WHEN episodic THEN 'episodic_pivot_unverified' END) AS grave,
  concat_ws(',', CASE WHEN distribution >= accumulation + 3 THEN 'distribution' END, CASE WHEN c / c10 - 1 >= 0.25 THEN 'climax_run' END) AS light,
  CASE WHEN live20 OR live50 THEN c ELSE poc END AS entry, CASE WHEN greatest(low10, poc * 0.92::DOUBLE) >= poc THEN poc * 0.92::DOUBLE
  ELSE greatest(low10, poc * 0.92::DOUBLE) END AS stop0,
  k >= 30 AND c < pv * 0.98::DOUBLE AND c >= pv * 0.80::DOUBLE AND high5 < pv AND high5 > c * 0.995::DOUBLE AND low8 < high5 * 0.99::DOUBLE AS inside FROM s2),
candidates AS (SELECT *, CASE WHEN first = 'swing' AND grave <> '' THEN 'watchlist' ELSE first END AS bucket, CASE WHEN first = 'swing' THEN grave
  ELSE '' END AS demoted_by, concat_ws(',', nullif(grave, ''), nullif(light, '')) AS warnings,
  CASE WHEN live20 THEN 'ma20_bounce' WHEN live50 THEN 'ma50_bounce' ELSE 'breakout' END AS tactic, CASE WHEN live20 THEN stop20 WHEN live50 THEN stop50 ELSE stop0 END AS stop,
  CASE WHEN contractions >= 2 AND c < pv AND (pv - c) / pv <= 0.06::DOUBLE
  THEN CAST(round_even(30 * (1 - (pv - c) / pv / 0.06::DOUBLE) + 30 * {_clamp('(12 - tail) / 12')} + CASE WHEN dry_up THEN 20 ELSE 0 END + CASE
  WHEN tight THEN 20 ELSE 0 END, 0) AS INTEGER) END AS ready,
  coalesce(l > h1 AND vol_ratio >= 2 AND c > o AND c >= pv * 0.98::DOUBLE, false) AS gap_up, burst0 AND NOT episodic AS burst,
  CASE WHEN inside THEN high5 END AS early_trigger, CASE WHEN inside THEN CASE WHEN round((high5 - low8) / high5 * 100, 1) > 8
  THEN high5 * 0.94::DOUBLE ELSE low8 END END AS early_stop FROM s3),
board AS (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY CASE bucket WHEN 'swing' THEN quality ELSE rs_rank END DESC, ticker) AS place FROM candidates
  QUALIFY place <= CASE bucket {' '.join(f'WHEN {k!r} THEN {v}' for k, v in config.CAPS.items())} END)"""


@query(SETUP_SQL + """ SELECT market, ticker, bucket, place, rs_rank, quality, passed, total, tactic, round(entry, 6) AS entry, round(stop, 6) AS stop, round(c,
  6) AS price, round((hi252 - c) / hi252 * 100, 2) AS off_high FROM board""")
def board(spark, sf_dir):
    x = bd.board(bars(spark, sf_dir))
    off = F.round((F.col("hi252") - F.col("c")) / F.col("hi252") * 100, 2).alias("off_high")
    return x.select("market", "ticker", "bucket", F.col("place").cast("long").alias("place"), "rs_rank", "quality", "passed", "total", "tactic", _r(F.col("entry"), "entry"), _r(F.col("stop"), "stop"), _r(F.col("c"), "price"), off)


@query(SETUP_SQL + """ SELECT market, ticker, bucket, quality, coalesce(ready, -1) AS ready, extended, tactic, round(entry, 6) AS entry, round(stop, 6) AS stop,
  round(coalesce(CASE WHEN atr > 0 AND entry > stop THEN round((entry - stop) / atr, 2) END, -1), 2) AS stop_atr,
 round(coalesce(CASE WHEN entry > stop THEN entry + 2 * (entry - stop) END, -1), 6) AS target2r, round(coalesce(CASE WHEN entry > stop
  THEN entry + 3 * (entry - stop) END, -1), 6) AS target3r, warnings, demoted_by, gap_up, burst, round(coalesce(early_trigger, -1),
  6) AS early_trigger, round(coalesce(early_stop, -1), 6) AS early_stop,
 CASE WHEN entry > stop THEN CAST(floor(least(floor(1000.0::DOUBLE / (entry - stop)), floor(25000.0::DOUBLE / entry)) / CASE market WHEN 'MY'
  THEN 100 ELSE 1 END) AS BIGINT) * CASE market WHEN 'MY' THEN 100 ELSE 1 END ELSE 0 END AS shares FROM candidates""")
def candidate_dossiers(spark, sf_dir):
    x = bd.position_size(bd.candidates(bars(spark, sf_dir)), 100_000.0)
    none = {k: F.coalesce(k, F.lit(-1.0)) for k in ("stop_atr", "target2r", "target3r", "early_trigger", "early_stop")}
    priced = [_r(none[k] if k in none else F.col(k), k) for k in ("entry", "stop", *none)]
    return x.select("market", "ticker", "bucket", "quality", F.coalesce("ready", F.lit(-1)).alias("ready"), "extended", "tactic", *priced, "warnings", "demoted_by", "gap_up", "burst", "shares")


@query(FEATURES_SQL + f""", x AS (SELECT *, avg(c * v) {_w(-19)} AS value FROM features QUALIFY row_number() OVER (PARTITION BY market, ticker
  ORDER BY d DESC) = 1) SELECT market, ticker, round(value, 4) AS value FROM x WHERE c >= {_floor('price')} AND value >= {_floor('value')}""")
def liquidity_filter(spark, sf_dir):
    return bd.liquid(bd.setups(bars(spark, sf_dir))).select("market", "ticker", F.round("value20", 4).alias("value"))


@query(FEATURES_SQL + _swings_sql(75)[len(BARS_SQL) :] + VCP_SQL + f""", w AS (SELECT *, max(h) {_w(-4)} AS trig, min(l) {_w(-7)} AS low8 FROM features QUALIFY row_number() OVER (PARTITION BY market, ticker
  ORDER BY d DESC) = 1),
e AS (SELECT *, round((trig - low8) / trig * 100, 1) > 8 AS wide FROM w JOIN contractions USING (market, ticker) WHERE k >= 30
  AND c < pvt * 0.98::DOUBLE AND c >= pvt * 0.80::DOUBLE AND trig < pvt AND trig > c * 0.995::DOUBLE AND low8 < trig * 0.99::DOUBLE)
SELECT ticker, round(trig, 6) AS trigger_price, round(CASE WHEN wide THEN trig * 0.94::DOUBLE ELSE low8 END, 6) AS stop FROM e""")
def early_entries(spark, sf_dir):
    from tapeloom.operators import structures as st

    b = bars(spark, sf_dir)
    x = bd.setups(b).join(st.contractions(b), bd.KEY).withColumns(bd.early_entry(F.col("pivot"))).filter("early_trigger is not null")
    return x.select("ticker", _r(F.col("early_trigger"), "trigger_price"), _r(F.col("early_stop"), "stop"))


WEEKS_SQL = """, weeks AS (SELECT market, ticker, date_trunc('week', d) AS wk, arg_max(c, d) AS c, sum(v) AS v FROM bars GROUP BY 1, 2, 3),
placed_weeks AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY wk DESC) AS r, date_diff('week', wk,
  max(wk) OVER (PARTITION BY market, ticker)) AS ago FROM weeks),
dist_weeks AS (SELECT market, ticker, coalesce(count(*) >= 4 AND max(c) FILTER (r = 1) < max(c) FILTER (r = 2) AND max(c) FILTER (r = 2) < max(c) FILTER (r = 3) AND max(ago) >= 7
  AND sum(v) FILTER (ago <= 1) / 2 > coalesce(sum(v) FILTER (ago BETWEEN 2 AND 7), 0) / 6, false) AS distribution_weeks FROM placed_weeks GROUP BY 1, 2)"""


@query(BARS_SQL + WEEKS_SQL + " SELECT ticker, distribution_weeks FROM dist_weeks")
def distribution_weeks(spark, sf_dir):
    return exits.distribution_weeks(bars(spark, sf_dir)).select("ticker", "distribution_weeks")


@query(FEATURES_SQL + WEEKS_SQL + """, p AS (SELECT *, c10 * 1.02::DOUBLE AS pv, c5 AS entry, c5 * 0.92::DOUBLE AS stop, 5 AS held FROM newest JOIN dist_weeks USING (market, ticker)
  WHERE k >= 60)
SELECT ticker, held >= 5 AND c < entry * 1.02::DOUBLE AND c >= stop AS time_stop, c < stop AS stop_violated, c < ma50 AS below_50ma, entry >= pv
  AND c < pv AS failed_breakout, distribution_weeks, c / c10 - 1 >= 0.25 AS climax_run,
 entry >= pv * 0.97::DOUBLE AND c < pv * 0.99::DOUBLE AS line_failure, c >= pv * 1.15::DOUBLE AND held <= 21 AS sell_strength, vol50 > 0
  AND v > 1.5 * vol50 AS heavy_volume FROM p""")
def exit_signals(spark, sf_dir):
    b = bars(spark, sf_dir)
    x = ind.newest(ind.features(b)).filter("k >= 60").withColumns({"pivot": F.col("c10") * 1.02, "entry": F.col("c5"), "stop": F.col("c5") * 0.92, "held": F.lit(5)})
    return exits.exit_signals(x.join(exits.distribution_weeks(b), bd.KEY)).select("ticker", "signals.*", "heavy_volume")
