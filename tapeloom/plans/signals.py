"""Queries of the entry strategies."""

from __future__ import annotations

from tapeloom.operators import signals as sg
from tapeloom.registry import query
from tapeloom.sources.panel import SESSION_SQL, session_bars


def _fr(lo: int, hi: int = 0) -> str:
    edge = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING"
    return f"OVER (PARTITION BY market, ticker ORDER BY s RANGE BETWEEN {edge(lo)} AND {edge(hi)})"


def _fl(f: str, x: str, n: int, gap: int = 0) -> str:
    return f"CASE WHEN count({x}) {_fr(1 - n - gap, -gap)} = {n} THEN {f}({x}) {_fr(1 - n - gap, -gap)} END"


def _bk(x: str, n: int = 1) -> str:
    return f"max({x}) {_fr(-n, -n)}"


def _tm(flag: str, n: int) -> str:
    return f"CASE WHEN s >= {n} THEN sum(CASE WHEN {flag} THEN 1 ELSE 0 END) {_fr(1 - n)} END"


GRID_SQL = SESSION_SQL + f""",
days AS (SELECT market, d, row_number() OVER (PARTITION BY market ORDER BY d) AS s FROM (SELECT market, d, count(c) AS n FROM bars GROUP BY 1, 2)
  JOIN (SELECT market, count(DISTINCT ticker) AS m FROM bars GROUP BY 1) USING (market) WHERE n / m >= 0.2),
num AS (SELECT bars.*, s FROM bars JOIN days USING (market, d)),
g0 AS (SELECT *, {", ".join(f"{_fl('avg', 'c', n)} AS ma{n}" for n in (10, 20, 50, 150, 200))}, CASE WHEN count(h) {_fr(-251)} >= 126
  THEN max(h) {_fr(-251)} END AS hi52, CASE WHEN count(l) {_fr(-251)} >= 126 THEN min(l) {_fr(-251)} END AS lo52,
  {_fl('avg', 'v', 50, 1)} AS vol50, {", ".join(f"{_bk('c', n)} AS c{n}" for n in (1, 63, 64, 126, 189, 252))}, {_bk('h')} AS h1,
  {_fl('max', 'h', 25, 1)} AS pv, {_fl('max', 'h', 25, 2)} AS pv1 FROM num),
g1 AS (SELECT *, {_bk('ma200', 22)} AS ma200_22, CASE WHEN c63 IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN c126 IS NULL THEN 0
  ELSE 0.2::DOUBLE END + CASE WHEN c189 IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN c252 IS NULL THEN 0 ELSE 0.2::DOUBLE END AS wt,
  coalesce(0.4::DOUBLE * (c / c63), 0) + coalesce(0.2::DOUBLE * (c / c126), 0) + coalesce(0.2::DOUBLE * (c / c189), 0) + coalesce(0.2::DOUBLE * (c / c252), 0) AS tot FROM g0),
g2 AS (SELECT *, CASE WHEN wt > 0.39 THEN tot / wt END AS mom FROM g1),
g3 AS (SELECT *, CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY market, s
  ORDER BY mom ASC NULLS LAST) + (count(*) OVER (PARTITION BY market, s, mom) - 1) / 2.0::DOUBLE) / count(mom) OVER (PARTITION BY market,
  s) * 99 END AS rs_rank FROM g2),
grid AS (SELECT *, coalesce(c > ma150 AND c > ma200 AND ma150 > ma200 AND ma200 > ma200_22 AND ma50 > ma150 AND ma50 > ma200 AND c > ma50
  AND c >= lo52 * 1.30::DOUBLE AND c >= hi52 * 0.75::DOUBLE AND rs_rank >= 70, false) AS tt FROM g3)"""
_STRONG = "(c - l) >= 0.5::DOUBLE * (h - l)"


def _bounce(n: int, lag: int, tag: int) -> str:
    return f", z AS (SELECT *, {_bk(f'ma{n}', lag)} AS was, {_tm(f'c > ma{n}', 40)} AS above, CASE WHEN s > {tag} THEN max(CASE WHEN l <= ma{n} * 1.005::DOUBLE AND v < vol50 THEN 1 ELSE 0 END) {_fr(-tag, -1)} END AS light FROM grid) SELECT ticker, d FROM z WHERE tt AND ma{n} > was AND above >= 30 AND light > 0 AND c > c1 AND c > ma{n} AND {_STRONG}"


SQL = {
    "breakout": " SELECT ticker, d FROM grid WHERE tt AND c > pv AND c1 <= pv1 AND v > 1.4::DOUBLE * vol50",
    "ma20_bounce": _bounce(20, 5, 4),
    "ma50_bounce": _bounce(50, 10, 5),
    "episodic_pivot": " SELECT ticker, d FROM grid WHERE (o > h1 OR o >= c1 * 1.04::DOUBLE) AND c / c1 - 1 >= 0.06::DOUBLE AND v / vol50 >= 3 AND c >= o AND c1 / c64 <= 1.10::DOUBLE",
    "pocket_pivot": f", z AS (SELECT *, max(CASE WHEN c < c1 THEN v END) {_fr(-10, -1)} AS most FROM grid) SELECT ticker, d FROM z WHERE tt AND c > c1 AND c > ma50 AND h > l AND (c - l) >= 0.62::DOUBLE * (h - l) AND l <= ma10 * 1.02::DOUBLE AND v > most",
    "buyable_gap_up": " SELECT ticker, d FROM grid WHERE tt AND l > h1 AND v / vol50 >= 2 AND c > o AND c >= pv * 0.98::DOUBLE",
    "ma200_reclaim": f", z AS (SELECT *, {_tm('c < ma200', 90)} AS below, {_bk('ma200')} AS m1, {_bk('ma200', 20)} AS m20 FROM grid) SELECT ticker, d FROM z WHERE below >= 40 AND c > ma200 AND c1 <= m1 AND ma200 >= m20 * 0.98::DOUBLE AND v > 1.4::DOUBLE * vol50 AND {_STRONG}",
    "undercut_rally": f", y AS (SELECT *, {_fl('min', 'l', 40, 5)} AS low FROM grid), z AS (SELECT *, {_tm('l <= low', 5)} AS under FROM y) SELECT ticker, d FROM z WHERE under >= 1 AND c > low AND c1 <= low AND v > 1.2::DOUBLE * vol50 AND c > c1 AND {_STRONG}",
    "donchian": f", z AS (SELECT *, {_fl('max', 'h', 20, 1)} AS top, {_fl('max', 'h', 20, 2)} AS top1 FROM grid) SELECT ticker, d FROM z WHERE c > top AND c1 <= top1",
    "darvas": f", y AS (SELECT *, {_fl('max', 'h', 60, 10)} AS box FROM grid), z AS (SELECT *, {_bk('box')} AS box1, {_tm('h <= box', 10)} AS ins, {_tm('l >= box * 0.92::DOUBLE', 10)} AS onf FROM y) SELECT ticker, d FROM z WHERE c > box AND c1 <= box1 AND ins >= 9 AND onf >= 9 AND v > 1.4::DOUBLE * vol50",
}


def _register(strategy: str) -> None:
    @query(GRID_SQL + SQL[strategy], name=f"signals_{strategy}")
    def run(spark, sf_dir):
        return sg.signals(sg.session_features(session_bars(spark, sf_dir)), strategy).filter("signal").select("ticker", "d")


for _s in sg.STRATEGIES:
    _register(_s)


@query(GRID_SQL + " SELECT market, d, CAST(count(*) FILTER (tt) AS BIGINT) AS gated, round(max(rs_rank), 6) AS top_rank FROM grid GROUP BY 1, 2")
def trend_gate_by_day(spark, sf_dir):
    from pyspark.sql import functions as F

    return sg.session_features(session_bars(spark, sf_dir)).groupBy("market", "d").agg(F.count_if("tt").alias("gated"), F.round(F.max("rs_rank"), 6).alias("top_rank"))
