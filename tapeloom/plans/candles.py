"""Queries of candle patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import candles as cd
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars

_W = "OVER (PARTITION BY market, ticker ORDER BY d"
_NAMES = ("o", "h", "l", "c", "body", "white", "up", "lo", "top", "bot", "b10", "s10", "s5")


def _mean(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg({x}) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


CANDLES_SQL = BARS_SQL + f""",
shape AS (SELECT *, abs(c - o) AS body, c >= o AS white, greatest(o, c) AS top, least(o, c) AS bot, h - l AS span, h - greatest(o, c) AS up, least(o, c) - l AS lo FROM bars),
means AS (SELECT *, {_mean('body', 10)} AS b10, {_mean('span', 10)} AS s10, {_mean('span', 5)} AS s5 FROM shape),
x AS (SELECT *, {', '.join(f'lag({n}, {k}) {_W}) AS {n}{k}_' for n in _NAMES for k in (1, 2, 3))} FROM means),
flags AS (SELECT ticker, d,
  body1_ <= b101_ AND body2_ > b102_ AND body > b10 AND NOT white2_ AND top1_ < bot2_ AND white AND c > c2_ + 0.3::DOUBLE * body2_ AS morning_star,
  body1_ <= b101_ AND body2_ > b102_ AND body > b10 AND white2_ AND bot1_ > top2_ AND NOT white AND c < c2_ - 0.3::DOUBLE * body2_ AS evening_star,
  white AND white1_ AND white2_ AND up < 0.1::DOUBLE * s10 AND up1_ < 0.1::DOUBLE * s101_ AND up2_ < 0.1::DOUBLE * s102_ AND c > c1_ AND c1_ > c2_
    AND o > o1_ AND o <= c1_ + 0.2::DOUBLE * s51_ AND o1_ > o2_ AND o1_ <= c2_ + 0.2::DOUBLE * s52_
    AND body > body1_ - 0.6::DOUBLE * s51_ AND body1_ > body2_ - 0.6::DOUBLE * s52_ AND body > b10 AS three_white_soldiers,
  white3_ AND NOT white AND NOT white1_ AND NOT white2_ AND lo < 0.1::DOUBLE * s10 AND lo1_ < 0.1::DOUBLE * s101_ AND lo2_ < 0.1::DOUBLE * s102_
    AND o < o1_ AND o > c1_ AND o1_ < o2_ AND o1_ > c2_ AND h3_ > c2_ AND c2_ > c1_ AND c1_ > c AS three_black_crows,
  white AND NOT white1_ AND ((c >= o1_ AND o < c1_) OR (c > o1_ AND o <= c1_)) AS bullish_engulfing,
  NOT white AND white1_ AND ((o >= c1_ AND c < o1_) OR (o > c1_ AND c <= o1_)) AS bearish_engulfing,
  NOT white1_ AND body1_ > b101_ AND white AND body > b10 AND o < l1_ AND c < o1_ AND c > c1_ + 0.5 * body1_ AS piercing,
  white1_ AND body1_ > b101_ AND NOT white AND o > h1_ AND c > o1_ AND c < c1_ - 0.5 * body1_ AS dark_cloud_cover,
  body < b10 AND lo > body AND up < 0.1::DOUBLE * s10 AND bot <= l1_ + 0.2::DOUBLE * s51_ AS hammer,
  body < b10 AND up > body AND lo < 0.1::DOUBLE * s10 AND top < bot1_ AS inverted_hammer,
  body < b10 AND up > body AND lo < 0.1::DOUBLE * s10 AND bot > top1_ AS shooting_star,
  body < b10 AND lo > body AND up < 0.1::DOUBLE * s10 AND bot >= h1_ - 0.2::DOUBLE * s51_ AS hanging_man,
  NOT white1_ AND body1_ > b101_ AND body <= b10 AND top < top1_ AND bot > bot1_ AS bullish_harami,
  white1_ AND body1_ > b101_ AND body <= b10 AND top < top1_ AND bot > bot1_ AS bearish_harami,
  body <= 0.1::DOUBLE * s10 AS doji FROM x)"""


@query(CANDLES_SQL + f" SELECT ticker, d, {', '.join(f'coalesce({k}, false) AS {k}' for k in cd.PATTERNS)} FROM flags")
def candle_patterns(spark, sf_dir):
    return cd.candle_patterns(bars(spark, sf_dir)).select("ticker", "d", *cd.PATTERNS)


@query(CANDLES_SQL + f" SELECT ticker, d, array_to_string(names[1:{cd.MOST}], ',') AS patterns FROM (SELECT ticker, d, list_filter([{', '.join(f'CASE WHEN {k} THEN {k!r} END' for k in cd.PATTERNS)}], lambda z: z IS NOT NULL) AS names FROM flags) WHERE len(names) > 0")
def candles_shown(spark, sf_dir):
    return cd.shown(cd.candle_patterns(bars(spark, sf_dir))).select("ticker", "d", F.array_join("patterns", ",").alias("patterns"))
