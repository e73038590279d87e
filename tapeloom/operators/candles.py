"""Candle patterns of one to four bars by their public definitions, on every bar.

Sizes are relative: a body is long or short against the mean body of the ten bars before its own, a doji against a
tenth of their mean range; a shadow is long against its own body and negligible against a tenth of the mean range; near
and far are a fifth and three fifths of the mean range of the five bars before. A bar that closes at its open is white.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.frames import back, prior

# Shares of the mean range (doji, negligible shadow, near, far), and how far a body must be entered.
DOJI, NEGLIGIBLE, NEAR, FAR, STAR_DEPTH, CLOUD_DEPTH = 0.1, 0.1, 0.2, 0.6, 0.3, 0.5
# The patterns in order of weight, with their bias; a bar shows four at most.
PATTERNS = {
    "morning_star": 1, "evening_star": -1, "three_white_soldiers": 1, "three_black_crows": -1, "bullish_engulfing": 1, "bearish_engulfing": -1, "piercing": 1, "dark_cloud_cover": -1,
    "hammer": 1, "inverted_hammer": 1, "shooting_star": -1, "hanging_man": -1, "bullish_harami": 1, "bearish_harami": -1, "doji": 0,
}
MOST = 4


def shaped(bars: DataFrame) -> DataFrame:
    """Bars with body, white, upper and lower shadow, top and bottom of the body, and the means they are measured by."""
    o, c = F.col("o"), F.col("c")
    x = bars.withColumns({"body": F.abs(c - o), "white": c >= o, "top": F.greatest(o, c), "bottom": F.least(o, c), "span": F.col("h") - F.col("l")})
    x = x.withColumns({"upper": F.col("h") - F.col("top"), "lower": F.col("bottom") - F.col("l")})
    return x.withColumns({"body10": prior(F.avg, "body", 10), "span10": prior(F.avg, "span", 10), "span5": prior(F.avg, "span", 5)})


def candle_patterns(bars: DataFrame) -> DataFrame:
    """market, ticker, d and a flag per pattern; false where a mean that it needs has too few bars."""
    x = shaped(bars)
    names = ("o", "h", "l", "c", "body", "white", "upper", "lower", "top", "bottom", "body10", "span10", "span5")
    x = x.withColumns({f"{n}_{k}": back(n, k) for n in names for k in (1, 2, 3)})

    def at(name: str, k: int = 0) -> Column:
        return F.col(f"{name}_{k}" if k else name)

    def black(k: int = 0) -> Column:
        return ~at("white", k)

    def long(k: int = 0) -> Column:
        return at("body", k) > at("body10", k)

    def bare(side: str, k: int = 0) -> Column:
        return at(side, k) < NEGLIGIBLE * at("span10", k)

    small = at("body") < at("body10")
    gap_up, gap_down = at("bottom") > at("top", 1), at("top") < at("bottom", 1)
    inside = (at("top") < at("top", 1)) & (at("bottom") > at("bottom", 1)) & long(1) & (at("body") <= at("body10"))
    pole_down = small & (at("lower") > at("body")) & bare("upper")
    pole_up = small & (at("upper") > at("body")) & bare("lower")
    swallowed = lambda a, b: ((a >= at("o", 1)) & (b < at("c", 1))) | ((a > at("o", 1)) & (b <= at("c", 1)))
    soldiers = [at("white", k) & bare("upper", k) for k in (0, 1, 2)]
    soldiers += [(at("c", k) > at("c", k + 1)) & (at("o", k) > at("o", k + 1)) & (at("o", k) <= at("c", k + 1) + NEAR * at("span5", k + 1)) & (at("body", k) > at("body", k + 1) - FAR * at("span5", k + 1)) for k in (0, 1)]
    crows = [black(k) & bare("lower", k) for k in (0, 1, 2)] + [(at("o", k) < at("o", k + 1)) & (at("o", k) > at("c", k + 1)) & (at("c", k) < at("c", k + 1)) for k in (0, 1)]

    def all_of(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out &= p
        return out

    star = (at("body", 1) <= at("body10", 1)) & long(2) & long()
    found = {
        "morning_star": star & black(2) & (at("top", 1) < at("bottom", 2)) & at("white") & (at("c") > at("c", 2) + STAR_DEPTH * at("body", 2)),
        "evening_star": star & at("white", 2) & (at("bottom", 1) > at("top", 2)) & black() & (at("c") < at("c", 2) - STAR_DEPTH * at("body", 2)),
        "three_white_soldiers": all_of(soldiers) & long(),
        "three_black_crows": all_of(crows) & at("white", 3) & (at("h", 3) > at("c", 2)),
        "bullish_engulfing": at("white") & black(1) & swallowed(at("c"), at("o")),
        "bearish_engulfing": black() & at("white", 1) & (((at("o") >= at("c", 1)) & (at("c") < at("o", 1))) | ((at("o") > at("c", 1)) & (at("c") <= at("o", 1)))),
        "piercing": black(1) & long(1) & at("white") & long() & (at("o") < at("l", 1)) & (at("c") < at("o", 1)) & (at("c") > at("c", 1) + CLOUD_DEPTH * at("body", 1)),
        "dark_cloud_cover": at("white", 1) & long(1) & black() & (at("o") > at("h", 1)) & (at("c") > at("o", 1)) & (at("c") < at("c", 1) - CLOUD_DEPTH * at("body", 1)),
        "hammer": pole_down & (at("bottom") <= at("l", 1) + NEAR * at("span5", 1)),
        "inverted_hammer": pole_up & gap_down,
        "shooting_star": pole_up & gap_up,
        "hanging_man": pole_down & (at("bottom") >= at("h", 1) - NEAR * at("span5", 1)),
        "bullish_harami": inside & black(1),
        "bearish_harami": inside & at("white", 1),
        "doji": at("body") <= DOJI * at("span10"),
    }
    return x.select("market", "ticker", "d", *(F.coalesce(found[k], F.lit(False)).alias(k) for k in PATTERNS))


def shown(patterns: DataFrame) -> DataFrame:
    """market, ticker, d, patterns: the names that a bar shows, weightiest first, four at most; bars without any have no row."""
    names = F.slice(F.array_compact(F.array(*(F.when(F.col(k), k) for k in PATTERNS))), 1, MOST)
    return patterns.select("market", "ticker", "d", names.alias("patterns")).filter(F.size("patterns") > 0)
