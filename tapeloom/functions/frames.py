"""Window frames over a ticker's own bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def own() -> WindowSpec:
    """A ticker's bars in time; built on call, since a window needs a session."""
    return Window.partitionBy("market", "ticker").orderBy("d")


def newest_first() -> WindowSpec:
    return Window.partitionBy("market", "ticker").orderBy(F.col("d").desc())


def over(f: Callable[[Column], Column], x: Column | str, first: int, last: int = 0) -> Column:
    """f of x over the rows first..last around each bar, partial frames allowed."""
    return f(F.col(x) if isinstance(x, str) else x).over(own().rowsBetween(first, last))


def full(f: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """f of the last n bars, null until there are n values."""
    return F.when(over(F.count, x, 1 - n) == n, over(f, x, 1 - n))


def prior(f: Callable[[Column], Column], x: Column | str, n: int, gap: int = 1) -> Column:
    """f of the n bars that end gap bars ago, null until there are n values."""
    return F.when(over(F.count, x, 1 - n - gap, -gap) == n, over(f, x, 1 - n - gap, -gap))


def back(x: Column | str, n: int = 1) -> Column:
    return F.lag(F.col(x) if isinstance(x, str) else x, n).over(own())


def with_totals(df: DataFrame, *columns: str) -> DataFrame:
    """Running sum `_s_x` and count `_n_x` of each column, which mean() reads.

    A moving frame costs its length for every row, a difference of running sums the same for any length. Sums of prices
    in whole ticks are exact; of other doubles, a mean carries the rounding of the sum from a ticker's first bar on.
    """
    every = own().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: f(x).over(every) for x in columns for k, f in ((f"_s_{x}", F.sum), (f"_n_{x}", F.count))})


def mean(x: str, n: int, gap: int = 0) -> Column:
    """Mean of the n bars that end gap bars ago, null until there are n values."""

    def at(name: str, bars: int) -> Column:
        return F.coalesce(F.lag(name, bars).over(own()) if bars else F.col(name), F.lit(0))

    values = at(f"_n_{x}", gap) - at(f"_n_{x}", gap + n)
    return F.when(values == n, (at(f"_s_{x}", gap) - at(f"_s_{x}", gap + n)) / n)


#: Bars of a block of extreme().
BLOCK = 16


def block_extremes(df: DataFrame, **extremes: tuple[Callable[[Column], Column], str]) -> DataFrame:
    """Extremes `_b_name` of each bar's last BLOCK bars, which extreme() reads."""
    return df.withColumns({f"_b_{name}": over(f, x, 1 - BLOCK) for name, (f, x) in extremes.items()})


def extreme(name: str, largest: bool, n: int) -> Column:
    """The extreme of the last n bars (BLOCK or more; partial frames allowed) from those of blocks.

    A moving frame of an extreme looks at each of its bars again for every row; blocks n / BLOCK apart cover the same
    bars, the oldest overlapping the one before it.
    """
    backs = [*range(0, n - BLOCK, BLOCK), n - BLOCK]
    every = [F.lag(f"_b_{name}", k).over(own()) if k else F.col(f"_b_{name}") for k in dict.fromkeys(backs)]
    # a ticker's first bars have no block so far back, and a block at its start holds all of them
    return (F.greatest if largest else F.least)(*every) if len(every) > 1 else every[0]


def percentile_rank(x: str, *by: str) -> Column:
    """Rank over the non-null values as a share of their number, ties at their mean rank; one sort serves all of it."""
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(group))
