"""Portfolio replay in two phases, for one configuration or a grid of them.

How a trade ends depends on its entry, the prices and the exit rule alone, so every signal's trade is worked out first,
in parallel, once for each exit rule. Only admission (slots, cash, size) is sequential: one pass per configuration and
market over its candidate trades in the order of their entries, each with the closes it may be marked at, so that the
pass holds open positions only. Features are written once and read by all phases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions import stage

TRADES = "market string, ticker string, entry_s long, exit_s long, entry double, exit double, stop double, shares long, r double, held long, reason string, fees double"
EQUITY = "market string, s long, equity double"
#: Rows of admission: a trade, or with a null ticker the equity after a session.
ADMITTED = f"plan string, {TRADES}, s long, equity double"
#: Configurations of one grid: they travel with the plan.
MOST_PLANS = 10_000


@dataclass(frozen=True)
class Plan:
    """One configuration. risk is a fraction of equity; slips and fees are per side, by market (others pay those of US)."""

    name: str = "run"
    strategy: str = "signal"
    stop: float = config.STOP
    hold: int = config.MAX_HOLD
    risk: float = config.RISK
    slots: int = config.SLOTS
    start: float = config.START
    most: float = config.MAX_POSITION
    slips: tuple[tuple[str, float], ...] = tuple((m, v["slip"]) for m, v in config.MARKETS.items())
    fees: tuple[tuple[str, float], ...] = tuple((m, v["fee"]) for m, v in config.MARKETS.items())

    def __post_init__(self):
        if not 0 < self.stop < 1 or self.hold < 1 or self.slots < 0:
            raise ValueError(f"{self.name}: a stop between 0 and 1, a hold of at least 1, slots of at least 0")
        if "US" not in dict(self.slips) or "US" not in dict(self.fees):
            raise ValueError(f"{self.name}: costs of US stand for markets without their own")

    @property
    def rule(self) -> tuple:
        """What decides how a trade ends."""
        return (self.strategy, self.stop, self.hold, self.slips)


def _slim(features: DataFrame) -> DataFrame:
    """What replay reads of the features: bars with their number k and the strategies that fired on the session before."""
    fired = F.col("fired") if "fired" in features.columns else F.when(F.col("signal"), F.array(F.lit("signal"))).otherwise(F.array().cast("array<string>"))
    own = Window.partitionBy("market", "ticker").orderBy("s")
    x = features.select("market", "ticker", F.col("s").cast("long").alias("s"), "o", "l", "c", "ma50", fired.alias("fired"))
    was = F.when(F.lag("s").over(own) == F.col("s") - 1, F.lag("fired").over(own))
    return stage.written(x.select("market", "ticker", "s", "o", "l", "c", "ma50", F.row_number().over(own).alias("k"), was.alias("was")), "replay-features")


def _candidates(slim: DataFrame, plans: Sequence[Plan], marked: bool = False) -> DataFrame:
    """Trades by the index of their exit rule; marked, also with the sessions and closes from entry to exit."""
    rules = list(dict.fromkeys(p.rule for p in plans))
    life = max(hold for _, _, hold, _ in rules)
    of = F.array(*(
        F.struct(F.lit(i).alias("rule"), F.lit(name).alias("strategy"), F.lit(float(stop)).alias("stop_pct"), F.lit(hold).alias("hold"), F.create_map(*(F.lit(x) for m, v in slips for x in (m, float(v)))).alias("slips"))
        for i, (name, stop, hold, slips) in enumerate(rules)
    ))
    hits = slim.filter((F.size("was") > 0) & (F.col("o") > 0))
    hits = hits.withColumn("r", F.explode(F.filter(of, lambda y: F.array_contains("was", y.strategy))))
    fill = F.col("o") * (1 + F.coalesce(F.try_element_at("r.slips", "market"), F.try_element_at("r.slips", F.lit("US"))))
    entries = hits.select(
        F.col("r.rule").alias("rule"), F.col("r.hold").alias("hold"), "market", "ticker", F.col("s").alias("entry_s"), F.col("k").alias("k0"), fill.alias("entry"), (fill * (1 - F.col("r.stop_pct"))).alias("stop"),
        F.coalesce(F.col("o") >= F.col("ma50"), F.lit(False)).alias("armed0"), F.col("l").alias("l0"), F.col("c").alias("c0"),
    )
    key = ["rule", "market", "ticker", "k0"]
    # bars are dealt to stretches of a trade's longest life: a trade meets two of them
    stretches = entries.withColumn("stretch", F.explode(F.array_distinct(F.array(F.floor((F.col("k0") + 1) / life), F.floor((F.col("k0") + F.col("hold")) / life)))))
    later = slim.select("market", "ticker", F.col("s").alias("s1"), "k", "o", "l", "c", "ma50", F.floor(F.col("k") / life).alias("stretch"))
    path = stretches.join(later, ["market", "ticker", "stretch"]).filter((F.col("k") > F.col("k0")) & (F.col("k") <= F.col("k0") + F.col("hold")))
    w = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    armed = F.col("armed0") | F.coalesce(F.max(F.col("c") >= F.col("ma50")).over(w), F.lit(False))
    held = F.col("k") - F.col("k0")
    end = lambda reason, px: F.struct(F.lit(reason).alias("reason"), px.alias("px"))
    how = F.when(F.col("l") <= F.col("stop"), end("stop", F.least("stop", "o"))).when(armed & (F.col("c") < F.col("ma50")), end("ma50_break", F.col("c")))
    how = how.when(held >= F.col("hold"), end("time", F.col("c")))
    ends = path.withColumns({"how": how, "held": held})
    first = F.min(F.when(F.col("how").isNotNull(), F.struct("k", "s1", "held", "how"))).alias("x")
    if marked:
        ends = ends.groupBy(*key).agg(first, F.array_sort(F.collect_list(F.struct("s1", "c"))).alias("after"))
    else:
        ends = ends.filter("how is not null").groupBy(*key).agg(first)
    out = entries.join(ends, key, "left")
    at_once = F.col("l0") <= F.col("stop")
    marks = []
    if marked:
        own = F.struct(F.col("entry_s").alias("s1"), F.col("c0").alias("c"))
        lived = F.filter(F.coalesce("after", F.array().cast("array<struct<s1:long,c:double>>")), lambda y: ~at_once & (F.col("x").isNull() | (y["s1"] <= F.col("x.s1"))))
        every = F.concat(F.array(own), lived)
        marks = [every["s1"].alias("days"), every["c"].alias("closes")]
    return out.select(
        "rule", "market", "ticker", "entry_s", "entry", "stop",
        F.when(at_once, F.col("entry_s")).otherwise(F.col("x.s1")).alias("exit_s"),
        F.when(at_once, F.col("stop")).otherwise(F.col("x.how.px")).alias("px"),
        F.when(at_once, F.lit(0)).otherwise(F.col("x.held")).cast("long").alias("held"),
        F.when(at_once, F.lit("stop")).otherwise(F.col("x.how.reason")).alias("reason"), *marks,
    )


def candidates(features: DataFrame, max_hold: int = config.MAX_HOLD, stop_pct: float = config.STOP) -> DataFrame:
    """The trade each signal would make: filled at the next session's open with slippage, ended by the stop, the first close under an armed 50-day mean, or time.

    features: market, ticker, s, o, l, c, ma50, signal. A trade without an end runs to the data's end (exit null).
    A market without costs of its own pays those of US.
    """
    return _candidates(_slim(features), [Plan(hold=max_hold, stop=stop_pct)]).drop("rule")


class Book:
    """One portfolio over the sessions of its market: exits, then entries in ticker order, then the mark.

    Candidates are offered in the order of sessions and tickers; only open positions are held. trades and curve are its result.
    """

    def __init__(self, plan: Plan, market: str, first: int, last: int):
        slips, fees = dict(plan.slips), dict(plan.fees)
        self.plan, self.market, self.first, self.last, self.s = plan, market, first, last, first
        self.slip, self.fee = slips.get(market, slips["US"]), fees.get(market, fees["US"])
        self.cash = self.equity = plan.start
        self.open: dict[str, dict] = {}
        self.trades: list[tuple] = []
        self.curve: list[tuple] = []

    def _close(self, t: str, px: float, s: int, held: int, reason: str) -> None:
        p = self.open.pop(t)
        out = px * (1 - self.slip)
        fee = p["shares"] * out * self.fee
        self.cash += p["shares"] * out - fee
        self.trades.append((self.market, t, p["entry_s"], s, p["entry"], out, p["stop"], p["shares"], (out - p["entry"]) / (p["entry"] - p["stop"]), held, reason, fee))

    def _until(self, s: int) -> None:
        """On to session s: sessions passed are marked, and its exits done."""
        while self.s < s:
            if self.s > self.first:
                self.equity = self.cash + sum(p["shares"] * p["price"].get(self.s, p["entry"]) for p in self.open.values())
                self.curve.append((self.market, self.s, self.equity))
            self.s += 1
            for t in [t for t, p in self.open.items() if p["exit_s"] == self.s]:
                p = self.open[t]
                self._close(t, p["px"], self.s, p["held"], p["reason"])

    def full(self, s: int) -> bool:
        """Whether session s has been reached and takes no more entries."""
        return s == self.s and len(self.open) >= self.plan.slots

    def offer(self, ticker: str, s: int, entry: float, stop: float, exit_s: int | None, px: float, held: int, reason: str, days: Sequence[int], closes: Sequence[float]) -> None:
        """A candidate at session s, this one or a later one; days and closes: its ticker's bars from entry to exit."""
        self._until(s)
        if len(self.open) >= self.plan.slots or ticker in self.open:
            return
        shares = min(math.floor(self.equity * self.plan.risk / (entry - stop)), math.floor(self.equity * self.plan.most / entry))
        paid = shares * entry * (1 + self.fee)
        if shares <= 0 or paid > self.cash:
            return
        self.cash -= paid
        price = dict(zip(map(int, days), map(float, closes), strict=True))
        self.open[ticker] = {"entry_s": s, "entry": entry, "stop": stop, "exit_s": exit_s, "px": px, "held": held, "reason": reason, "shares": shares, "price": price}
        if exit_s == s:
            self._close(ticker, px, s, 0, "stop")

    def ended(self) -> Book:
        """The last session marked, and what is still open closed at the data's end."""
        self._until(self.last + 1)
        for t, p in list(self.open.items()):
            self._close(t, p["price"].get(self.last, p["entry"]), self.last, len(p["price"]) - 1, "end_of_data")
        return self


def admitted(features: DataFrame, plans: Sequence[Plan]) -> DataFrame:
    """Rows ADMITTED of each plan's independent portfolio per market.

    features: as for candidates(), with signal or with fired (the strategies that fired, for plans of several). Admission
    is sequential by nature: a plan's candidate trades of a market go through one task in order, with the closes inside
    them; other bars do not.
    """
    names = [p.name for p in plans]
    if not plans or len(plans) > MOST_PLANS or len(set(names)) < len(names):
        raise ValueError(f"from 1 to {MOST_PLANS} plans, each of its own name")
    slim = _slim(features)
    rules = {r: i for i, r in enumerate(dict.fromkeys(p.rule for p in plans))}
    by_rule = F.create_map(*(x for r, i in rules.items() for x in (F.lit(i), F.array(*(F.lit(p.name) for p in plans if p.rule == r)))))
    cands = _candidates(slim, plans, marked=True).withColumn("plan", F.explode(by_rule[F.col("rule")])).drop("rule")
    # a row without an entry opens each portfolio, with the first and the last session of its market
    edges = slim.groupBy("market").agg(F.min("s").alias("first"), F.max("s").alias("last")).withColumn("plan", F.explode(F.array(*(F.lit(n) for n in names))))
    rows = cands.unionByName(edges, allowMissingColumns=True)
    by_name = {p.name: p for p in plans}
    trade, point = ([y.split(" ")[0] for y in x.split(", ")] for x in (TRADES, EQUITY))
    every = [y.split(" ")[0] for y in ADMITTED.split(", ")]
    whole = {y.split(" ")[0]: "Int64" for y in ADMITTED.split(", ") if y.endswith(" long")}

    def told(book: Book) -> pd.DataFrame:
        both = pd.concat([pd.DataFrame(book.trades, columns=trade), pd.DataFrame(book.curve, columns=point)]).reindex(columns=every)
        both["plan"] = book.plan.name
        book.trades, book.curve = [], []
        return both.astype(whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = None
        for f in frames:
            for x in f.itertuples(index=False):
                if x.ticker is None:
                    if book:
                        yield told(book.ended())
                    book = Book(by_name[x.plan], x.market, int(x.first), int(x.last))
                elif not book.full(s := int(x.entry_s)):
                    exit_s = None if pd.isna(x.exit_s) else int(x.exit_s)
                    book.offer(x.ticker, s, x.entry, x.stop, exit_s, x.px, x.held, x.reason, x.days, x.closes)
        if book:
            yield told(book.ended())

    # one task reads a portfolio from end to end, a batch at a time; the sort that brings its rows in order spills to disk
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "plan", "market").sortWithinPartitions("plan", "market", F.asc_nulls_first("entry_s"), "ticker")
    return dealt.select("plan", "market", "ticker", "entry_s", "entry", "stop", "exit_s", "px", "held", "reason", "days", "closes", "first", "last").mapInPandas(run, ADMITTED)


def grid(features: DataFrame, plans: Sequence[Plan]) -> tuple[DataFrame, DataFrame]:
    """Trades and equity curves of all plans (with a column plan), from one pass that is written once."""
    rows = stage.written(admitted(features, plans), "replay-admitted")
    trade, point = ([y.split(" ")[0] for y in x.split(", ")] for x in (TRADES, EQUITY))
    return rows.filter("ticker is not null").select("plan", *trade), rows.filter("ticker is null").select("plan", *point)


def replay(features: DataFrame, risk: float = config.RISK, slots: int = config.SLOTS, start: float = config.START, most: float = config.MAX_POSITION, equity: bool = False) -> DataFrame:
    """Trades (or, with equity, the curve) of an independent portfolio per market. risk is a fraction of equity."""
    rows = admitted(features, [Plan(risk=risk, slots=slots, start=start, most=most)])
    kind = EQUITY if equity else TRADES
    return rows.filter("ticker is null" if equity else "ticker is not null").select(*(y.split(" ")[0] for y in kind.split(", ")))


def statistics(trades: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Per market: trades, win rate, expectancy, profit factor in R, mean win, loss and hold; nulls where undefined."""
    r = F.col("r")
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"),
        (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"),
        F.avg("r").alias("expectancy"),
        F.try_divide(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r <= 0, r)))).alias("profit_factor"),
        F.avg(F.when(r > 0, r)).alias("mean_win"),
        F.avg(F.when(r <= 0, r)).alias("mean_loss"),
        F.avg("held").alias("mean_hold"),
    )


def drawdown(curve: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Per market: final equity, the largest fall from a peak (per cent), and volatility and ratio of the session returns a year."""
    w = Window.partitionBy(*by).orderBy("s")
    x = curve.withColumns({"peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ret": F.col("equity") / F.lag("equity").over(w) - 1})
    sd, mean = F.stddev_samp("ret"), F.avg("ret")
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    return x.groupBy(*by).agg(
        F.max_by("equity", "s").alias("final_equity"), (F.min(F.col("equity") / F.col("peak") - 1) * 100).alias("max_drawdown"), (sd * math.sqrt(252) * 100).alias("volatility"), F.try_divide(mean, sd).alias("_a"), F.try_divide(mean, down).alias("_b")
    ).withColumns({"sharpe": F.col("_a") * math.sqrt(252), "sortino": F.col("_b") * math.sqrt(252)}).drop("_a", "_b")


#: Trades under which a resampled spread says nothing, and the trades of a year.
THIN, YEARLY = 20, 50
_MASK = (1 << 32) - 1
#: Two odd multipliers below 2^31: products of 32-bit counters stay within 64 bits.
_M1, _M2 = 0x7FEB352D, 0x2C1B3C6D


def scattered(x: np.ndarray) -> np.ndarray:
    """32 bits that look random of a 32-bit counter: shifts, xors and products, the same in any engine."""
    for multiplier, shift in ((_M1, 16), (_M2, 15)):
        x = ((x ^ (x >> shift)) * multiplier) & _MASK
    return x ^ (x >> 16)


def picks(draw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Which of n trades (from 0) stands at each place (a column each) of each draw (a row each)."""
    row = scattered((draw.astype(np.int64) + seed * 1_000_003) & _MASK)
    return (scattered((row[:, None] + np.arange(n)) & _MASK) * n) >> 32


def bootstrap(trades: DataFrame, risk: float = config.RISK, draws: int = 10_000, seed: int = 7, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Per market: percentiles of the yearly growth and of the worst fall over resampled orders of its trades, in per cent, and how often the worst reaches 25 and 50 % and the account halves.

    Markets of fewer than 20 trades are thin: no draws, nulls. A fall is from the highest point after a trade. Draws are
    numbers of a counter, not of a generator's state, so any engine draws the same, block by block and in any order. The
    trades of a market are bounded by its slots and sessions.
    """
    # read for the sizes and for the draws; the trades behind it are a whole replay
    rs = stage.written(trades.filter("r is not null").groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("rs")), "bootstrap-trades")
    sized = rs.select(*by, F.size("rs").cast("long").alias("trades"), (F.size("rs") < THIN).alias("thin"))
    rows = max(1, draws // 20)
    work = rs.filter(F.size("rs") >= THIN).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(rows)))).repartition(*by, "first")

    def run(frames):
        for f in frames:
            for x in f.to_dict("records"):
                of = np.asarray(x["rs"])
                path = np.cumprod(1 + risk * of[picks(np.arange(x["first"], min(x["first"] + rows, draws)), len(of), seed)], axis=1)
                fall = (path / np.maximum.accumulate(path, axis=1) - 1).min(axis=1)
                growth = np.maximum(path[:, -1], 0) ** (YEARLY / len(of)) - 1
                yield pd.DataFrame({c: x[c] for c in by} | {"final": path[:, -1], "growth": growth * 100, "fall": fall * 100})

    drawn = work.mapInPandas(run, ", ".join(f"{c} {dict(trades.dtypes)[c]}" for c in by) + ", final double, growth double, fall double")
    spread = [F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}") for c in ("growth", "fall") for p in (5, 50, 95)]
    often = {"fall_25": F.col("fall") <= -25, "fall_50": F.col("fall") <= -50, "halved": F.col("final") < 0.5}
    shares = [(F.count_if(v) / F.count("*") * 100).alias(k) for k, v in often.items()]
    found = drawn.groupBy(*by).agg(F.count("*").alias("_draws"), *spread, *shares)
    return sized.join(found, list(by), "left").withColumn("draws", F.coalesce("_draws", F.lit(0))).drop("_draws")
