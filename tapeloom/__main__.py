"""Command line: python -m tapeloom list | sql NAME | run NAME | scan | backtest | grade | factors | ingest | walk.

scan, backtest, grade and factors read bars (market, ticker, d, o, h, l, c, v) from a Parquet folder and write Parquet
folders; ingest and walk keep the stored tables of a folder.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import config, registry
from tapeloom.functions import stage
from tapeloom.operators import board as bd
from tapeloom.operators import evaluation as ev
from tapeloom.operators import indicators as ind
from tapeloom.operators import market as mk
from tapeloom.operators import reads as rd
from tapeloom.operators import replay as rp
from tapeloom.operators import signals as sg
from tapeloom.sinks import archive, stores, upkeep


def scan(bars: DataFrame) -> dict[str, DataFrame]:
    """The board with its candidates' charts and gaps, what each market's light and breadth are, and the counts."""
    candidates = bd.candidates(bars)
    board = bd.capped(candidates)
    benchmark = mk.benchmark(bars)
    newest = ind.newest(ind.features(bars))
    charts = rd.candle_payload(bars.join(board.select(*bd.KEY), bd.KEY, "left_semi"), benchmark)
    return {
        "board": board.drop("checks"),
        "gaps": rd.gaps(ind.template(ind.with_rank(newest)).join(board.select(*bd.KEY), bd.KEY, "left_semi")),
        "candles": charts,
        "regime": mk.regime(mk.regime_frame(benchmark, bars)),
        "breadth": mk.breadth(newest),
        "counts": rd.bucket_counts(board),
    }


def backtest(bars: DataFrame, plans: Sequence[rp.Plan]) -> dict[str, DataFrame]:
    """Trades, statistics, equity and resampled risk of every plan, an independent portfolio per plan and market; features are worked out once."""
    by = ("plan", "market")
    features = sg.fired(sg.session_features(bars), sorted({p.strategy for p in plans}))
    trades, curve = rp.grid(features, plans)
    return {"trades": trades, "statistics": rp.statistics(trades, by), "equity": curve, "drawdown": rp.drawdown(curve, by), "risk": rp.bootstrap(trades, by=by)}


def selected(bars: DataFrame, markets: Sequence[str] = (), tickers: Sequence[str] = (), years: int | None = None, least: int = 0) -> DataFrame:
    """Bars of these markets and tickers (none named: all), of the years before each market's newest day, of tickers with least bars or more."""
    if markets:
        bars = bars.filter(F.col("market").isin(list(markets)))
    if tickers:
        bars = bars.filter(F.col("ticker").isin(list(tickers)))
    if years:
        last = bars.groupBy("market").agg(F.add_months(F.max("d"), -12 * years).alias("_since"))
        bars = bars.join(F.broadcast(last), "market").filter(F.col("d") > F.col("_since")).drop("_since")
    if least:
        bars = bars.join(bars.groupBy("market", "ticker").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n"), ["market", "ticker"], "left_semi")
    return bars


def plans_of(args: argparse.Namespace) -> list[rp.Plan]:
    """Every combination of the values given for strategy, stop, hold, risk and slots."""
    costs = {}
    for what in ("slip", "fee"):
        own = {m: v[what] for m, v in config.MARKETS.items()} | dict((m, float(x)) for m, x in (y.split("=", 1) for y in getattr(args, what)))
        costs[f"{what}s"] = tuple(own.items())
    out = []
    for strategy, stop, hold, risk, slots in product(args.strategy, args.stop, args.hold, args.risk, args.slots):
        name = f"{args.label} {strategy} stop={stop} hold={hold} risk={risk} slots={slots}".strip()
        out.append(rp.Plan(name, strategy, stop, hold, risk, slots, args.start, **costs))
    return out


def grade(signals: DataFrame, bars: DataFrame) -> dict[str, DataFrame]:
    """Outcomes of signals (market, ticker, d, kind, trigger, stop, target) and the scoreboard as of the newest bar."""
    outcomes = stage.written(ev.grade(signals, bars), "outcomes")
    newest = bars.agg(F.max("d")).first()[0]
    return {"outcomes": outcomes, "scoreboard": ev.scoreboard(outcomes, str(newest))}


def factors(rows: DataFrame, bars: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of forward returns by equal-count buckets of each factor of rows (market, ticker, d, and the factors)."""
    long = ev.unpivoted(ev.forward_returns(rows, bars), list(names))
    by = ("market", "factor")
    return {"factors": ev.factor_table(ev.buckets(long, "value", by=by), by)}


def ingest(spark: SparkSession, fresh: DataFrame, store: str) -> None:
    """One night: fresh bars over the stored ones, features and tails in step."""
    upkeep.night(stores.bars(spark, f"{store}/bars"), upkeep.tails(spark, f"{store}/tails"), upkeep.features(spark, f"{store}/features"), fresh)


def walk(spark: SparkSession, pages: DataFrame, store: str, name: str, base: str, since: str, most: int) -> DataFrame:
    """Walk captured feed pages (ticker, kind, page, html) into the stored archive, from where a walk of that name stopped."""
    tables = stores.news(spark, f"{store}/news"), archive.progress(spark, f"{store}/walks"), archive.found(spark, f"{store}/walked")
    return archive.walk(name, pages.select("ticker"), lambda asked: pages.join(asked, ["ticker", "kind", "page"], "left_semi"), *tables, base, since, most)


def _write(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        print(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tapeloom", description=__doc__)
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list", help="names of the registered queries")
    parts.add_parser("sql", help="a query's SQL").add_argument("name")
    run = parts.add_parser("run", help="run a registered query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="Parquet folder; without it, the first rows are shown")
    for name in ("scan", "backtest"):
        p = parts.add_parser(name)
        p.add_argument("--bars", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--market", nargs="*", default=[], help="only these markets")
        p.add_argument("--ticker", nargs="*", default=[], help="only these tickers")
        p.add_argument("--years", type=int, help="only so many years before the newest day")
        p.add_argument("--min-bars", type=int, default=0, help="only tickers with so many bars")
        if name == "backtest":
            p.add_argument("--strategy", nargs="*", default=["breakout"], choices=sg.STRATEGIES)
            p.add_argument("--stop", nargs="*", type=float, default=[config.STOP], help="fractions below the entry")
            p.add_argument("--hold", nargs="*", type=int, default=[config.MAX_HOLD], help="longest holds in bars")
            p.add_argument("--risk", nargs="*", type=float, default=[config.RISK], help="fractions of equity at risk in a trade")
            p.add_argument("--slots", nargs="*", type=int, default=[config.SLOTS], help="open trades at most")
            p.add_argument("--start", type=float, default=config.START, help="equity at the start")
            p.add_argument("--slip", nargs="*", default=[], metavar="MARKET=SHARE", help="slippage per side")
            p.add_argument("--fee", nargs="*", default=[], metavar="MARKET=SHARE", help="fee per side")
            p.add_argument("--label", default="", help="begins the names of the plans")
    p = parts.add_parser("grade")
    p.add_argument("--signals", required=True)
    p.add_argument("--bars", required=True)
    p.add_argument("--out", required=True)
    p = parts.add_parser("factors")
    p.add_argument("--rows", required=True)
    p.add_argument("--bars", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--factor", nargs="+", required=True)
    p = parts.add_parser("ingest")
    p.add_argument("--fresh", required=True)
    p.add_argument("--store", required=True)
    p = parts.add_parser("walk")
    p.add_argument("--pages", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--name", required=True, help="a walk that was stopped goes on under its name")
    p.add_argument("--base", required=True, help="address that links are relative to")
    p.add_argument("--since", required=True, help="the oldest day that is read")
    p.add_argument("--max-pages", type=int, default=15)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    if args.command == "sql":
        print(registry.ORACLE_SQL.get(args.name, "-- this query has no SQL"))
        return
    spark = SparkSession.builder.appName("tapeloom").getOrCreate()
    if args.command == "run":
        df = registry.QUERIES[args.name](spark, args.data)
        if args.out:
            _write({args.name: df}, args.out)
        else:
            df.show(50, truncate=False)
        return
    if args.command == "ingest":
        ingest(spark, spark.read.parquet(args.fresh), args.store)
        return
    if args.command == "walk":
        with stage.kept():
            walk(spark, spark.read.parquet(args.pages), args.store, args.name, args.base, args.since, args.max_pages).show(100, truncate=False)
        return
    if args.command in ("grade", "factors"):
        bars = spark.read.parquet(args.bars)
        with stage.kept():
            _write(grade(spark.read.parquet(args.signals), bars) if args.command == "grade" else factors(spark.read.parquet(args.rows), bars, args.factor), args.out)
        return
    bars = selected(spark.read.parquet(args.bars), args.market, args.ticker, args.years, args.min_bars)
    with stage.kept():
        _write(scan(bars) if args.command == "scan" else backtest(bars, plans_of(args)), args.out)


if __name__ == "__main__":
    main()
