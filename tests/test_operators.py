"""Properties and small hand-made cases of the screening operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.operators import board as bd
from tapeloom.operators import candles as cd
from tapeloom.operators import enrich as en
from tapeloom.operators import evaluation as ev
from tapeloom.operators import exits
from tapeloom.operators import fundamentals as fu
from tapeloom.operators import indicators as ind
from tapeloom.operators import market as mk
from tapeloom.operators import receipts as rc
from tapeloom.operators import replay as rp
from tapeloom.operators import signals as sg
from tapeloom.operators import storage as st
from tapeloom.operators import structures as sx
from tapeloom.operators import weekly as wk
from tapeloom.sources import vendor as vd

DAY = dt.date(2020, 1, 1)
BARS = "market string, ticker string, d date, o double, h double, l double, c double, v double"


def _bars(spark, paths, market="US"):
    rows = [(market, t, DAY + dt.timedelta(days=k), c * 0.995, c * 1.01, c * 0.99, float(c), 1e6) for t, p in paths.items() for k, c in enumerate(p) if c is not None]
    return spark.createDataFrame(rows, BARS)


def test_flat_series_scores_one(spark):
    x = ind.newest(ind.features(_bars(spark, {"A": [10.0] * 300}))).first()
    assert x["rs_raw"] == pytest.approx(1.0)


def test_short_history_has_no_score_and_no_template(spark):
    x = ind.with_rank(ind.newest(ind.features(_bars(spark, {"A": [10.0] * 100}))))
    assert x.first()["rs_raw"] is None and ind.template(x).count() == 0


def test_ranks_are_bounded_and_follow_the_score(spark):
    paths = {f"T{k:02}": [10 * (1 + 0.0005 * k) ** i for i in range(260)] for k in range(40)}
    x = ind.with_rank(ind.newest(ind.features(_bars(spark, paths)))).orderBy("rs_raw").select("rs_rank").toPandas()["rs_rank"]
    assert x.between(1, 99).all() and x.is_monotonic_increasing


def test_young_stock_gets_a_reduced_template(spark):
    x = ind.template(ind.with_rank(ind.newest(ind.features(_bars(spark, {"A": [10 + 0.1 * i for i in range(140)]}))))).first()
    assert x["total"] == 4 and x["checks"]["ma150_above_ma200"] is None


def test_edges_are_no_swings(spark):
    p = [20.0] * 6 + [30.0] + [20.0] * 6 + [40.0]
    x = sx.swings(_bars(spark, {"A": p}), 120).filter("high").select("i").toPandas()["i"].tolist()
    assert 6 in x and 13 not in x and min(x) >= 5


def test_upper_case_zero_volume_and_equal_high_low_do_not_break_candles(spark):
    rows = [("US", "A", DAY + dt.timedelta(days=k), 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(20)]
    x = sx.candle_shapes(ind.features(spark.createDataFrame(rows, BARS)))
    assert x.filter("doji or hammer").count() == 0


def test_weeks_end_on_friday_and_unfinished_ones_go(spark):
    x = wk.to_weekly(_bars(spark, {"A": [10.0] * 13})).orderBy("week").toPandas()
    assert all(w.weekday() == 4 for w in x["week"]) and x["last"].max() <= x["week"].max()


def test_later_bars_never_change_weekly_facts(spark):
    r = random.Random(1)
    p = [10 + r.random() for _ in range(400)]
    whole = wk.aligned(_bars(spark, {"A": p})).filter(F.col("d") < DAY + dt.timedelta(days=300)).orderBy("d").toPandas()
    cut = wk.aligned(_bars(spark, {"A": p[:300]})).orderBy("d").toPandas()
    pd.testing.assert_frame_equal(whole, cut)


def test_regime_uses_bars_up_to_the_day(spark):
    r = random.Random(2)
    p = [10 + 0.02 * i + r.random() for i in range(300)]
    b = _bars(spark, {"A": p, "B": p[::-1]})
    whole = mk.regime(mk.benchmark(b)).filter(F.col("d") < DAY + dt.timedelta(days=250)).orderBy("d").select("d", "light").toPandas()
    cut = mk.regime(mk.benchmark(b.filter(F.col("d") < DAY + dt.timedelta(days=250)))).orderBy("d").select("d", "light").toPandas()
    pd.testing.assert_frame_equal(whole, cut)


def _index(spark, paths, volume=None):
    rows = [("US", t, DAY + dt.timedelta(days=k), float(c), float((volume or {}).get(k, 1000.0))) for t, p in paths.items() for k, c in enumerate(p)]
    return spark.createDataFrame(rows, "market string, ticker string, d date, c double, v double")


def test_every_index_has_to_agree_for_green(spark):
    up, down = [100 + 0.5 * i for i in range(230)], [100 + 0.5 * i for i in range(200)] + [150 - 3 * i for i in range(30)]
    last = lambda x: mk.regime(x).orderBy(F.desc("d")).first()["light"]
    assert last(_index(spark, {"A": up})) == "green"
    assert last(_index(spark, {"A": up, "B": down})) == "yellow"
    assert last(_index(spark, {"B": down})) == "red"


def test_a_recent_follow_through_lifts_red_to_yellow_but_not_under_distribution(spark):
    fall = [200 - 0.4 * i for i in range(220)] + [112 - 2.5 * i for i in range(10)]
    rally = [*fall, 90.0, 90.5, 91.0, 93.0]
    day = len(rally) - 1
    assert mk.regime(_index(spark, {"A": rally}, {day: 2000.0})).orderBy(F.desc("d")).first()["light"] == "yellow"
    assert mk.regime(_index(spark, {"A": rally})).orderBy(F.desc("d")).first()["light"] == "red"
    heavy = {k: 1000.0 + 10 * k for k in range(day)} | {day: 99_999.0}
    x = mk.regime(_index(spark, {"A": rally}, heavy)).orderBy(F.desc("d")).first()
    assert x["recent_ft"] and x["dist_days"] >= 6 and x["light"] == "red"


def test_market_volume_is_grafted_onto_the_index(spark):
    b = _bars(spark, {"A": [10.0] * 5, "B": [None, None, 20.0, 20.0, None]})
    x = mk.regime_frame(_index(spark, {"IX": [1.0] * 7}), b).orderBy("d").select("v").toPandas()["v"].tolist()
    assert x == [1e6, 1e6, 2e6, 2e6, 1e6, 1e6, 1e6]


def _weeks(spark, closes, volumes):
    rows = [("US", "A", dt.date(2020, 1, 6) + dt.timedelta(days=7 * k), *[float(c)] * 4, float(v)) for k, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return exits.distribution_weeks(spark.createDataFrame(rows, BARS)).first()["distribution_weeks"]


def test_two_falling_weeks_on_more_volume_are_distribution(spark):
    assert _weeks(spark, [10, 10, 10, 10, 10, 10, 9, 8], [1] * 6 + [2, 2])
    assert not _weeks(spark, [10, 10, 10, 10, 10, 10, 9, 8], [1] * 8)
    assert not _weeks(spark, [10, 10, 10, 10, 10, 8, 9, 8], [1] * 6 + [2, 2])
    assert not _weeks(spark, [10, 10, 9, 8], [1, 1, 2, 2])


def _setup(spark, **change):
    """A complete base inside the buy window, with some columns changed."""
    row = dict(
        market="US", ticker="A", k=300, o=99.0, h=101.0, l=98.0, c=100.0, v=1e6, h1=99.0, c10=95.0, ma50=95.0, vol50=1e6, hi252=105.0, pivot=101.0, depths=[20.0, 10.0, 5.0], dry_up=True, vcp=True, r0=10.0, r1=9.0, hi40=104.0, low10=94.0, best9=99.0, depth75=15.0, high5=100.5,
        low8=97.0, adr=3.0, atr=2.0, accumulation=1, distribution=1, pass_all=True, episodic=False, burst=False, ma20_bounce=False, ma20_stop=97.0, ma50_bounce=False, ma50_stop=96.0, price_above_ma50=True,
    ) | change
    kinds = {"market": "string", "ticker": "string", "k": "int", "depths": "array<double>", "accumulation": "long", "distribution": "long"}
    kind = lambda n, v: kinds.get(n) or ("boolean" if n in ("dry_up", "vcp", "pass_all", "episodic", "burst", "ma20_bounce", "ma50_bounce", "price_above_ma50") else "double")
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {kind(n, v)}" for n, v in row.items()))
    return bd.judge(df.withColumn("checks", F.struct("price_above_ma50"))).first()


def test_buckets_follow_base_window_range_and_warnings(spark):
    assert _setup(spark)["bucket"] == "swing"
    assert _setup(spark, pass_all=False)["bucket"] == "forming"
    assert _setup(spark, adr=1.0)["bucket"] == "watchlist"
    assert _setup(spark, pivot=97.0)["bucket"] == "watchlist"  # 3 % above: chasing
    assert _setup(spark, vcp=False)["bucket"] == "watchlist" and _setup(spark, vcp=False, depths=[5.0])["bucket"] == "position"
    x = _setup(spark, pivot=102.0, best9=102.5)
    assert (x["bucket"], x["demoted_by"], x["failed_breakout"]) == ("watchlist", "failed_breakout", True)
    assert _setup(spark, episodic=True, burst=True)["demoted_by"] == "episodic_pivot_unverified"


def test_a_live_bounce_decides_entry_and_stop(spark):
    x = _setup(spark)
    assert (x["tactic"], x["entry"], x["stop"]) == ("breakout", 101.0, 94.0)
    x = _setup(spark, ma20_bounce=True, ma50_bounce=True)
    assert (x["tactic"], x["entry"], x["stop"], x["target2r"]) == ("ma20_bounce", 100.0, 97.0, 106.0)
    assert _setup(spark, ma20_bounce=True, pass_all=False)["tactic"] == "breakout"
    far = _setup(spark, pivot=130.0)
    assert far["pv"] is None and far["entry"] == 100.0


def test_burst_yields_to_the_episodic_pivot(spark):
    assert _setup(spark, burst=True)["burst"] and not _setup(spark, burst=True, episodic=True)["burst"]


def test_signals_need_a_base_and_both_prices(spark):
    names = "market ticker d bucket pivot stop target2r early_entry_trigger early_entry_stop ma20_bounce_trigger ma20_bounce_stop ma50_bounce_trigger ma50_bounce_stop episodic_pivot_trigger episodic_pivot_stop".split()
    rows = [("US", "A", DAY, "swing", 10.0, 9.0, 12.0, 9.5, 9.0, None, None, None, None, 11.0, None), ("US", "B", DAY, "position", 10.0, 9.0, 12.0, 9.5, 9.0, 8.0, 7.0, None, None, None, None)]
    got = rc.from_board(spark.createDataFrame(rows, ", ".join(f"{n} {'date' if n == 'd' else 'string' if k < 4 else 'double'}" for k, n in enumerate(names)))).collect()
    assert sorted((r["ticker"], r["kind"], r["target"]) for r in got) == [("A", "breakout", 12.0), ("A", "early_entry", 10.5), ("B", "ma20_bounce", 10.0)]


def test_curves_without_movement_have_no_ratio(spark):
    x = rc.curve_statistics(spark.createDataFrame([("US", DAY + dt.timedelta(days=k), 100.0) for k in range(5)], "market string, d date, equity double"), 100.0).first()
    assert x["sharpe"] is None and x["max_drawdown"] == 0.0 and x["growth"] == 0.0


def test_a_stale_market_is_an_error(spark):
    b = _bars(spark, {"A": [10.0] * 3})
    vd.assert_fresh(b, spark.createDataFrame([("US", DAY + dt.timedelta(days=2))], "market string, session date"))
    with pytest.raises(ValueError):
        vd.assert_fresh(b, spark.createDataFrame([("MY", DAY)], "market string, session date"))


def test_vendor_codes(spark):
    x = spark.createDataFrame([("1155.KL",), ("AAPL",), ("BRK.B",)], "t string").select(vd.to_vendor(F.col("t")).alias("v")).toPandas()["v"].tolist()
    assert x == ["1155.KLSE", "AAPL.US", "BRK.B"]


def test_a_grade_demotes_only_swings(spark):
    rows = [("US", "A", "swing", "x", ""), ("US", "B", "position", "x", ""), ("US", "C", "swing", "x", "below_50ma")]
    b = spark.createDataFrame(rows, "market string, ticker string, bucket string, industry string, demoted_by string")
    fund = spark.createDataFrame([("A", "E"), ("B", "E"), ("C", "E")], "ticker string, grade string")
    none = spark.createDataFrame([], "ticker string, name string"), spark.createDataFrame([], "market string, industry string, group_rank int")
    got = {r["ticker"]: (r["bucket"], r["demoted_by"]) for r in en.enrich(b, *none, fund).collect()}
    assert got == {"A": ("watchlist", "grade_E"), "B": ("position", ""), "C": ("watchlist", "below_50ma,grade_E")}


def test_merged_maps_let_the_new_entry_stand(spark):
    x = spark.sql("select map('US', 1, 'MY', 2) a, map('MY', 3) b, cast(null as map<string,int>) c").select(st.merge_maps(F.col("a"), F.col("b")).alias("ab"), st.merge_maps(F.col("a"), F.col("c")).alias("ac"), st.merge_maps(F.col("c"), F.col("b")).alias("cb")).first()
    assert (x["ab"], x["ac"], x["cb"]) == ({"US": 1, "MY": 3}, {"US": 1, "MY": 2}, {"MY": 3})


def test_news_order_survives_ids_that_are_no_numbers(spark):
    rows = [("A", "announcement", i, None) for i in ("9", "10", "00-1", "123456789012345678901234567890")] + [("A", "announcement", "5", DAY)]
    x = st.news_window(spark.createDataFrame(rows, "ticker string, kind string, item_id string, published date"), "2020-02-01", announcements=4).toPandas()["item_id"].tolist()
    assert sorted(x) == sorted(["5", "123456789012345678901234567890", "10", "9"])


def test_ghost_sessions_are_no_sessions(spark):
    paths = {f"T{k:02}": [10 + 0.1 * i if i not in (150, 151) else None for i in range(300)] for k in range(20)}
    paths["JUNK"] = [5.0] * 300
    x = sg.session_features(_bars(spark, paths))
    assert x.agg(F.max("s")).first()[0] == 298
    assert x.filter("ticker = 'T01' and ma200 is not null").count() == 99


def test_markets_do_not_share_a_clock(spark):
    us = _bars(spark, {"A": [10 + 0.1 * i for i in range(60)]})
    my = _bars(spark, {"B.KL": [10 + 0.1 * i if i % 2 else None for i in range(60)]}, "MY")
    x = sg.signals(sg.session_features(us.unionByName(my)), "donchian")
    assert {r["market"] for r in x.filter("ma20 is not null").select("market").distinct().collect()} == {"US", "MY"}


def test_an_unknown_strategy_is_an_error(spark):
    with pytest.raises(ValueError):
        sg.signals(sg.session_features(_bars(spark, {"A": [1.0] * 5})), "none")


def _grade(spark, after, trigger=10.0, stop=9.0, target=12.0):
    rows = [("US", "A", DAY, 9.5, 9.6, 9.4, 9.5, 1.0)] + [("US", "A", DAY + dt.timedelta(days=k + 1), *x, 1.0) for k, x in enumerate(after)]
    s = spark.createDataFrame([("US", "A", DAY, "k", trigger, stop, target)], "market string, ticker string, d date, kind string, trigger double, stop double, target double")
    return ev.grade(s, spark.createDataFrame(rows, BARS)).first()


def test_stop_and_target_on_one_bar_is_a_loss(spark):
    x = _grade(spark, [(10.0, 12.5, 8.5, 11.0)])
    assert (x["outcome"], x["r"], x["days_to_trigger"]) == ("loss", -1.0, 0)


def test_win_open_and_never_triggered(spark):
    assert _grade(spark, [(9.5, 9.9, 9.4, 9.8), (10.0, 10.5, 9.8, 10.4), (11.0, 12.1, 10.9, 12.0)])["outcome"] == "win"
    assert _grade(spark, [(10.0, 10.5, 9.8, 10.4)])["r"] == pytest.approx(0.4)
    assert _grade(spark, [(9.0, 9.5, 9.2, 9.4)] * 20)["outcome"] == "never_triggered"
    assert _grade(spark, [(10.0, 10.5, 9.8, 10.4)], stop=10.0)["outcome"] == "never_triggered"


def test_recent_rows_have_no_forward_return(spark):
    b = _bars(spark, {"A": [10.0 + i for i in range(30)]})
    rows = spark.createDataFrame([("US", "A", DAY + dt.timedelta(days=k), float(k)) for k in (0, 9, 10)], "market string, ticker string, d date, score double")
    assert sorted(r["score"] for r in ev.forward_returns(rows, b).collect()) == [0.0, 9.0]


@pytest.mark.parametrize("n", [5, 7, 23, 100])
def test_buckets_follow_equal_count_edges(spark, n):
    rows = spark.createDataFrame([("US", f"T{k:03}", DAY, float(k)) for k in range(n)], "market string, ticker string, d date, score double")
    got = ev.buckets(rows, "score").orderBy("score").toPandas()["bucket"].tolist()
    assert got == (pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).tolist()


def _naive(data, signal, ma50, market, risk, slots, start, most):
    """A day-by-day loop over one market, written apart from the operator."""
    cost, cash, equity, open_, trades, curve = config.MARKETS[market], start, start, {}, [], []
    sessions = sorted({s for p in data.values() for s in p})
    for s in range(sessions[0] + 1, sessions[-1] + 1):
        for t in list(open_):
            if s not in data[t]:
                continue
            p, (o, h, low, c) = open_[t], data[t][s]
            p["held"] += 1
            m = ma50[t].get(s)
            p["armed"] |= m is not None and c >= m
            why = ("stop", min(p["stop"], o)) if low <= p["stop"] else ("ma50_break", c) if p["armed"] and m is not None and c < m else ("time", c) if p["held"] >= config.MAX_HOLD else None
            if why:
                out = why[1] * (1 - cost["slip"])
                cash += p["shares"] * out * (1 - cost["fee"])
                trades.append((t, p["s"], s, why[0], p["shares"], round(out, 6)))
                del open_[t]
        for t in sorted(data):
            if len(open_) >= slots:
                break
            if t in open_ or not signal[t].get(s - 1) or s not in data[t]:
                continue
            o, h, low, c = data[t][s]
            fill = o * (1 + cost["slip"])
            stop = fill * (1 - config.STOP)
            n = min(int(equity * risk // (fill - stop)), int(equity * most // fill))
            if n <= 0 or n * fill * (1 + cost["fee"]) > cash:
                continue
            cash -= n * fill * (1 + cost["fee"])
            m = ma50[t].get(s)
            open_[t] = {"s": s, "entry": fill, "stop": stop, "shares": n, "held": 0, "armed": m is not None and o >= m}
            if low <= stop:
                out = stop * (1 - cost["slip"])
                cash += n * out * (1 - cost["fee"])
                trades.append((t, s, s, "stop", n, round(out, 6)))
                del open_[t]
        equity = cash + sum(p["shares"] * (data[t][s][3] if s in data[t] else p["entry"]) for t, p in open_.items())
        curve.append((s, round(equity, 4)))
    last = sessions[-1]
    for t, p in open_.items():
        out = (data[t][last][3] if last in data[t] else p["entry"]) * (1 - cost["slip"])
        trades.append((t, p["s"], last, "end_of_data", p["shares"], round(out, 6)))
    return sorted(trades), curve


@pytest.mark.parametrize("seed", range(3))
def test_two_phase_replay_equals_a_daily_loop(spark, seed):
    r = random.Random(seed)
    data, signal, ma50, rows = {}, {}, {}, []
    for t in [f"T{k}" for k in range(12)]:
        data[t], signal[t], ma50[t], c = {}, {}, {}, 50.0
        for s in range(1, 160):
            o = c * (1 + r.gauss(0, 0.01))
            c = o * (1 + r.gauss(0.001, 0.03))
            h, low = max(o, c) * 1.01, min(o, c) * 0.985
            if r.random() < 0.04:
                continue
            data[t][s], signal[t][s] = (o, h, low, c), r.random() < 0.08
            ma50[t][s] = 48.0 + r.random() * 6 if s > 30 else None
            rows.append(("US", t, s, o, h, low, c, ma50[t][s], signal[t][s]))
    x = spark.createDataFrame(rows, "market string, ticker string, s long, o double, h double, l double, c double, ma50 double, signal boolean")
    kw = {"risk": 0.01, "slots": 4, "start": 100_000.0, "most": 0.25}
    want, curve = _naive(data, signal, ma50, "US", **kw)
    got = sorted((y["ticker"], y["entry_s"], y["exit_s"], y["reason"], y["shares"], round(y["exit"], 6)) for y in rp.replay(x, **kw).collect())
    assert got == want
    assert [(y["s"], round(y["equity"], 4)) for y in rp.replay(x, equity=True, **kw).orderBy("s").collect()] == curve


def test_a_grid_gives_the_rows_of_its_plans_run_alone(spark):
    r = random.Random(5)
    rows = []
    for market in ("US", "MY"):
        for t in range(9):
            c = 50.0
            for s in range(1, 140):
                o, c = c * (1 + r.gauss(0, 0.01)), c * (1 + r.gauss(0.001, 0.03))
                names = [n for n in ("one", "two") if r.random() < 0.06]
                rows.append((market, f"{market}{t}", s, o, max(o, c) * 1.01, min(o, c) * 0.985, c, 50.0, names))
    x = spark.createDataFrame(rows, "market string, ticker string, s long, o double, h double, l double, c double, ma50 double, fired array<string>")
    free = (("US", 0.0), ("MY", 0.0))
    plans = [rp.Plan("a", "one"), rp.Plan("b", "two", stop=0.04), rp.Plan("c", "one", slots=2, risk=0.03), rp.Plan("d", "two", hold=7, start=5_000.0), rp.Plan("e", "one", slips=free, fees=free)]
    trades, curve = rp.grid(x, plans)
    every = {y for y in map(tuple, trades.collect())}, {y for y in map(tuple, curve.collect())}
    for p in plans:
        own = rp.grid(x, [p])
        for together, alone in zip(every, own, strict=True):
            want = {tuple(y) for y in alone.collect()}
            assert want and {y for y in together if y[0] == p.name} == want
    one = x.withColumn("signal", F.array_contains("fired", "one")).drop("fired")
    assert {tuple(y) for y in rp.replay(one).collect()} == {y[1:] for y in every[0] if y[0] == "a"}
    for bad in ([], [plans[0], plans[0]]):
        with pytest.raises(ValueError, match="plans"):
            rp.admitted(x, bad)


def test_draws_of_the_counter_are_even():
    x = rp.picks(np.arange(200), 50, 7)
    n = np.bincount(x.ravel(), minlength=50)
    assert len(n) == 50 and n.min() > 140 and n.max() < 260 and len({tuple(row) for row in x.tolist()}) == 200


def test_stages_are_deleted_when_the_caller_is_done(spark):
    from tapeloom.functions import stage

    with stage.kept():
        x = stage.written(spark.range(5).toDF("n"), "probe")
        p, fs = stage.path_of(spark, x.inputFiles()[0])
        assert x.count() == 5 and fs.exists(p)
    assert not fs.exists(p)


def test_a_market_without_costs_of_its_own_pays_those_of_us(spark):
    rows = [(m, "A", s, 10.0 + s, 10.5 + s, 9.5 + s, 10.0 + s, 8.0, s == 2) for m in ("US", "SG") for s in range(1, 50)]
    x = spark.createDataFrame(rows, "market string, ticker string, s long, o double, h double, l double, c double, ma50 double, signal boolean")
    got = {r["market"]: (r["exit"], r["fees"], r["reason"]) for r in rp.replay(x).collect()}
    assert got["SG"] == got["US"] and got["US"][2] == "time"


def test_bootstrap_repeats_and_orders_its_percentiles(spark):
    r = random.Random(3)
    rows = [("US", r.choice([-1.0, -0.5, 2.0])) for _ in range(30)] + [("MY", 1.0)] * 25 + [("SG", 1.0)] * 19
    t = spark.createDataFrame(rows, "market string, r double")
    a, b = ({x["market"]: x for x in rp.bootstrap(t).collect()} for _ in range(2))
    assert a == b and a["US"]["growth_p5"] < a["US"]["growth_p50"] < a["US"]["growth_p95"] and a["US"]["fall_p5"] < a["US"]["fall_p95"] <= 0
    # one and the same win in any order: half a year of it, and no fall
    assert a["MY"]["growth_p5"] == pytest.approx((1.01**50 - 1) * 100) and (a["MY"]["fall_p5"], a["MY"]["halved"], a["MY"]["draws"]) == (0.0, 0.0, 10_000)
    assert a["SG"]["thin"] and a["SG"]["growth_p50"] is None and a["SG"]["draws"] == 0


def test_negative_base_has_no_growth_and_few_boxes_no_grade(spark):
    q = spark.createDataFrame([("A", DAY - dt.timedelta(days=91 * k), 100.0 - k, -5.0, None) for k in range(6)], "ticker string, q_end date, revenue double, net_income double, eps double")
    x = fu.scorecard(fu.growth(q).withColumn("roe", F.lit(None).cast("double"))).first()
    assert x["ni_yoy"] is None and x["rev_yoy"] > 0


def test_quarter_grid_keeps_a_gap(spark):
    ends = [dt.date(2023, 12, 31), dt.date(2023, 9, 30), dt.date(2023, 3, 31)]
    x = fu.quarter_grid(spark.createDataFrame([("A", e, 1.0) for e in ends], "ticker string, end date, val double"), slots=4).orderBy("slot").collect()
    assert [r["val"] for r in x] == [1.0, 1.0, None, 1.0] and x[3]["q_end"] == ends[2]


def test_upsert_keeps_old_values_where_asked(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, x double")
    new = spark.createDataFrame([(1, None, 9.0), (3, "c", 3.0)], "k int, name string, x double")
    got = {r["k"]: (r["name"], r["x"]) for r in st.upsert(old, new, ["k"], ["name"]).collect()}
    assert got == {1: ("a", 9.0), 2: ("b", 2.0), 3: ("c", 3.0)}


def test_an_empty_directory_purges_nothing(spark):
    t = spark.createDataFrame([(1,)], "k int")
    assert st.purge(t, t.limit(0), "k").count() == 1


def test_numbers_as_printed(spark):
    text = ["1,234.5", "(2.5m)", "RM 3k", "-4%", "n/a", None, "7b"]
    x = spark.createDataFrame([(t,) for t in text], "t string").select(fu.number(F.col("t")).alias("n")).toPandas()["n"]
    assert [None if pd.isna(v) else v for v in x] == [1234.5, -2.5e6, 3000.0, -4.0, None, None, 7e9]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    from tapeloom.streaming import events as ee

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select([f.name for f in ee.SCHEMA])
    e.write.parquet(str(tmp_path / "in"))
    q = ee.windowed(ee.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == e.count()


def test_command_line_scans_and_backtests(spark, tmp_path, capsys):
    from tapeloom import __main__ as cli
    from tapeloom.sources.panel import session_bars

    session_bars(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "bars"))
    cli.main(["scan", "--bars", str(tmp_path / "bars"), "--out", str(tmp_path / "scan")])
    cli.main(["backtest", "--bars", str(tmp_path / "bars"), "--out", str(tmp_path / "test"), "--strategy", "donchian", "darvas", "--market", "MY", "--stop", "0.08", "0.04", "--years", "2", "--min-bars", "50", "--fee", "MY=0.001", "--label", "try"])
    trades = spark.read.parquet(str(tmp_path / "test" / "trades"))
    assert trades.count() > 0 and {r["market"] for r in trades.select("market").distinct().collect()} == {"MY"}
    assert {r["plan"] for r in spark.read.parquet(str(tmp_path / "test" / "statistics")).collect()} >= {f"try donchian stop={x} hold=40 risk=0.01 slots=8" for x in (0.08, 0.04)}
    assert spark.read.parquet(str(tmp_path / "scan" / "candles")).count() == spark.read.parquet(str(tmp_path / "scan" / "board")).count()
    cli.main(["list"])
    cli.main(["sql", "board"])
    assert "replay_trades" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["backtest", "--bars", "x", "--out", "y", "--strategy", "none"])


def test_purge_keeps_everything_where_the_directory_is_empty(spark):
    t = spark.createDataFrame([("A", 1), ("B", 2), ("IX", 3), (None, 4)], "ticker string, v int")
    kept = lambda d, *always: sorted(r["v"] for r in st.purge(t, spark.createDataFrame([(x,) for x in d], "ticker string"), "ticker", list(always)).collect())
    assert kept(["A", "A"]) == [1] and kept(["A"], "IX") == [1, 3] and kept(["Z"]) == [] and kept([]) == [1, 2, 3, 4]


@pytest.mark.parametrize(
    ("name", "last"),
    [
        ("piercing", [(11.0, 11.1, 8.9, 9.0), (8.5, 10.3, 8.4, 10.2)]),
        ("dark_cloud_cover", [(9.0, 11.1, 8.9, 11.0), (11.5, 11.6, 9.7, 9.8)]),
        ("morning_star", [(12.0, 12.1, 9.9, 10.0), (9.5, 9.7, 9.4, 9.6), (9.8, 11.6, 9.7, 11.5)]),
        ("evening_star", [(10.0, 12.1, 9.9, 12.0), (12.4, 12.6, 12.3, 12.5), (12.2, 12.3, 10.4, 10.5)]),
        ("hammer", [(9.9, 10.25, 9.0, 10.2)]),
        ("shooting_star", [(11.2, 12.5, 11.15, 11.5)]),
        ("bullish_harami", [(12.0, 12.1, 9.4, 9.5), (10.5, 11.0, 10.2, 10.8)]),
        ("three_white_soldiers", [(10.2, 11.42, 10.1, 11.4), (10.9, 12.22, 10.8, 12.2), (11.7, 13.02, 11.6, 13.0)]),
        ("three_black_crows", [(10.0, 12.1, 9.9, 12.0), (12.0, 12.1, 10.78, 10.8), (11.5, 11.6, 9.98, 10.0), (10.6, 10.7, 8.98, 9.0)]),
    ],
)
def test_candles_by_their_definitions(spark, name, last):
    even = [(10.0, 11.2, 9.8, 11.0) if k % 2 else (11.0, 11.2, 9.8, 10.0) for k in range(14)]
    rows = [("US", "A", DAY + dt.timedelta(days=k), *x, 1e6) for k, x in enumerate([*even, *last])]
    x = cd.candle_patterns(spark.createDataFrame(rows, BARS)).orderBy("d").collect()
    assert x[-1][name] and not x[5][name]
    assert name in cd.shown(cd.candle_patterns(spark.createDataFrame(rows, BARS))).orderBy(F.desc("d")).first()["patterns"]


def _page(spark, html):
    from tapeloom.sources import markup

    return markup.parsed(spark.createDataFrame([(1, html)], "tables long, html string")).first()["parsed"]


def test_tables_keep_their_nesting_and_spans(spark):
    html = """<table><tr><th>A<th colspan=2>B</tr><tr><td rowspan=2>x<td>1<td>2 <table><tr><th>in</th></tr><tr><td>ner &amp; b</td></tr></table> 3
    <tr><td>4<td>5</table><table><tbody><tr><td>no head</td></tr></tbody></table><p>a<p>b<ul><li>1<li>2</ul>"""
    x = _page(spark, html)
    got = [(t["header"], t["rows"]) for t in x["tables"]]
    assert got[0] == (["A", "B", "B"], [["x", "1", "2 3"], ["x", "4", "5"]])
    assert got[1] == (["in"], [["ner & b"]]) and got[2] == ([], [["no head"]])
    assert (x["n_items"], x["n_paragraphs"]) == (2, 2)
    for odd in (None, "", "<", "<table><tr><td colspan=999999999999><td colspan=-1 rowspan=x>", "</td></tr></table>", "plain & text"):
        assert _page(spark, odd)["feed"] == []


def test_a_section_is_the_largest_fitting_table(spark):
    from tapeloom.sources import dossier, markup

    head = "<tr><th>EPS</th><th>Revenue</th><th>Quarter</th><th>Q Date</th></tr>"
    html = f"<table>{head}</table><table>{head}<tr><td colspan=100>2020</td></tr><tr><td>(1.5)</td><td>14.9b</td><td>1</td><td>31 Mar, 2020</td></tr><tr><td>-</td><td></td><td>2</td><td>none</td></tr></table>"
    annual = "<table><tr><th>Financial Year<th>Revenue ('000)<th>Net (x)<th>EPS<th>Report</tr><tr><td>31 December 2019<td>1,200<td>30<td>2<td>.</tr></table>"
    rows = [(1, html + annual), (2, "<p>nothing"), (3, None)]
    x = {r["id"]: r for r in dossier.sections(markup.parsed(spark.createDataFrame(rows, "id long, html string"))).collect()}
    q = x[1]["quarters"]
    assert len(q) == 1 and (q[0]["q_end"], q[0]["revenue"], q[0]["eps"], q[0]["net_income"]) == (dt.date(2020, 3, 31), 14.9e9, -1.5, None)
    assert [tuple(y) for y in x[1]["annual"]] == [(dt.date(2019, 12, 31), 1_200_000.0, 30.0, 2.0)]
    assert x[2]["quarters"] == [] and x[2]["unavailable"] == x[3]["unavailable"] == ["quarters", "annual"] and x[1]["unavailable"] == []


def test_feed_items_come_once_from_their_outermost_own_block(spark):
    html = """<body><div id=list><div class=item><a href=/v2/news/view/1><img></a><div class=item-title><a href=/v2/news/view/1>One &amp; only</a></div><span data-date="2024-05-06 07:08:09.5">Desk</span></div>
    <div class=item><a href=/v2/news/view/2><img></a></div><a class=announcement-item href=/v2/announcements/view/3><div class=date-box><span>22</span><span>Jul</span></div><div class=title>Three</div></a>
    <a href=/v2/news/view/1>again</a><a href=/about>no</a></div></body>"""
    got = [(y["item_id"], y["title"], y["date"], y["source"]) for y in _page(spark, html)["feed"]]
    assert got == [("1", "One & only", "2024-05-06 07:08:09", "Desk"), ("3", "Three", "22 Jul", "22")]


def test_registry_looks_up_classes_and_reads_short_arrays(spark):
    from tapeloom.sources import registry as rg

    known = rg.ticker_map(spark.createDataFrame([('{"0":{"cik_str":7,"ticker":"brk-b"},"1":{"cik_str":8,"ticker":"KL"},"2":{"ticker":""}}',)], "raw string"))
    doc = '{"name":"B","sicDescription":"Fire","exchanges":[],"filings":{"recent":{"accessionNumber":["a-1","a-2","a-3"],"form":["8-K","10-Q","4"],"items":["9.01, 5.02,2.02"],"filingDate":["2024-01-02"],"primaryDocument":["x.htm"]}}}'
    sub = spark.createDataFrame([(7, doc), (9, "{}"), (8, "broken")], "cik long, raw string")
    tickers = spark.createDataFrame([("BRK.B",), ("X.KL",), ("KL",), ("NONE",)], "ticker string")
    assert [tuple(r) for r in rg.companies(tickers, known, sub).filter("name is not null").collect()] == [("BRK.B", 7, "B", "Fire", None)]
    got = {r["item_id"]: r for r in rg.filings(tickers, known, sub, "http://r", None).collect()}
    assert (got["a-1"]["category"], got["a-1"]["title"]) == ("management", "8-K: Director/officer departure or appointment; Results of operations (earnings release)")
    assert (got["a-2"]["title"], got["a-2"]["url"], got["a-2"]["filed"]) == ("10-Q Quarterly report", "http://r/cgi-bin/browse-edgar?action=getcompany&CIK=7", None)
    assert got["a-3"]["category"] == "insider_dealing" and len(got) == 3
    assert {r["item_id"] for r in rg.filings(tickers, known, sub, "http://r").collect()} == {"a-1", "a-2"}


def test_extremes_of_blocks_equal_moving_frames(spark):
    from tapeloom.functions.frames import block_extremes, extreme, over

    r = random.Random(8)
    rows = [("US", t, dt.date(2020, 1, 1) + dt.timedelta(days=k), r.choice([r.random(), None])) for t, n in (("A", 1), ("B", 17), ("C", 90), ("D", 300)) for k in range(n)]
    x = block_extremes(spark.createDataFrame(rows, "market string, ticker string, d date, h double"), top=(F.max, "h"), low=(F.min, "h"))
    for n in (16, 17, 32, 33, 100, 252):
        pairs = [(extreme("top", True, n), over(F.max, "h", 1 - n)), (extreme("low", False, n), over(F.min, "h", 1 - n))]
        y = x.select(*(a.alias(f"a{k}") for k, (a, _) in enumerate(pairs)), *(b.alias(f"b{k}") for k, (_, b) in enumerate(pairs)))
        assert y.filter("not (a0 <=> b0) or not (a1 <=> b1)").count() == 0
