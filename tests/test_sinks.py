"""Stored tables: saves that are stopped, repeated or apart; the archive walk stopped half way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.sinks import archive, stores, upkeep
from tapeloom.sinks.tables import Table

SCHEMA = "k long, g string, v string"


def _table(spark, path, cls=Table):
    return cls(spark, str(path), SCHEMA, ["k"], {"by_g": "pmod(k, 3)"})


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _all(t):
    return sorted(tuple(r) for r in t.rows().collect())


class _Stops(Table):
    """Stopped at one of the steps of a save."""

    at = None

    def _staged(self, own, touched):
        if self.at == "before the mark":
            raise KeyboardInterrupt
        super()._staged(own, touched)

    def _swap(self):
        if self.at == "before the swap":
            raise KeyboardInterrupt
        if self.at == "in the swap":
            name = self._partitions("_saves/ready")[0]
            p, fs = self._at(name)
            fs.delete(p, True)
            raise KeyboardInterrupt
        super()._swap()


@pytest.mark.parametrize("at", ["before the mark", "before the swap", "in the swap"])
def test_a_stopped_save_leaves_the_old_or_the_new_state(spark, tmp_path, at):
    old = [(1, "a", "x"), (2, "a", "x"), (3, None, None)]
    _table(spark, tmp_path / "t").upsert(_rows(spark, *old))
    stopped = _table(spark, tmp_path / "t", _Stops)
    stopped.at = at
    new = [(1, "b", "y"), (4, "b", "y"), (6, "b", "y")]
    with pytest.raises(KeyboardInterrupt):
        stopped.upsert(_rows(spark, *new))
    want = sorted([(1, "b", "y"), (2, "a", "x"), (3, None, None), (4, "b", "y"), (6, "b", "y")], key=lambda r: r[0])
    after = _all(_table(spark, tmp_path / "t"))
    assert after == (sorted(old, key=lambda r: r[0]) if at == "before the mark" else want)
    again = _table(spark, tmp_path / "t")
    again.upsert(_rows(spark, *new))
    again.upsert(_rows(spark, *new))
    assert _all(again) == want


def test_only_touched_partitions_are_written_anew(spark, tmp_path):
    t = _table(spark, tmp_path / "t")
    assert _all(t) == []
    t.upsert(_rows(spark))
    assert _all(t) == []
    t.upsert(_rows(spark, *((k, "a", "x") for k in range(9))))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    t.upsert(_rows(spark, (4, "b", None), (4, "c", "z"), (7, None, None)), keep=["v"], order=["g"])
    kept = {p for p in (tmp_path / "t").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}
    assert kept and all("by_g=1" not in str(p) for p in kept) and {p.parent.name for p in kept} == {"by_g=0", "by_g=2"}
    got = {r[0]: r[1:] for r in _all(t)}
    assert got[4] == ("c", "z") and got[7] == (None, "x") and got[1] == ("a", "x") and len(got) == 9
    t.replace(_rows(spark, (1, "n", "n")))
    assert [r[0] for r in _all(t)] == [0, 1, 2, 3, 5, 6, 8]
    t.append(_rows(spark, (1, "m", "m")))
    assert [r[1] for r in _all(t) if r[0] == 1] == ["m", "n"]
    t.rewrite(lambda rows: rows.filter("k > 2"))
    assert [r[0] for r in _all(t)] == [3, 5, 6, 8] and not (tmp_path / "t" / "by_g=1").exists()


def test_null_and_odd_partition_names(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k long, g string", ["k"], {"by_g": "g", "by_h": "k % 2"})
    rows = [(1, None), (2, "a/b=c %"), (3, "__x"), (4, "")]
    t.upsert(spark.createDataFrame(rows, "k long, g string"))
    assert sorted(r[0] for r in t.rows().collect()) == [1, 2, 3, 4]
    t.upsert(spark.createDataFrame([(1, None), (2, "a/b=c %")], "k long, g string"))
    assert sorted(r[0] for r in t.rows().collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="names of their own"):
        Table(spark, str(tmp_path / "u"), "k long", ["k"], {"k": "k"})


def test_backtests_keep_the_newest_nightly_ones(spark, tmp_path):
    t = stores.backtests(spark, str(tmp_path / "b"))
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=200 * k), "nightly x" if k % 2 else ("mine" if k % 4 else None), "US", "s", 1, 0.5) for k in range(10)]
    for part in (rows[:5], rows[5:]):
        stores.save_backtests(t, spark.createDataFrame(part, t.schema), keep=2)
    assert sorted(r["id"] for r in t.rows().collect()) == [0, 2, 4, 6, 7, 8, 9]


def test_positions_keep_their_last_price(spark, tmp_path):
    t = stores.positions(spark, str(tmp_path / "p"))
    for price, day, flag in ((5.0, 1, True), (None, 2, False)):
        stores.save_positions(t, spark.createDataFrame([(1, "US", "A", price, dt.date(2024, 1, day), {"stop": flag})], t.schema))
    assert [tuple(r) for r in t.rows().collect()] == [(1, "US", "A", 5.0, dt.date(2024, 1, 2), {"stop": False})]


def _feed(spark, depth=11):
    """Pages of five items each, of which one stands on the page before too; no date on announcements."""
    rows = []
    for kind in ("news", "announcement"):
        for t in ("1.KL", "2.KL"):
            for page in range(1, depth + 1 if t == "1.KL" else 4):
                ids = [f"{t[0]}{1 if kind == 'news' else 2}{n:03d}" for n in range(5 * page - 1, 5 * page + 5)]
                day = dt.date(2024, 6, 30) - dt.timedelta(days=10 * page)
                date = f' data-date="{day} 10:00:00"' if kind == "news" else ""
                body = "".join(f'<div class=item><a href="/v2/{kind}/view/{i}">Quarterly report {i}</a><span{date}>s</span></div>' for i in ids)
                rows.append((t, kind, page, f"<html><body>{body}</body></html>"))
    return spark.createDataFrame(rows, "ticker string, kind string, page int, html string")


def _walk(spark, path, pages, name="w", stop_at=None, **how):
    calls = []

    def fetch(asked):
        calls.append(sorted(r["page"] for r in asked.collect()))
        if stop_at is not None and len(calls) > stop_at:
            raise ConnectionError
        return pages.join(asked, ["ticker", "kind", "page"], "left_semi")

    news, state, shown = stores.news(spark, f"{path}/n"), archive.progress(spark, f"{path}/p"), archive.found(spark, f"{path}/f")
    tickers = spark.createDataFrame([("1.KL",), ("2.KL",)], "ticker string")
    how = {"since": "2024-04-05", "most": 20, "most_filed": 5, "first": 4} | how
    done = archive.walk(name, tickers, fetch, news, state, shown, "http://x", **how)
    return sorted(map(tuple, news.rows().select("ticker", "kind", "item_id", "published", "category").collect()), key=str), sorted(map(tuple, done.collect())), calls


def test_a_stopped_walk_goes_on_where_it_stopped(spark, tmp_path):
    pages = _feed(spark).cache()
    want, done, calls = _walk(spark, tmp_path / "a", pages)
    # news of 1.KL ends before page 9 (older than the day), of 2.KL after its third; announcements after five and three pages
    assert {(r[1], r[2]): r[3] for r in done} == {("1.KL", "news"): 9, ("2.KL", "news"): 4, ("1.KL", "announcement"): 5, ("2.KL", "announcement"): 4}
    assert len([r for r in want if r[:2] == ("1.KL", "news")]) == 8 * 5 + 1 and {r[4] for r in want} == {None, "results"}
    with pytest.raises(ConnectionError):
        _walk(spark, tmp_path / "b", pages, stop_at=1)
    got, ended, later = _walk(spark, tmp_path / "b", pages)
    assert (got, ended) == (want, done) and [sorted(set(c)) for c in calls] == [[1, 2, 3, 4], [*range(5, 13)]] and min(min(c) for c in later) == 5
    assert _walk(spark, tmp_path / "b", pages)[2] == []


def test_a_walk_that_reads_nothing_is_an_error(spark, tmp_path):
    empty = _feed(spark).withColumn("html", F.lit("<html><body>blocked</body></html>"))
    with pytest.raises(archive.NothingParsed):
        _walk(spark, tmp_path / "a", empty)


def test_features_kept_from_night_to_night_equal_the_whole(spark, tmp_path):
    """On time, late, corrected, repeated and split: three tickers of different ages."""
    first = dt.date(2021, 1, 4)
    rows = [("US", t, first + dt.timedelta(days=k), 10.0 + k % 7, 12.0 + k % 7, 9.0, 10.5 + (k * p) % 9, 100.0 + k) for p, (t, n) in enumerate((("A", 320), ("B", 275), ("C", 40)), 1) for k in range(320 - n, 320)]
    bars = spark.createDataFrame(rows, stores.BARS).cache()
    tables = stores.bars(spark, f"{tmp_path}/b"), upkeep.tails(spark, f"{tmp_path}/t"), upkeep.features(spark, f"{tmp_path}/f")
    day = lambda k: first + dt.timedelta(days=k)

    def same(whole):
        want = ind.features(whole).select("market", "ticker", "d", F.col("k").cast("long"), *upkeep.FEATURES)
        got = tables[2].rows().select(want.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0

    upkeep.night(*tables, bars.filter(F.col("d") < day(300)))
    on_time = bars.filter((F.col("d") >= day(300)) & ~((F.col("ticker") == "B") & (F.col("d") < day(310))))
    upkeep.night(*tables, on_time)
    upkeep.night(*tables, on_time)
    same(bars.filter(~((F.col("ticker") == "B") & (F.col("d") >= day(300)) & (F.col("d") < day(310)))))
    upkeep.night(*tables, bars.filter((F.col("ticker") == "B") & (F.col("d") >= day(300)) & (F.col("d") < day(310))))
    same(bars)
    halved = bars.filter("ticker = 'A'").filter(F.col("d") > day(5)).withColumns({c: F.col(c) / 2 for c in ("o", "h", "l", "c")})
    upkeep.repulled(*tables, spark.createDataFrame([("A",), ("C",)], "ticker string"), halved)
    same(bars.filter("ticker <> 'A'").unionByName(halved))


def test_command_line_keeps_stores_grades_and_compares(spark, tmp_path, capsys):
    from tapeloom import __main__ as cli

    first = dt.date(2021, 1, 4)
    rows = [("US", f"T{t}", first + dt.timedelta(days=k), 10.0, 12.0 + (k * t) % 3, 9.0, 10.0 + (k * t) % 5, 100.0) for t in range(1, 8) for k in range(60)]
    bars = spark.createDataFrame(rows, stores.BARS)
    at = lambda name: str(tmp_path / name)
    bars.write.parquet(at("bars"))
    bars.filter("dayofmonth(d) = 10").selectExpr("market", "ticker", "d", "'pivot' AS kind", "c * 1.01 AS trigger", "c * 0.9 AS stop", "c * 1.2 AS target").write.parquet(at("signals"))
    bars.filter("d < date '2021-02-01'").selectExpr("market", "ticker", "d", "c AS price", "v AS volume").write.parquet(at("rows"))
    _feed(spark).write.parquet(at("pages"))
    cli.main(["ingest", "--fresh", at("bars"), "--store", at("store")])
    cli.main(["walk", "--pages", at("pages"), "--store", at("store"), "--name", "w", "--base", "http://x", "--since", "2024-04-05"])
    cli.main(["grade", "--signals", at("signals"), "--bars", at("bars"), "--out", at("out")])
    cli.main(["factors", "--rows", at("rows"), "--bars", at("bars"), "--out", at("out"), "--factor", "price", "volume"])
    assert upkeep.features(spark, at("store/features")).rows().count() == len(rows) and stores.news(spark, at("store/news")).rows().count() > 50
    assert spark.read.parquet(at("out/outcomes")).count() == 14 and spark.read.parquet(at("out/scoreboard")).count() == 1
    assert {r["factor"] for r in spark.read.parquet(at("out/factors")).collect()} == {"price", "volume"}
    assert "out/factors" in capsys.readouterr().out
