"""Cases of the review of round 4, which failed before."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tapeloom import registry


def _both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over tables of our own."""
    c = duckdb.connect()
    for k, df in tables.items():
        path = str(tmp_path / f"{k}.parquet")
        df.write.parquet(path)
        c.execute(f"CREATE VIEW {k} AS SELECT * FROM '{path}/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r)
    return sorted((tuple(r) for r in got.select(*names).collect()), key=key), sorted(want.fetchall(), key=key)


def test_cached_ages_count_parts_of_seconds(spark, tmp_path):
    now = dt.datetime(2024, 1, 20)
    rows = [(k, 1, now - dt.timedelta(days=d) + dt.timedelta(microseconds=us)) for k, (d, us) in enumerate((d, us) for d in (1, 3, 7) for us in (-1, 0, 1, 500_000, 999_999, 1_000_000))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got, want = _both(spark, tmp_path, "cached_entries", events=events)
    assert got == want and len(got) == 16


def test_buckets_are_counted_and_placed_by_the_same_cuts(spark):
    from tapeloom.operators import evaluation as ev

    rows = spark.range(3000).select(F.lit("US").alias("market"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.lit(dt.date(2020, 1, 1)).alias("d"), (F.col("id") * 7919 % 3000 / 7).alias("value"))
    x = ev.buckets(rows, "value")
    assert "percentile_approx" not in x._jdf.queryExecution().optimizedPlan().toString()  # worked out once, not in each branch
    got = x.orderBy("value").toPandas()["bucket"].tolist()
    assert got == [max(1, (k * 5 + 3000 - 2) // 2999) for k in range(3000)]


def test_titles_keep_entities_that_are_cut_short(spark, tmp_path):
    titles = ["a &amp; b&amp", "&quot;x &lt;y&gt; ", "&eacute;", "R&D &am", ""]
    html = [f"<html><head><title>{t}</title></head><body><ul><li>1<li class=x>2</ul><p>3</p></body></html>" for t in titles] + ["<p>no title"]
    got, want = _both(spark, tmp_path, "page_sections", pages=spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    assert got == want


def test_feed_items_are_whole_for_odd_documents(spark, tmp_path):
    texts = ["some words of it", "123 456", "", None, "x" * 400 + " y", "&lt; <b>"]
    rows = [(k, t, lang, source) for k, (t, lang, source) in enumerate((t, lang, s) for lang in ("a", "b") for s in ("desk & co", None) for t in texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, want = _both(spark, tmp_path, "feed_items", documents=docs)
    assert got == want and len(got) == 24


def test_a_listing_reads_its_header_once(spark):
    from tapeloom.operators import reads as rd

    page = "<table><tr><th>Code</th></tr>" + "".join(f"<tr><td>{k}</td></tr>" for k in range(3)) + "</table>"
    x = rd.page_tables(spark.createDataFrame([(1, page)], "page long, html string"))
    plan = x._jdf.queryExecution().optimizedPlan().toString().split("\n")
    explode = min(k for k, line in enumerate(plan) if "Generate posexplode" in line)
    assert not any("<th" in line for line in plan[:explode])  # above the explode it would be read for each row
    assert [tuple(r) for r in x.select("header", "cells").collect()] == [(["Code"], [str(k)]) for k in range(3)]


def test_a_listing_keeps_codes_of_more_than_four_places(spark, tmp_path):
    rows = [(k, f"Supplier {k}", k % 2) for k in (5, 12, 1234, 12340, 12345, 123456)]
    got, want = _both(spark, tmp_path, "listing_table", supplier=spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int"))
    assert got == want and len(got) == 6


def test_admission_reads_a_portfolio_in_batches(spark):
    from tapeloom.operators import replay as rp

    bars = [("US", f"T{t}", s, 10.0 + (s * (t + 3)) % 7, 9.0, 10.0 + (s * (t + 5)) % 7, 10.0, (s + t) % 5 == 0) for t in range(9) for s in range(1, 60) if (s * t) % 11 != 7]
    x = spark.createDataFrame(bars, "market string, ticker string, s long, o double, l double, c double, ma50 double, signal boolean")
    plans = [rp.Plan("a", slots=2, hold=9), rp.Plan("b", slots=4, risk=0.02)]
    whole = rp.admitted(x, plans)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan  # a group of pandas would hold all of a market
    rows = sorted(map(str, whole.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, rp.admitted(x, plans).collect())) == rows and len(rows) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_are_read_a_stretch_at_a_time():
    from tapeloom.sources import markup

    assert list(markup._spans([], 10)) == []
    assert list(markup._spans([4, 4, 4, 50, 0, 3], 10)) == [(0, 2), (2, 1), (3, 1), (4, 2)]


def test_plain_pages_give_the_same_tree(spark):
    import random

    from tapeloom.sources import markup

    def shown(x):
        return x if isinstance(x, str) else (x.tag, x.attrs, [shown(y) for y in x.children])

    def slow(html):
        parser = markup._Tree()
        parser.feed(html)
        parser.close()
        return parser.root

    r = random.Random(5)
    plain = ["<table>", "</table>", "<TR>", "<tr>", "<td>", "</td>", "<td colspan=2>", "<td colspan='3' class=\"a b\">", "<li>", "</li>", "<ul hidden>", "<br>", "<p a=1 a=2 b='' c=\"\">", "</p>", "a &amp; b&amp", " ", "x", "5 > 4", "&quot", "\n", "<title>t &lt;</title>", "</title>"]
    odd = ["<br/>", "<a href=/x/>", "<!-- <td> -->", "<script>if (a<b) '<td>'</script>", "<", "< td>", "<td\n x>", "</td x>", "<a b=\"&amp;\">", "<title><b></title>", "<style>", "<!DOCTYPE html>", "<a b= c>", "<td", "<a b='>'>"]
    fast = 0
    for k in range(4000):
        html = "".join(r.choice(plain if k % 2 or r.random() < 0.9 else odd) for _ in range(r.randrange(12)))
        assert shown(markup.tree(html)) == shown(slow(html)), html
        fast += markup._plain(markup._PLAIN.split(html), html.count("<"))
    assert fast > 2000


def test_bars_are_dealt_by_ticker_once(spark):
    from tapeloom.sources.panel import session_bars

    plan = session_bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bootstrap_reads_its_trades_once(spark):
    from tapeloom.operators import replay as rp

    trades = spark.range(60).select(F.lit("US").alias("market"), (F.col("id") % 7 - 3.0).alias("r"), F.uuid().alias("told"))
    x = rp.bootstrap(trades, draws=40)
    assert "Range (" not in x._jdf.queryExecution().optimizedPlan().toString()  # else the replay behind them runs once for each branch
    assert [(r["trades"], r["draws"]) for r in x.collect()] == [(60, 40)]
