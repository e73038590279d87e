"""Queries of the readers, over vendor rows made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.indicators import _r
from tapeloom.registry import query
from tapeloom.sources import vendor as vd
from tapeloom.sources.panel import BARS_SQL, bars, table


def _raw(spark, sf_dir):
    """Bars as a vendor's JSON: every seventeenth day of a month without a close, every nineteenth without a volume, every 23rd at a close of 0, volumes as strings."""
    b, dom = bars(spark, sf_dir), F.dayofmonth("d")
    close = F.when(dom == 17, None).when(dom == 23, F.lit(0.0)).otherwise(F.col("c"))
    fields = {"code": F.regexp_replace("ticker", r"\.KL$", ""), "market": F.col("market"), "date": F.col("d").cast("string"), "open": F.col("o"), "high": F.col("h"), "low": F.col("l"), "close": close, "adjusted_close": close, "volume": F.when(dom != 19, F.col("v").cast("string"))}
    return b.select(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("raw"))


_SOUND = "WHERE day(d) NOT IN (17, 19, 23)"


@query(BARS_SQL + f" SELECT market, ticker, d, o, c, v FROM bars {_SOUND}")
def bulk_bars(spark, sf_dir):
    return vd.bulk(_raw(spark, sf_dir)).select("market", "ticker", "d", "o", "c", "v")


@query(BARS_SQL + f" SELECT market, d AS mode, count(*) AS n FROM bars {_SOUND} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, d) = 1")
def modal_days(spark, sf_dir):
    return vd.modal_day(vd.bulk(_raw(spark, sf_dir)))


@query(BARS_SQL + " SELECT ticker, d, round(CASE WHEN day(d) % 5 = 0 THEN c * 1.5::DOUBLE ELSE c END, 6) AS c, v FROM bars")
def ticker_history(spark, sf_dir):
    b = bars(spark, sf_dir).withColumns({"adj": F.col("c"), "arrival": F.lit(1)})
    late = b.filter(F.dayofmonth("d") % 5 == 0).withColumns({"c": F.col("c") * 1.5, "adj": F.col("adj") * 1.5, "arrival": F.lit(2)})
    return vd.history(b.unionByName(late)).select("ticker", "d", _r(F.col("c"), "c"), "v")


_LISTED_SQL = """listing AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'X' ELSE '' END || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, s_name AS name, CASE
  WHEN s_suppkey % 7 = 0 THEN 'ETF' ELSE 'Common Stock' END AS type,
 CASE s_nationkey % 5 WHEN 0 THEN 'PINK' WHEN 1 THEN 'otc markets' ELSE 'NYSE' END AS exchange, CASE WHEN s_suppkey % 2 = 0 THEN 'MY'
  ELSE 'US' END AS market, s_suppkey AS s FROM supplier),
listings AS (SELECT *, false AS delisted FROM listing WHERE s % 4 <> 1 UNION ALL SELECT *, true FROM listing WHERE s % 3 = 0),
directory AS (SELECT market, code || CASE market WHEN 'MY' THEN '.KL' ELSE '' END AS ticker, name, type, exchange, bool_and(delisted) AS delisted
  FROM listings WHERE type = 'Common Stock' AND NOT (market = 'US' AND (exchange = 'PINK' OR exchange = 'otc markets')) AND NOT (market = 'MY'
  AND code[1] = 'X') GROUP BY ALL)"""


def _directory(spark, sf_dir):
    s = F.col("s_suppkey")
    listing = table(spark, sf_dir, "supplier").select(
        F.concat(F.when(s % 11 == 0, "X").otherwise(""), F.lpad(s.cast("string"), 5, "0")).alias("code"),
        F.col("s_name").alias("name"),
        F.when(s % 7 == 0, "ETF").otherwise("Common Stock").alias("type"),
        F.when(F.col("s_nationkey") % 5 == 0, "PINK").when(F.col("s_nationkey") % 5 == 1, "otc markets").otherwise("NYSE").alias("exchange"),
        F.when(s % 2 == 0, "MY").otherwise("US").alias("market"),
        s.alias("s"),
    )
    return vd.directory(listing.filter("s % 4 <> 1").drop("s"), listing.filter("s % 3 = 0").drop("s"))


@query("WITH " + _LISTED_SQL + " SELECT * FROM directory")
def symbol_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@query("""SELECT 'T' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, min(CAST(l_shipdate AS DATE)) AS first, count(*) AS n FROM lineitem
  WHERE l_discount = 0.1 AND l_quantity = 50 AND CAST(l_shipdate AS DATE) >= DATE '1999-06-01' GROUP BY 1""")
def splits_since(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").filter("l_discount = 0.1 and l_quantity = 50").select(F.concat(F.lit("T"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ticker"), F.to_date("l_shipdate").alias("d"))
    return vd.splits(x, "1999-06-01")


@query(BARS_SQL + """, listed AS (SELECT market, ticker, ascii(ticker[7]) % 3 = 0 AS delisted FROM bars GROUP BY ALL),
per AS (SELECT market, ticker, count(*) AS n, max(d) AS last, median(c * v) AS value FROM bars GROUP BY 1, 2)
SELECT ticker, n FROM per JOIN listed USING (market, ticker) WHERE NOT (delisted AND date_diff('day', last, DATE '2001-11-05') <= 15) AND n >= 260 AND value >= 3000000""")
def deep_history(spark, sf_dir):
    b = bars(spark, sf_dir)
    listed = b.select("market", "ticker").distinct().withColumn("delisted", F.ascii(F.substring("ticker", 7, 1)) % 3 == 0)
    return vd.deep_history(b, listed, "2001-11-05", value=3_000_000.0).groupBy("ticker").agg(F.count("*").alias("n"))


_FORMS = ["8-K", "4", "10-Q", "S-3", "144"]


@query(f"""SELECT o_custkey AS ticker, CAST(o_orderkey AS VARCHAR) AS accession, {_FORMS}[o_orderkey % 5 + 1] AS form, CAST(o_orderdate AS DATE) AS filed
  FROM orders WHERE o_orderkey % 5 IN (0, 2, 3)""")
def material_filings(spark, sf_dir):
    form = F.element_at(F.array(*(F.lit(f) for f in _FORMS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.struct(F.col("o_orderkey").cast("string").alias("accession"), form.alias("form"), F.to_date("o_orderdate").alias("filed")).alias("f"))
    lists = rows.groupBy("ticker").agg(F.collect_list("f").alias("f")).select("ticker", "f.accession", "f.form", "f.filed", F.lit(None).cast("array<string>").alias("document"))
    return vd.filings(lists.withColumn("document", F.transform("accession", lambda x: F.concat(x, F.lit(".htm"))))).select("ticker", "accession", "form", "filed")


@query("""SELECT event_id, event_type || ' ' || CAST(event_id AS VARCHAR) AS title, 'desk ' || CAST(user_id AS VARCHAR) AS publisher,
  'http://n.example/' || CAST(event_id AS VARCHAR) AS url, CAST(ts AS DATE) AS d FROM events WHERE event_id % 13 <> 0""")
def headline_shapes(spark, sf_dir):
    """Every third item nested, the others flat with a time in seconds; every thirteenth without an address."""
    k = F.col("event_id")
    title, desk = F.concat_ws(" ", "event_type", k.cast("string")), F.concat(F.lit("desk "), F.col("user_id").cast("string"))
    url = F.when(k % 13 != 0, F.concat(F.lit("http://n.example/"), k.cast("string")))
    nested = F.struct(F.struct(title.alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"), F.struct(desk.alias("displayName")).alias("provider"), F.struct(url.alias("url")).alias("canonicalUrl")).alias("content"))
    flat = F.struct(title.alias("title"), desk.alias("publisher"), url.alias("link"), F.unix_timestamp("ts").alias("providerPublishTime"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, F.to_json(nested)).otherwise(F.to_json(flat)).alias("raw"))
    return vd.news_items(rows)



@query("""WITH x AS (SELECT event_id, user_id % 10 AS u, event_id % 4 AS k, event_id % 9 AS n FROM events)
SELECT event_id, k = 0 OR k = 1 OR (n <= 2 AND n >= 1) AS relevant FROM x""")
def headline_relevance(spark, sf_dir):
    """Titles that name the ticker, the company, or neither; tags: the ticker and others, or none."""
    u, k, n = (F.col("user_id") % 10).cast("string"), F.col("event_id") % 4, F.col("event_id") % 9
    title = F.when(k == 0, F.concat(F.lit("Why T"), u, F.lit(" rose"))).when(k == 1, F.concat(F.lit("Acme"), u, F.lit(" group results"))).otherwise("Ten shares to watch")
    tags = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("T"), u, F.lit(".US"))), F.transform(F.slice(F.array(*(F.lit(f"Q{i}") for i in range(9))), F.lit(1), n.cast("int") - 1), lambda x: x)))
    x = table(spark, sf_dir, "events").withColumn("relevant", vd.relevant(title, tags, F.concat(F.lit("T"), u), F.concat(F.lit("Acme"), u, F.lit(" Holdings Bhd"))))
    return x.select("event_id", "relevant")


_FEED_SQL = """WITH items AS (SELECT event_type AS feed, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1) // 20 AS page,
  event_id AS item_id, CAST(ts AS DATE) AS d FROM events),
edge AS (SELECT CAST(max(d) - 5 AS DATE) AS since FROM items), k AS (SELECT *, d >= since AS fresh, item_id % 400 < 370 AND d < since + 3 AS known FROM items, edge),
pages AS (SELECT feed, page, count(*) FILTER (fresh) AS f, count(*) FILTER (fresh AND NOT known) AS n FROM k GROUP BY 1, 2),
ends AS (SELECT feed, least(coalesce(min(page) FILTER (f = 0), 1e9), coalesce(min(page) FILTER (n = 0) + 1, 1e9)) AS stop FROM pages GROUP BY 1)
SELECT feed, page, item_id, d FROM k JOIN ends USING (feed) WHERE fresh AND NOT known AND page < stop"""


@query(_FEED_SQL)
def feed_walk(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("feed").orderBy(F.desc("ts"), F.desc("item_id"))
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed"), F.col("event_id").alias("item_id"), "ts", F.to_date("ts").alias("d"))
    items = x.withColumn("page", F.floor((F.row_number().over(w) - 1) / 20)).drop("ts")
    since = items.agg(F.date_sub(F.max("d"), 5).cast("string")).first()[0]
    known = items.filter(f"item_id % 400 < 370 and d < date_add(date '{since}', 3)")
    return vd.feed_walk(items, known, since)


@query(BARS_SQL + """, last AS (SELECT market, max(d) AS last FROM bars GROUP BY 1) SELECT market, CAST(last + CASE market WHEN 'MY' THEN 0 ELSE 1 END AS DATE) AS session,
  last FROM last WHERE market <> 'MY'""")
def stale_markets(spark, sf_dir):
    b = bars(spark, sf_dir)
    expected = b.groupBy("market").agg(F.max("d").alias("d")).select("market", F.when(F.col("market") == "MY", F.col("d")).otherwise(F.date_add("d", 1)).alias("session"))
    return vd.stale_markets(b, expected)


@query(BARS_SQL + " SELECT DISTINCT market FROM bars WHERE d = DATE '1999-01-05'")
def session_today(spark, sf_dir):
    return vd.sessions_on(bars(spark, sf_dir), "1999-01-05")


@query("SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN -1 ELSE coalesce(value, -1) END AS value FROM events")
def finite_numbers(spark, sf_dir):
    k = F.col("event_id") % 5
    x = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(vd.finite(x), F.lit(-1.0)).alias("value"))
