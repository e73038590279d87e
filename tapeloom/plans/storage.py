"""Queries of upserts, retention, gates, sources and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import fundamentals as fu
from tapeloom.operators import storage as st
from tapeloom.plans.indicators import _r
from tapeloom.registry import query
from tapeloom.sources import markup
from tapeloom.sources.panel import BARS_SQL, bars, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("d"))


@query("""WITH last AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 1) AS n_new, round(coalesce(sum(value) FILTER (event_id % 2 = 1),
  sum(value) FILTER (event_id % 2 = 0)), 4) AS value FROM events GROUP BY 1, 2) SELECT user_id, event_type, value, CASE WHEN n_new > 0 THEN 'new'
  ELSE 'old' END AS origin FROM last""")
def upsert_by_key(spark, sf_dir):
    e = _events(spark, sf_dir)
    key = ["user_id", "event_type"]
    part = lambda k, name: e.filter(F.col("event_id") % 2 == k).groupBy(*key).agg(F.round(F.sum("value"), 4).alias("value")).withColumn("origin", F.lit(name))
    return st.upsert(part(0, "old"), part(1, "new"), key)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) <= 30")
def keep_latest(spark, sf_dir):
    return st.newest(_events(spark, sf_dir), 30, [F.desc("d"), F.desc("event_id")], ["event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id % 1000 = 3) OR event_id % 1000 = 3 GROUP BY 1")
def replace_scope(spark, sf_dir):
    e = _events(spark, sf_dir)
    return st.replace_scope(e, e.filter("event_id % 1000 = 3"), ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def purge_unlisted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return st.purge(o, table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-25' - 14 GROUP BY 1")
def prune_window(spark, sf_dir):
    """What ten sessions span: fourteen days."""
    x = st.prune(_events(spark, sf_dir), "2024-01-25", 10)
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


@query(BARS_SQL + """, rec AS (SELECT market, min(d) AS since FROM (SELECT DISTINCT market, d FROM bars QUALIFY dense_rank() OVER (PARTITION BY market
  ORDER BY d DESC) <= 3) GROUP BY 1),
ok AS (SELECT market, ticker FROM bars JOIN rec USING (market) GROUP BY 1, 2 HAVING max(d) >= max(since) AND count(*) >= 200) SELECT ticker,
  count(*) AS n, max(d) AS last FROM bars JOIN ok USING (market, ticker) GROUP BY 1""")
def load_window(spark, sf_dir):
    return st.load_window(bars(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"), F.max("d").alias("last"))


@query(BARS_SQL + """ SELECT ticker, d, round(o * f, 6) AS o, round(c * f, 6) AS c, round(v / f) AS v FROM (SELECT *, CASE WHEN day(d) % 3 = 0 THEN c * 0.5::DOUBLE
  ELSE c END / c AS f FROM bars)""")
def adjust_prices(spark, sf_dir):
    x = bars(spark, sf_dir).withColumn("adj", F.when(F.dayofmonth("d") % 3 == 0, F.col("c") * 0.5).otherwise(F.col("c")))
    return st.adjust(x).select("ticker", "d", _r(F.col("o"), "o"), _r(F.col("c"), "c"), "v")


@query(BARS_SQL + """, n AS (SELECT market, d, count(*) FILTER (v > 0) AS n FROM bars GROUP BY 1, 2), u AS (SELECT *, quantile_cont(CAST(n AS DOUBLE),
  0.5) OVER (PARTITION BY market ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS usual FROM n) SELECT market, d, n, round(coalesce(usual, 0),
  6) AS usual, coalesce(n < 0.98::DOUBLE * usual, false) AS short FROM u""")
def coverage_check(spark, sf_dir):
    x = st.coverage(bars(spark, sf_dir))
    return x.select("market", "d", "n", F.round(F.coalesce("usual", F.lit(0.0)), 6).alias("usual"), "short")


@query(BARS_SQL + """, n AS (SELECT market, d, count(*) AS n FROM bars GROUP BY 1, 2), m AS (SELECT market, d AS mode FROM n
  QUALIFY row_number() OVER (PARTITION BY market ORDER BY n DESC, d) = 1)
SELECT market, count(*) AS bars, count(DISTINCT ticker) AS tickers, min(d) AS first, max(d) AS last, max(mode) AS mode FROM bars JOIN m USING (market) GROUP BY market""")
def size_report(spark, sf_dir):
    x = bars(spark, sf_dir).groupBy("market")
    return x.agg(F.count("*").alias("bars"), F.count_distinct("ticker").alias("tickers"), F.min("d").alias("first"), F.max("d").alias("last"), F.mode("d", True).alias("mode"))


# An ordered list of rules for kinds of announcement; the first that fits decides.
KINDS = [("license", "(?i)licen[cs]e"), ("contact", r"[\w.]+@[\w.]+"), ("table", r" \| "), ("shout", "!!"), ("noise", "[#$%&*]{3}")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'text' END AS kind FROM documents")
def classify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", st.classify(F.col("text"), KINDS, "text").alias("kind"))


@query("""WITH h AS (SELECT lang AS ticker, doc_id AS item_id, split_part(trim(text), '.', 1) AS title, n_chars AS published FROM documents), o AS (SELECT *,
  regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS t FROM h), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY ticker, t
  ORDER BY published DESC, item_id) = 1) SELECT ticker, item_id FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published DESC,
  item_id) <= 20""")
def newest_headlines(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("lang").alias("ticker"), F.col("doc_id").alias("item_id"), F.split_part(F.trim("text"), F.lit("."), F.lit(1)).alias("title"), F.col("n_chars").alias("published"))
    return st.headlines(x, 20).select("ticker", "item_id")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '(' || CAST(event_id AS VARCHAR) || ')' WHEN 1
  THEN 'RM ' || CAST(event_id AS VARCHAR) || 'k' WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5%' WHEN 3 THEN 'n/a'
  ELSE CAST(event_id AS VARCHAR) || ' m' END AS s FROM events) SELECT event_id, CASE event_id % 5 WHEN 0 THEN -CAST(event_id AS DOUBLE) WHEN 1
  THEN event_id * 1000.0::DOUBLE WHEN 2 THEN event_id + 0.5::DOUBLE WHEN 4 THEN event_id * 1000000.0::DOUBLE ELSE -1 END AS value FROM t""")
def parse_numbers(spark, sf_dir):
    k, s = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("("), s, F.lit(")"))).when(k == 1, F.concat(F.lit("RM "), s, F.lit("k"))).when(k == 2, F.concat(s, F.lit(".5%"))).when(k == 3, "n/a").otherwise(F.concat(s, F.lit(" m")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(fu.number(text), F.lit(-1.0)).alias("value"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (props IS NOT NULL) AS with_props FROM events GROUP BY 1")
def event_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count("props").alias("with_props"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return st.newest(e, 1, [F.desc("ts"), F.desc("event_id")], ["user_id", "event_type"]).drop("ts")


@query("""SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, len(regexp_extract_all(html, '<li[ >]')) AS items,
  len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def page_sections(spark, sf_dir):
    """The outline of real pages, by the tokenizer that also reads their tables."""
    title = F.col("parsed.title")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(code), F.lit(char))
    x = markup.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), parts=["outline"])
    return x.select("page_id", F.trim(title).alias("title"), F.col("parsed.n_items").alias("items"), F.col("parsed.n_paragraphs").alias("paragraphs"))
