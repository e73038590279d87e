"""Queries of receipts, curves, enrichment and saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import enrich as en
from tapeloom.operators import fundamentals as fu
from tapeloom.operators import market as mk
from tapeloom.operators import receipts as rc
from tapeloom.operators import storage as st
from tapeloom.plans.fundamentals import FACTS_SQL, GROWTH_SQL, QUARTERS_SQL, _facts, quarters
from tapeloom.plans.indicators import _r
from tapeloom.registry import query
from tapeloom.sources.panel import BARS_SQL, bars, table

BUCKETS = en.BUCKETS
# A made-up board: each ticker's every fortieth bar, its prices at fixed shares of the close.
PICKS_SQL = BARS_SQL + f""",
pk0 AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d) AS k FROM bars), pk AS (SELECT *, k // 40 AS j FROM pk0 WHERE k % 40 = 0),
picks AS (SELECT market, ticker, d, {list(BUCKETS)}[j % 4 + 1] AS bucket, c, h, l, j FROM pk),
sigs AS (SELECT market, ticker, d, 'breakout' AS kind, c * 1.0625::DOUBLE AS trig, c * 0.9375::DOUBLE AS stop, c * 1.3125::DOUBLE AS target
  FROM picks WHERE bucket IN ('swing', 'watchlist')
 UNION ALL SELECT market, ticker, d, 'early_entry', c * 1.03125::DOUBLE, c * 0.96875::DOUBLE,
  c * 1.03125::DOUBLE + 2 * (c * 1.03125::DOUBLE - c * 0.96875::DOUBLE) FROM picks WHERE bucket IN ('swing', 'watchlist')
 UNION ALL SELECT market, ticker, d, 'ma20_bounce', c, c * 0.9375::DOUBLE, c + 2 * (c - c * 0.9375::DOUBLE) FROM picks WHERE j % 3 = 0
 UNION ALL SELECT market, ticker, d, 'episodic_pivot', h, l, h + 2 * (h - l) FROM picks WHERE j % 5 = 0)"""


def picks(spark, sf_dir):
    from tapeloom.functions.frames import own

    x = bars(spark, sf_dir).withColumn("k", F.row_number().over(own())).filter("k % 40 = 0").withColumn("j", F.floor(F.col("k") / 40))
    c, none = F.col("c"), F.lit(None).cast("double")
    three, five = F.col("j") % 3 == 0, F.col("j") % 5 == 0
    return x.select(
        "market", "ticker", "d", F.element_at(F.array(*(F.lit(b) for b in BUCKETS)), (F.col("j") % 4 + 1).cast("int")).alias("bucket"),
        (c * 1.0625).alias("pivot"), (c * 0.9375).alias("stop"), (c * 1.3125).alias("target2r"), (c * 1.03125).alias("early_entry_trigger"), (c * 0.96875).alias("early_entry_stop"),
        F.when(three, c).alias("ma20_bounce_trigger"), F.when(three, c * 0.9375).alias("ma20_bounce_stop"), none.alias("ma50_bounce_trigger"), none.alias("ma50_bounce_stop"),
        F.when(five, F.col("h")).alias("episodic_pivot_trigger"), F.when(five, F.col("l")).alias("episodic_pivot_stop"),
    )


@query(PICKS_SQL + " SELECT ticker, d, kind, round(trig, 6) AS trigger_price, round(stop, 6) AS stop, round(target, 6) AS target FROM sigs")
def board_signals(spark, sf_dir):
    x = rc.from_board(picks(spark, sf_dir))
    return x.select("ticker", "d", "kind", _r(F.col("trigger"), "trigger_price"), _r(F.col("stop"), "stop"), _r(F.col("target"), "target"))


RECEIPTS_SQL = PICKS_SQL + """,
old AS (SELECT * FROM sigs WHERE d >= DATE '2000-06-01' AND d < DATE '2000-09-01' QUALIFY row_number() OVER (PARTITION BY ticker, kind, round(trig, 2) ORDER BY d, stop) = 1),
recent AS (SELECT * FROM sigs WHERE d < DATE '2001-03-01' AND d >= DATE '2001-03-01' - 90),
first AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM recent) QUALIFY row_number() OVER (PARTITION BY ticker, kind, round(trig, 2) ORDER BY d, stop) = 1),
kept AS (SELECT * FROM bars WHERE d < DATE '2001-03-01' AND ticker[7] <> '3'),
nb AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d) AS k FROM kept), lastd AS (SELECT ticker, max(d) AS last FROM kept GROUP BY 1),
live AS (SELECT first.*, a.k AS k0 FROM first JOIN lastd USING (ticker) JOIN nb a USING (market, ticker, d) WHERE last > d),
aft AS (SELECT live.*, b.k - k0 - 1 AS i, b.h AS bh, b.l AS bl, b.c AS bc FROM live JOIN nb b ON b.market = live.market AND b.ticker = live.ticker AND b.k > k0 AND b.k <= k0 + 75),
tr AS (SELECT *, min(CASE WHEN i < 15 AND bh >= trig THEN i END) OVER (PARTITION BY market, ticker, d, kind) AS t FROM aft),
met AS (SELECT market, ticker, d, kind, max(t) AS t, min(CASE WHEN bl <= stop THEN i END) AS si, min(CASE WHEN bh >= target THEN i END) AS ti,
  arg_max(bc, i) AS lc FROM tr WHERE i >= t AND i < t + 60 GROUP BY 1, 2, 3, 4),
graded AS (SELECT live.*, CASE WHEN t IS NULL OR trig <= stop THEN 'never_triggered' WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'loss'
  WHEN ti IS NOT NULL THEN 'win' ELSE 'open' END AS outcome, lc FROM live LEFT JOIN met USING (market, ticker, d, kind)),
after AS (SELECT ticker, d, kind, trig, outcome, CASE outcome WHEN 'loss' THEN -1.0::DOUBLE WHEN 'win' THEN (target - trig) / (trig - stop)
  WHEN 'open' THEN (lc - trig) / (trig - stop) END AS r, DATE '2001-03-01' AS eval_d FROM graded
 UNION ALL SELECT ticker, d, kind, trig, 'never_triggered', NULL, DATE '2000-09-01' FROM old WHERE NOT EXISTS (SELECT 1 FROM graded g
  WHERE g.ticker = old.ticker AND g.kind = old.kind AND g.d = old.d))"""


@query(RECEIPTS_SQL + " SELECT ticker, d, kind, round(trig, 6) AS trigger_price, outcome, round(coalesce(r, 0), 6) AS r, eval_d FROM after")
def receipts_after_run(spark, sf_dir):
    """Signals on record from the summer of 2000, those of the last 90 days' boards, and bars of which one in ten tickers has none."""
    b = bars(spark, sf_dir).filter("d < date '2001-03-01'").filter(F.substring("ticker", 7, 1) != "3")
    board = picks(spark, sf_dir)
    old = rc.first_sightings(rc.from_board(board.filter("d >= date '2000-06-01' and d < date '2000-09-01'")))
    none = {"triggered": F.lit(False), "outcome": F.lit("never_triggered"), "r": F.lit(None).cast("double"), "days_to_trigger": F.lit(None).cast("long"), "eval_d": F.lit("2000-09-01").cast("date")}
    x = rc.evaluate(old.withColumns(none), board, b, "2001-03-01")
    return x.select("ticker", "d", "kind", _r(F.col("trigger"), "trigger_price"), "outcome", _r(F.coalesce("r", F.lit(0.0)), "r"), "eval_d")


@query(PICKS_SQL + " SELECT DISTINCT ticker FROM picks WHERE d = (SELECT max(d) FROM picks)")
def newest_board_tickers(spark, sf_dir):
    return rc.board_tickers(picks(spark, sf_dir))


CURVE_SQL = BARS_SQL + ", curve AS (SELECT market, d, sum(c) / count(c) * 1000 AS eq FROM bars GROUP BY 1, 2), p AS (SELECT *, max(eq) OVER w AS peak, eq / lag(eq) OVER w - 1 AS ret FROM curve WINDOW w AS (PARTITION BY market ORDER BY d))"


def _curve(spark, sf_dir):
    return mk.benchmark(bars(spark, sf_dir)).select("market", "d", (F.col("c") * 1000).alias("equity"))


@query(CURVE_SQL + """ SELECT market, count(*) AS days, round(arg_max(eq, d), 4) AS final_equity, round((pow(arg_max(eq, d) / 60000, 365.25 / greatest(date_diff('day',
  min(d), max(d)), 1)) - 1) * 100, 6) AS growth, round(min(eq / peak - 1) * 100, 6) AS max_drawdown,
 round(stddev_samp(ret) * sqrt(252) * 100, 6) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe,
  round(avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 6) AS sortino FROM p GROUP BY 1""")
def curve_statistics(spark, sf_dir):
    x = rc.curve_statistics(_curve(spark, sf_dir), 60_000.0)
    return x.select("market", "days", F.round("final_equity", 4).alias("final_equity"), *(_r(F.col(k), k) for k in ("growth", "max_drawdown", "volatility", "sharpe", "sortino")))


@query(CURVE_SQL + """, m AS (SELECT market, year(d) AS year, month(d) AS month, arg_max(eq, d) AS last, arg_min(eq, d) AS first FROM curve GROUP BY 1, 2, 3)
SELECT market, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, round((last / coalesce(lag(last) OVER (PARTITION BY market
  ORDER BY year, month), first) - 1) * 100, 6) AS pct FROM m""")
def monthly_returns(spark, sf_dir):
    return rc.monthly_returns(_curve(spark, sf_dir)).select("market", "year", "month", _r(F.col("pct"), "pct"))


@query(CURVE_SQL + """, f AS (SELECT market, d, eq / peak - 1 AS fall, sum(CASE WHEN eq >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY d) AS run FROM p),
g AS (SELECT market, run, min(d) AS start, max(d) AS stop, min(fall) * 100 AS depth FROM f WHERE fall < 0 GROUP BY 1, 2)
SELECT market, row_number() OVER (PARTITION BY market ORDER BY depth, start) AS place, start, stop AS "end", date_diff('day', start, stop) AS days,
  round(depth, 6) AS depth FROM g QUALIFY place <= 5""")
def worst_drawdowns(spark, sf_dir):
    x = rc.worst_drawdowns(_curve(spark, sf_dir))
    return x.select("market", F.col("place").cast("long").alias("place"), "start", "end", F.col("days").cast("long").alias("days"), _r(F.col("depth"), "depth"))


_BOARD_SQL = f"""WITH board AS (SELECT c_custkey AS id, 'C' || CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'MY' ELSE 'US' END AS market,
  {list(BUCKETS)}[c_custkey % 4 + 1] AS bucket, c_acctbal AS quality, c_mktsegment AS industry, CAST(c_custkey % 99 AS INTEGER) AS rs_rank
  FROM customer)"""


def _board(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("C"), k.cast("string")).alias("ticker"), F.when(k % 2 == 0, "MY").otherwise("US").alias("market"),
        F.element_at(F.array(*(F.lit(b) for b in BUCKETS)), (k % 4 + 1).cast("int")).alias("bucket"), F.col("c_acctbal").alias("quality"), F.col("c_mktsegment").alias("industry"), (k % 99).cast("int").alias("rs_rank"),
    )


@query(_BOARD_SQL + """, e AS (SELECT *, CASE WHEN id % 3 = 0 THEN id % 12 END AS fund, CASE WHEN id % 6 = 0 THEN 'B' END AS grade, CASE WHEN id % 4 = 0
  THEN id % 5 END AS street FROM board WHERE market = 'MY')
SELECT ticker, row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 ELSE 1 END, CASE WHEN id % 7 <= 1 THEN 0 ELSE 1 END, list_position(['swing',
  'watchlist', 'position', 'forming'], bucket), rs_rank DESC, ticker) AS place FROM e
WHERE fund IS NULL OR fund >= 7 OR grade IS NULL OR street IS NULL OR street >= 3 QUALIFY place <= 40""")
def fetch_order(spark, sf_dir):
    b, k = _board(spark, sf_dir), F.col("id")
    x = b.withColumns({"price": F.lit(100.0), "pivot": F.when(k % 7 == 0, 100.0).when(k % 7 == 1, 104.0).when(k % 7 == 2, 200.0), "live": k % 10 == 0})
    fund = b.filter("id % 3 = 0").select("ticker", (k % 12).cast("int").alias("age_days"), F.when(k % 6 == 0, "B").alias("grade"))
    street = b.filter("id % 4 = 0").select("ticker", (k % 5).cast("int").alias("age_days"))
    return en.fetch_order(x, fund, street).withColumn("place", F.col("place").cast("long"))


@query(_BOARD_SQL + """, g AS (SELECT *, ['A', 'E', NULL][id % 3 + 1] AS grade, CASE WHEN id % 5 > 0 THEN 'Name ' || ticker END AS name FROM board)
SELECT ticker, CASE WHEN bucket = 'swing' AND grade = 'E' THEN 'watchlist' ELSE bucket END AS bucket, CASE WHEN bucket = 'swing' AND grade = 'E'
  THEN 'grade_E' ELSE '' END AS demoted_by, coalesce(name, '-') AS name, CASE WHEN market = 'MY' AND industry <> 'BUILDING' THEN length(industry)
  ELSE -1 END AS group_rank, coalesce(grade, '-') AS grade FROM g""")
def enriched_board(spark, sf_dir):
    b, k = _board(spark, sf_dir), F.col("id")
    meta = b.filter("id % 5 > 0").select("ticker", F.concat(F.lit("Name "), "ticker").alias("name"))
    groups = b.filter("market = 'MY' and industry <> 'BUILDING'").select("market", "industry", F.length("industry").alias("group_rank")).distinct()
    fund = b.select("ticker", F.when(k % 3 == 0, "A").when(k % 3 == 1, "E").alias("grade"))
    x = en.enrich(b.withColumn("demoted_by", F.lit("")), meta, groups, fund)
    return x.select("ticker", "bucket", "demoted_by", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("group_rank", F.lit(-1)).alias("group_rank"), F.coalesce("grade", F.lit("-")).alias("grade"))


@query(_BOARD_SQL + """ SELECT ticker, row_number() OVER (ORDER BY list_position(['swing', 'watchlist', 'position', 'forming'], bucket), quality DESC, ticker) AS place
  FROM board QUALIFY place <= 180""")
def note_order(spark, sf_dir):
    return en.note_order(_board(spark, sf_dir)).select("ticker", F.col("place").cast("long").alias("place"))


@query("""SELECT user_id AS id, event_id, CAST(floor((epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts)) / 86400) AS INTEGER) AS age_days FROM events
  WHERE epoch(ts) > epoch(TIMESTAMP '2024-01-20 00:00:00') - 7 * 86400""")
def cached_entries(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("updated"))
    return en.cached(x, "2024-01-20 00:00:00", 7).select("id", "event_id", "age_days")


@query("""WITH s AS (SELECT DISTINCT event_type AS industry FROM events), t AS (SELECT industry, row_number() OVER (ORDER BY industry) AS place FROM s),
  u AS (SELECT industry, CASE WHEN place = 2 THEN 'in' WHEN place = 5 THEN 'out' WHEN place <= 3 THEN 'leading' END AS direction FROM t),
i AS (SELECT event_type AS industry, 'http://n.example/' || CAST(user_id AS VARCHAR) AS url, max(CAST(ts AS DATE)) AS d FROM events
  WHERE CAST(ts AS DATE) >= DATE '2024-01-03' GROUP BY 1, 2)
SELECT industry, direction, row_number() OVER (PARTITION BY industry ORDER BY d DESC, url) AS k, url, d FROM i JOIN u USING (industry)
  WHERE direction IS NOT NULL QUALIFY k <= 3""")
def rotation_news(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("market", F.lit("US"))
    place = F.row_number().over(Window.partitionBy("market").orderBy("industry"))
    sectors = e.select("market", F.col("event_type").alias("industry")).distinct().withColumn("place", place).withColumns({"rotating_in": F.col("place") == 2, "rotating_out": F.col("place") == 5})
    items = e.select("market", F.col("event_type").alias("industry"), F.concat(F.lit("http://n.example/"), F.col("user_id").cast("string")).alias("url"), F.to_date("ts").alias("d"))
    return en.rotation_news(sectors, items, "2024-01-03").select("industry", "direction", F.col("k").cast("long").alias("k"), "url", "d")


@query(BARS_SQL + """, n AS (SELECT market, ticker, d, ascii(ticker[7]) % 3 AS u FROM bars QUALIFY row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) = 1)
SELECT ticker, d, 'belowBar' AS position, 'pocket pivot' AS text FROM n WHERE u = 0 UNION ALL SELECT ticker, CAST(d - 3 AS DATE), 'belowBar',
  '20MA tag' FROM n WHERE u = 1 UNION ALL SELECT ticker, d, 'belowBar', '20MA bounce' FROM n WHERE u = 1
UNION ALL SELECT ticker, d, 'belowBar', '50MA bounce' FROM n WHERE u = 2 UNION ALL SELECT ticker, d, 'aboveBar', 'EP — verify catalyst' FROM n
  WHERE u = 2 UNION ALL SELECT ticker, d, 'belowBar', '4% burst' FROM n WHERE u = 1 UNION ALL SELECT ticker, d, 'belowBar', 'buyable gap-up' FROM n
  WHERE u = 0""")
def tactic_markers(spark, sf_dir):
    x = bars(spark, sf_dir).groupBy("market", "ticker").agg(F.max("d").alias("d")).withColumn("u", F.ascii(F.substring("ticker", 7, 1)) % 3)
    u, none = F.col("u"), F.lit(None).cast("date")
    flags = {"pocket_pivot": u == 0, "ma20_bounce": u == 1, "ma20_tag": F.date_sub("d", 3), "ma50_bounce": u == 2, "ma50_tag": none, "episodic": u == 2, "burst": u == 1, "gap_up": u == 0}
    return en.tactic_markers(x.withColumns(flags)).select("ticker", "d", "position", "text")


@query("""SELECT market, max(d) AS last_ingested FROM (SELECT event_type AS market, CAST(ts AS DATE) AS d FROM events WHERE event_id % 3 > 0) GROUP BY 1""")
def ingested_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("market"), F.col("user_id").alias("ticker"), F.to_date("ts").alias("d"), "event_id")
    part = lambda k: e.filter(F.col("event_id") % 3 == k).groupBy("market", "ticker", "d").agg(F.max("event_id").alias("v"))
    meta = part(1).groupBy("market").agg(F.max("d").alias("last_ingested"))
    return st.ingest(part(1), part(2), meta)[1]


@query("""WITH m AS (SELECT user_id AS run_day, event_type AS k, max(event_id) FILTER (event_id % 2 = 0) AS o, max(event_id) FILTER (event_id % 2 = 1) AS n
  FROM events GROUP BY 1, 2) SELECT run_day, k AS market, coalesce(n, o) AS light FROM m""")
def merged_regimes(spark, sf_dir):
    e = table(spark, sf_dir, "events")

    def part(k):
        one = e.filter(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("run_day"), "event_type").agg(F.max("event_id").alias("v"))
        return one.groupBy("run_day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("regime"))

    return st.save_run(part(0), part(1)).select("run_day", F.explode("regime").alias("market", "light"))


_NEWS_SQL = """WITH news AS (SELECT event_type AS ticker, CASE WHEN event_id % 2 = 0 THEN 'news' ELSE 'announcement' END AS kind, CASE WHEN event_id % 9 = 0
  THEN '00-' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS item_id, CASE WHEN event_id % 6 <> 1
  THEN CAST(ts AS DATE) END AS published, event_id FROM events),
last AS (SELECT max(published) AS now FROM news)"""


def _news(spark, sf_dir):
    k = F.col("event_id")
    item = F.when(k % 9 == 0, F.concat(F.lit("00-"), k.cast("string"))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.when(k % 2 == 0, "news").otherwise("announcement").alias("kind"), item.alias("item_id"), F.when(k % 6 != 1, F.to_date("ts")).alias("published"), k.alias("event_id"))


@query(_NEWS_SQL + """ SELECT ticker, kind, item_id FROM news, last WHERE kind = 'news' AND published > now - 90 QUALIFY row_number() OVER (PARTITION BY ticker
  ORDER BY published DESC, item_id) <= 12
UNION ALL (SELECT ticker, kind, item_id FROM news WHERE kind = 'announcement' QUALIFY row_number() OVER (PARTITION BY ticker
  ORDER BY published DESC NULLS LAST, CASE WHEN regexp_matches(item_id, '^[0-9]+$') THEN CAST(item_id AS BIGINT) END DESC NULLS LAST, item_id) <= 10)""")
def news_window(spark, sf_dir):
    x = _news(spark, sf_dir)
    now = x.agg(F.max("published").cast("string")).first()[0]
    return st.news_window(x, now).select("ticker", "kind", "item_id")


@query(_NEWS_SQL + """, o AS (SELECT * FROM news WHERE event_id % 4 < 3), n AS (SELECT ticker, kind, CASE WHEN event_id % 10 <> 7 THEN item_id END AS item_id, CASE
  WHEN event_id % 5 > 0 THEN CAST(published + 1 AS DATE) END AS published FROM news WHERE event_id % 4 > 1)
SELECT coalesce(n.kind, o.kind) AS kind, coalesce(n.item_id, o.item_id) AS item_id, coalesce(CAST(coalesce(n.published, o.published) AS VARCHAR),
  '-') AS published FROM o FULL JOIN (SELECT * FROM n WHERE item_id IS NOT NULL) n USING (kind, item_id)""")
def saved_news(spark, sf_dir):
    x, k = _news(spark, sf_dir), F.col("event_id")
    new = x.filter(k % 4 > 1).select("ticker", "kind", F.when(k % 10 != 7, F.col("item_id")).alias("item_id"), F.when(k % 5 > 0, F.date_add("published", 1)).alias("published"))
    y = st.save_news(x.filter(k % 4 < 3).drop("event_id"), new)
    return y.select("kind", "item_id", F.coalesce(F.col("published").cast("string"), F.lit("-")).alias("published"))


@query(BARS_SQL + " SELECT ticker, count(*) AS n, round(sum(CASE WHEN ascii(ticker[7]) % 4 = 0 THEN c / 2 ELSE c END), 4) AS total FROM bars GROUP BY 1")
def repulled_tickers(spark, sf_dir):
    b = bars(spark, sf_dir)
    hit = F.ascii(F.substring("ticker", 7, 1)) % 4
    x = st.repull(b, b.filter(hit <= 1).select("ticker"), b.filter(hit == 0).withColumn("c", F.col("c") / 2))
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("total"))


@query(QUARTERS_SQL + ", q AS (SELECT * FROM quarters WHERE q_end >= DATE '2000-06-30' OR ticker[1] = 'B') SELECT ticker, count(*) AS n FROM q GROUP BY 1 HAVING count(*) >= 8")
def complete_quarters(spark, sf_dir):
    q = quarters(spark, sf_dir).filter("q_end >= date '2000-06-30' or substr(ticker, 1, 1) = 'B'")
    return fu.complete(q, 8).groupBy("ticker").agg(F.count("*").alias("n"))


_SERIES = "SELECT ticker, en, val FROM facts WHERE tag = '{tag}' AND CASE WHEN frame IS NOT NULL THEN regexp_matches(frame, '^CY[0-9]{{4}}Q[1-4]$') ELSE date_diff('day', st, en) BETWEEN 75 AND 100 END AND en >= DATE '1997-12-31' AND {gap} QUALIFY row_number() OVER (PARTITION BY ticker, en ORDER BY filed DESC, val) = 1"


@query(FACTS_SQL + f""", rev AS ({_SERIES.format(tag='Revenues', gap="NOT (month(en) = 9 AND ascii(ticker[2]) % 2 = 0)")}),
  inc AS ({_SERIES.format(tag='SalesRevenueNet', gap='true')}), eps AS ({_SERIES.format(tag='Other', gap='month(en) <> 12')}),
have AS (SELECT ticker, en FROM rev JOIN inc USING (ticker, en)), ok AS (SELECT ticker FROM have GROUP BY 1 HAVING count(*) >= 5),
  newest AS (SELECT ticker, max(en) AS top FROM have JOIN ok USING (ticker) GROUP BY 1),
slots AS (SELECT ticker, s AS slot, CAST(date_trunc('month', top) - s * INTERVAL 3 MONTH + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS q FROM newest, range(12) r(s))
SELECT slots.ticker, slot, CASE WHEN have.en IS NOT NULL THEN q END AS filed, coalesce(rev.val, -1) AS revenue, coalesce(inc.val, -1) AS net_income,
  coalesce(eps.val, -1) AS eps FROM slots LEFT JOIN have ON have.ticker = slots.ticker AND have.en = q LEFT JOIN rev ON have.ticker = rev.ticker
  AND have.en = rev.en LEFT JOIN inc ON have.ticker = inc.ticker AND have.en = inc.en LEFT JOIN eps ON have.ticker = eps.ticker AND have.en = eps.en""")
def filed_quarters(spark, sf_dir):
    f, end = _facts(spark, sf_dir), F.col("end")
    series = lambda tag: fu.flow_series(f, [tag], "2001-12-31")
    rev = series("Revenues").filter(~((F.month(end) == 9) & (F.ascii(F.substring("ticker", 2, 1)) % 2 == 0)))
    x = fu.from_filed(rev, series("SalesRevenueNet"), series("Other").filter(F.month(end) != 12))
    filed = F.when(F.col("revenue").isNotNull(), F.col("q_end"))
    return x.select("ticker", F.col("slot").cast("long").alias("slot"), filed.alias("filed"), *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("revenue", "net_income", "eps")))


@query(GROWTH_SQL + """, r4 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY q_end DESC) AS r FROM quarters), roe AS (SELECT ticker,
  round(sum(net_income) / (1.0e9::DOUBLE + ascii(ticker) * 1.0e7::DOUBLE) * 100, 1) AS roe FROM r4 WHERE r <= 4 GROUP BY 1 HAVING count(*) >= 4),
reg AS (SELECT DISTINCT ticker FROM quarters UNION SELECT 'UNKNOWN'), b AS (SELECT reg.ticker, q_end, roe, [coalesce(ep, ni) >= 25, rev >= 20, CASE
  WHEN ep1 IS NOT NULL OR ni1 IS NOT NULL THEN eacc OR acc END, CASE WHEN coalesce(abs(m) > 100, false) THEN NULL ELSE md > 0 END,
  roe >= 17] AS boxes FROM reg LEFT JOIN g USING (ticker) LEFT JOIN roe USING (ticker)),
k AS (SELECT *, len(list_filter(boxes, lambda z: z IS NOT NULL)) AS known, len(list_filter(boxes, lambda z: z)) AS good FROM b),
s AS (SELECT ticker, q_end, roe, CASE WHEN q_end IS NOT NULL AND known >= 3 THEN CASE WHEN good / known >= 0.8 THEN 'A' WHEN good / known >= 0.6
  THEN 'B' WHEN good / known >= 0.4 THEN 'C' WHEN good / known >= 0.2 THEN 'D' ELSE 'E' END END AS grade FROM k)
SELECT ticker, round(coalesce(CASE WHEN q_end IS NOT NULL THEN roe END, -1), 1) AS roe, coalesce(grade, '-') AS grade, coalesce(CASE
  WHEN q_end IS NULL THEN 'too few quarters with both revenue and income' WHEN grade IS NULL THEN 'too few gradeable measures' END, '-') AS withheld
  FROM s""")
def withheld_grades(spark, sf_dir):
    q = quarters(spark, sf_dir)
    income = q.select("ticker", F.col("q_end").alias("end"), F.col("net_income").alias("val"))
    equity = q.select("ticker").distinct().withColumn("val", F.lit(1.0e9) + F.ascii("ticker") * 1.0e7)
    extra = spark.createDataFrame([("UNKNOWN",)], "ticker string")
    x = fu.graded(fu.growth(q), fu.trailing_roe(income, equity), q.select("ticker").union(extra))
    return x.select("ticker", F.coalesce("roe", F.lit(-1.0)).alias("roe"), F.coalesce("grade", F.lit("-")).alias("grade"), F.coalesce("withheld", F.lit("-")).alias("withheld"))


@query(QUARTERS_SQL + """, x AS (SELECT ticker, q_end, CASE WHEN month(q_end) <> 12 THEN round(net_income / revenue * 10, 4) END AS roe FROM quarters) SELECT ticker,
  round(arg_max(roe, q_end) FILTER (roe IS NOT NULL) * 4, 1) AS roe FROM x GROUP BY 1 HAVING count(roe) > 0""")
def quarterly_roe(spark, sf_dir):
    x = quarters(spark, sf_dir).select("ticker", "q_end", F.when(F.month("q_end") != 12, F.round(F.col("net_income") / F.col("revenue") * 10, 4)).alias("roe"))
    return fu.annual_roe(x)


@query("""WITH e AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS ticker, 'H' || CAST(o_custkey % 13 AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 = 0 THEN -1
  ELSE 1 END * CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE CAST(o_orderdate AS DATE) >= DATE '2000-12-31' - 90),
h AS (SELECT ticker, name, sum(s) AS net, sum(greatest(s, 0)) AS up, sum(greatest(-s, 0)) AS down FROM e GROUP BY 1, 2), p AS (SELECT *,
  row_number() OVER (PARTITION BY ticker ORDER BY abs(net) DESC, name) AS k FROM h)
SELECT ticker, CAST(sum(up) AS BIGINT) AS acquired, CAST(sum(down) AS BIGINT) AS disposed, CAST(sum(net) AS BIGINT) AS net, string_agg(name, ','
  ORDER BY k) FILTER (k <= 5) AS holders FROM p GROUP BY 1""")
def shareholding_moves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Disposed").otherwise(" Acquired ")
    e = o.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"), F.concat(F.lit("H"), (F.col("o_custkey") % 13).cast("string")).alias("name"), kind.alias("kind"), F.floor("o_totalprice").alias("shares"), F.to_date("o_orderdate").alias("d"))
    x = fu.shareholding(e, "2000-12-31")
    return x.select("ticker", "acquired", "disposed", "net", F.array_join("holders", ",").alias("holders"))
