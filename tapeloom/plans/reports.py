"""Queries of the reports: exits, filing windows, grouped news, regimes of trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import enrich as en
from tapeloom.operators import fundamentals as fu
from tapeloom.operators import replay as rp
from tapeloom.plans import market as mk_plans
from tapeloom.plans.evaluation import REPLAY_SQL, _flagged
from tapeloom.plans.fundamentals import QUARTERS_SQL, quarters
from tapeloom.plans.indicators import _r
from tapeloom.registry import ORACLE_SQL, query
from tapeloom.sources.panel import BARS_SQL, SESSION_SQL, session_bars, table


@query("SELECT reason, count(*) AS n, round(sum(px - entry), 1) AS points FROM (" + ORACLE_SQL["replay_candidates"] + ") WHERE reason <> 'open' GROUP BY 1")
def exits_by_reason(spark, sf_dir):
    x = rp.candidates(_flagged(spark, sf_dir)).filter("reason is not null")
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum(F.round("px", 6) - F.round("entry", 6)), 1).alias("points"))


@query(QUARTERS_SQL + """ SELECT ticker, CAST(max(q_end) + 151 AS DATE) AS expected, date_diff('day', DATE '2001-11-15', CAST(max(q_end) + 151 AS DATE)) AS days,
  date_diff('day', DATE '2001-11-15', CAST(max(q_end) + 151 AS DATE)) BETWEEN -7 AND 14 AS high_risk FROM quarters WHERE q_end <= DATE '2001-11-15'
  GROUP BY 1""")
def filing_windows(spark, sf_dir):
    return fu.report_window(quarters(spark, sf_dir), "2001-11-15").withColumn("days", F.col("days").cast("long"))


@query("""WITH top AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 3), ranked AS (SELECT lang, doc_id, n_chars,
  row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents JOIN top USING (lang)) SELECT lang, doc_id, place
  FROM ranked WHERE place <= 2""")
def grouped_news(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("-").alias("market"), F.col("lang").alias("industry"), F.col("doc_id").alias("ticker"), F.col("n_chars").alias("rs_rank"))
    return en.leading_counters(docs).select(F.col("industry").alias("lang"), F.col("ticker").alias("doc_id"), F.col("place").cast("long").alias("place"))


@query(REPLAY_SQL + """, rg AS (SELECT market, s AS entry_s, light FROM days JOIN regime USING (market, d))
SELECT market, coalesce(light, 'unmeasured') AS light, count(*) AS trades, round(avg(r), 6) AS expectancy, round(count(*) FILTER (r > 0) / count(*),
  6) AS win_rate, count(*) < 20 AS thin FROM trades LEFT JOIN rg USING (market, entry_s) GROUP BY 1, 2""".replace("regime USING", f"({mk_plans.REGIME_SQL.replace(BARS_SQL, SESSION_SQL)} SELECT * FROM regime) USING"))
def trades_by_regime(spark, sf_dir):
    """Trades by the benchmark's light on the entry session; thin under 20 trades."""
    flagged = _flagged(spark, sf_dir)
    lights = mk_plans.regime(session_bars(spark, sf_dir)).select("market", "d", "light")
    days = flagged.groupBy("market", F.col("s").cast("long").alias("entry_s")).agg(F.min("d").alias("d")).join(lights, ["market", "d"]).select("market", "entry_s", "light")
    x = rp.replay(flagged).join(days, ["market", "entry_s"], "left").groupBy("market", F.coalesce("light", F.lit("unmeasured")).alias("light")).agg(F.count("*").alias("trades"), F.avg("r").alias("expectancy"), (F.count_if(F.col("r") > 0) / F.count("*")).alias("win_rate"))
    return x.select("market", "light", "trades", _r(F.col("expectancy"), "expectancy"), _r(F.col("win_rate"), "win_rate"), (F.col("trades") < 20).alias("thin"))
