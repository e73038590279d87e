"""Queries that grade signals and replay portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.operators import evaluation as ev
from tapeloom.operators import replay as rp
from tapeloom.operators import signals as sg
from tapeloom.plans.indicators import _r
from tapeloom.plans.signals import GRID_SQL, SQL
from tapeloom.registry import query
from tapeloom.sources.panel import session_bars

KINDS = ("donchian", "undercut_rally")


def _signals(x):
    one = [sg.signals(x, k).filter("signal").select("market", "ticker", "d", F.lit(k).alias("kind"), F.col("h").alias("trigger"), (F.col("h") * 0.92).alias("stop"), (F.col("h") * 1.16).alias("target")) for k in KINDS]
    return one[0].unionByName(one[1])


def _outcomes(spark, sf_dir):
    b = session_bars(spark, sf_dir)
    return ev.grade(_signals(sg.session_features(b)), b)


_y, _z = SQL["undercut_rally"].split(" SELECT ticker, d FROM z WHERE ")
_y = _y.replace(", y AS", ", uy AS").replace("FROM y)", "FROM uy)").replace(", z AS", ", uz AS")
_dz, _dw = SQL["donchian"].split(" SELECT ticker, d FROM z WHERE ")
OUTCOMES_SQL = GRID_SQL + _y + _dz.replace(", z AS", ", dz AS") + f""",
sig AS (SELECT market, ticker, d, 'donchian' AS kind, h AS trig, h * 0.92::DOUBLE AS stop, h * 1.16::DOUBLE AS target FROM dz WHERE {_dw}
  UNION ALL SELECT market, ticker, d, 'undercut_rally', h, h * 0.92::DOUBLE, h * 1.16::DOUBLE FROM uz WHERE {_z}),
nb AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY d) AS k FROM bars),
placed AS (SELECT sig.*, a.k AS k0, unnest(list_distinct([(a.k + 1) // 75, (a.k + 75) // 75])) AS stretch FROM sig JOIN nb a USING (market, ticker, d)),
aft AS (SELECT p.market, p.ticker, p.d, kind, trig, stop, target, b.k - k0 - 1 AS i, b.h, b.l, b.c FROM placed p JOIN (SELECT *, k // 75 AS stretch FROM nb) b
  ON b.market = p.market AND b.ticker = p.ticker AND b.stretch = p.stretch WHERE b.k > k0 AND b.k <= k0 + 75),
tr AS (SELECT *, min(CASE WHEN i < 15 AND h >= trig THEN i END) OVER (PARTITION BY market, ticker, d, kind) AS t FROM aft),
met AS (SELECT market, ticker, d, kind, max(t) AS t, min(CASE WHEN l <= stop THEN i END) AS si, min(CASE WHEN h >= target THEN i END) AS ti,
  arg_max(c, i) AS lc FROM tr WHERE i >= t AND i < t + 60 GROUP BY 1, 2, 3, 4),
oc AS (SELECT sig.*, t, si, ti, lc, CASE WHEN t IS NULL THEN 'never_triggered' WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'loss'
  WHEN ti IS NOT NULL THEN 'win' ELSE 'open' END AS outcome FROM sig LEFT JOIN met USING (market, ticker, d, kind)),
outcomes AS (SELECT market, ticker, d, kind, t IS NOT NULL AS triggered, outcome, CASE outcome WHEN 'loss' THEN -1.0::DOUBLE WHEN 'win'
  THEN (target - trig) / (trig - stop) WHEN 'open' THEN (lc - trig) / (trig - stop) END AS r, t FROM oc)"""


@query(OUTCOMES_SQL + " SELECT market, ticker, d, kind, triggered, outcome, round(coalesce(r, 0), 6) AS r, coalesce(t, -1) AS days FROM outcomes")
def signal_outcomes(spark, sf_dir):
    x = _outcomes(spark, sf_dir)
    return x.select("market", "ticker", "d", "kind", "triggered", "outcome", _r(F.coalesce("r", F.lit(0.0)), "r"), F.coalesce("days_to_trigger", F.lit(-1)).cast("long").alias("days"))


@query(OUTCOMES_SQL + """ SELECT market, kind, count(*) AS signals, count(*) FILTER (triggered) AS triggered, count(*) FILTER (outcome = 'win') AS wins,
  round(count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome IN ('win', 'loss')), 0), 6) AS win_rate,
 round(avg(r), 6) AS mean_r, round(sum(r) FILTER (r > 0) / sum(-r) FILTER (r <= 0), 6) AS profit_factor, round(avg(t), 6) AS days,
 CASE WHEN avg(r) FILTER (d >= DATE '2001-06-01') IS NULL THEN 'none' WHEN avg(r) FILTER (d >= DATE '2001-06-01') < avg(r) - 0.3 THEN 'cooling'
  WHEN avg(r) FILTER (d >= DATE '2001-06-01') > avg(r) + 0.3 THEN 'heating' ELSE 'steady' END AS drift FROM outcomes GROUP BY 1, 2""")
def strategy_scoreboard(spark, sf_dir):
    x = ev.scoreboard(_outcomes(spark, sf_dir), "2001-07-01")
    return x.select("market", "kind", "signals", "triggered", "wins", _r(F.col("win_rate"), "win_rate"), _r(F.col("mean_r"), "mean_r"), _r(F.col("profit_factor"), "profit_factor"), _r(F.col("days"), "days"), "drift")


@query(OUTCOMES_SQL + """ SELECT market, strftime(d, '%Y-%m') AS month, count(*) AS signals, count(*) FILTER (outcome = 'win') AS wins, round(sum(r), 6) AS total_r
  FROM outcomes GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY market ORDER BY month DESC) <= 6""")
def outcomes_by_month(spark, sf_dir):
    from pyspark.sql import Window

    x = _outcomes(spark, sf_dir).groupBy("market", F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("signals"), F.count_if(F.col("outcome") == "win").alias("wins"), F.sum("r").alias("total_r"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("month")))).filter("k <= 6").select("market", "month", "signals", "wins", _r(F.col("total_r"), "total_r"))


@query(OUTCOMES_SQL + """, dd AS (SELECT market, kind, d, sum(coalesce(r, 0)) AS r FROM outcomes GROUP BY 1, 2, 3) SELECT market, kind, d,
  round(sum(r) OVER (PARTITION BY market, kind ORDER BY d), 5) AS cumulative_r FROM dd""")
def cumulative_r_curve(spark, sf_dir):
    from pyspark.sql import Window

    x = _outcomes(spark, sf_dir).groupBy("market", "kind", "d").agg(F.sum(F.coalesce("r", F.lit(0.0))).alias("r"))
    return x.select("market", "kind", "d", F.round(F.sum("r").over(Window.partitionBy("market", "kind").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)), 5).alias("cumulative_r"))


FACTOR_SQL = GRID_SQL + """,
own2 AS (SELECT *, lead(c, 20) OVER (PARTITION BY market, ticker ORDER BY d) AS c20 FROM bars),
cand AS (SELECT market, ticker, CAST(d - INTERVAL 0 DAY AS DATE) AS d, rs_rank FROM grid WHERE rs_rank IS NOT NULL AND s % 20 = 0),
fwd AS (SELECT cand.*, (c20 / c - 1) * 100 AS fwd FROM cand ASOF JOIN (SELECT market AS m2, ticker AS t2, d AS d2, c, c20 FROM own2) o ON m2 = market
  AND t2 = ticker AND d <= d2 WHERE c20 IS NOT NULL AND c > 0),
rn AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY rs_rank, ticker, d) AS k, count(*) OVER (PARTITION BY market) AS n FROM fwd),
bk AS (SELECT *, CAST(greatest(1, ((k - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS bucket FROM rn),
st AS (SELECT market, bucket, count(*) AS n, avg(fwd) AS mean, median(fwd) AS med, count(*) FILTER (fwd > 0) / count(*) * 100 AS win FROM bk GROUP BY 1, 2),
up AS (SELECT *, coalesce(mean >= lag(mean) OVER (PARTITION BY market ORDER BY bucket), true) AS up FROM st)"""


@query(FACTOR_SQL + """ SELECT market, bucket, n, round(mean, 6) AS mean, round(med, 6) AS median, round(win, 6) AS win, bool_and(up) OVER (PARTITION BY market)
  AND count(*) OVER (PARTITION BY market) >= 3 AS monotone FROM up QUALIFY sum(n) OVER (PARTITION BY market) >= 30""")
def factor_buckets(spark, sf_dir):
    b = session_bars(spark, sf_dir)
    rows = sg.session_features(b).filter("rs_rank is not null and s % 20 = 0").select("market", "ticker", "d", "rs_rank")
    x = ev.factor_table(ev.buckets(ev.forward_returns(rows, b), "rs_rank"))
    return x.select("market", "bucket", "n", _r(F.col("mean"), "mean"), _r(F.col("median"), "median"), _r(F.col("win"), "win"), "monotone")


@query(GRID_SQL + """,
own2 AS (SELECT *, lead(c, 20) OVER (PARTITION BY market, ticker ORDER BY d) AS c20 FROM bars),
cand AS (SELECT market, ticker, d, rs_rank, c / ma50 AS stretch, CASE WHEN s % 40 = 0 THEN v / vol50 END AS surge FROM grid WHERE s % 20 = 0),
fwd AS (SELECT cand.*, (c20 / c - 1) * 100 AS fwd FROM cand ASOF JOIN (SELECT market AS m2, ticker AS t2, d AS d2, c, c20 FROM own2) o ON m2 = market
  AND t2 = ticker AND d <= d2 WHERE c20 IS NOT NULL AND c > 0),
long AS (SELECT market, ticker, d, fwd, 'rs_rank' AS factor, rs_rank AS value FROM fwd UNION ALL SELECT market, ticker, d, fwd, 'stretch', stretch
  FROM fwd UNION ALL SELECT market, ticker, d, fwd, 'surge', surge FROM fwd),
rn AS (SELECT *, row_number() OVER (PARTITION BY market, factor ORDER BY value, ticker, d) AS k, count(*) OVER (PARTITION BY market, factor) AS n
  FROM long WHERE value IS NOT NULL),
bk AS (SELECT *, CAST(greatest(1, ((k - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS bucket FROM rn),
st AS (SELECT market, factor, bucket, count(*) AS n, avg(fwd) AS mean, median(fwd) AS med, count(*) FILTER (fwd > 0) / count(*) * 100 AS win FROM bk GROUP BY 1, 2, 3),
up AS (SELECT *, coalesce(mean >= lag(mean) OVER (PARTITION BY market, factor ORDER BY bucket), true) AS up FROM st)
SELECT market, factor, bucket, n, round(mean, 6) AS mean, round(med, 6) AS median, round(win, 6) AS win, bool_and(up) OVER (PARTITION BY market,
  factor) AND count(*) OVER (PARTITION BY market, factor) >= 3 AS monotone FROM up QUALIFY sum(n) OVER (PARTITION BY market, factor) >= 30""")
def factors_compared(spark, sf_dir):
    """Several factors of a board at once: momentum rank, distance from the 50-day mean, volume surge."""
    b, by = session_bars(spark, sf_dir), ("market", "factor")
    x = sg.session_features(b).filter("s % 20 = 0")
    rows = x.select("market", "ticker", "d", "rs_rank", (F.col("c") / F.col("ma50")).alias("stretch"), F.when(F.col("s") % 40 == 0, F.col("v") / F.col("vol50")).alias("surge"))
    long = ev.unpivoted(ev.forward_returns(rows, b), ["rs_rank", "stretch", "surge"])
    y = ev.factor_table(ev.buckets(long, "value", by=by), by)
    return y.select(*by, "bucket", "n", _r(F.col("mean"), "mean"), _r(F.col("median"), "median"), _r(F.col("win"), "win"), "monotone")


@query(GRID_SQL + """,
own2 AS (SELECT *, lead(c, 20) OVER (PARTITION BY market, ticker ORDER BY d) AS c20 FROM bars),
cand AS (SELECT market, ticker, d, ['A', 'B', 'C', 'D', 'E', 'none'][ascii(ticker[7]) % 6 + 1] AS grade FROM grid WHERE s % 20 = 0),
fwd AS (SELECT cand.*, (c20 / c - 1) * 100 AS fwd, list_position(['E', 'D', 'C', 'B', 'A'], grade) AS place FROM cand ASOF JOIN (SELECT market AS m2,
  ticker AS t2, d AS d2, c, c20 FROM own2) o ON m2 = market AND t2 = ticker AND d <= d2 WHERE c20 IS NOT NULL AND c > 0),
st AS (SELECT market, grade, place, count(*) AS n, avg(fwd) AS mean, median(fwd) AS med FROM fwd WHERE place > 0 GROUP BY 1, 2, 3), up AS (SELECT *,
  coalesce(mean >= lag(mean) OVER (PARTITION BY market ORDER BY place), true) AS up FROM st)
SELECT market, grade, n, round(mean, 6) AS mean, round(med, 6) AS median, bool_and(up) OVER (PARTITION BY market)
  AND count(*) OVER (PARTITION BY market) >= 3 AS monotone FROM up QUALIFY sum(n) OVER (PARTITION BY market) >= 30""")
def grades_compared(spark, sf_dir):
    b = session_bars(spark, sf_dir)
    letter = F.element_at(F.array(*(F.lit(x) for x in ("A", "B", "C", "D", "E", "none"))), F.ascii(F.substring("ticker", 7, 1)) % 6 + 1)
    rows = sg.session_features(b).filter("s % 20 = 0").select("market", "ticker", "d", letter.alias("grade"))
    x = ev.graded_table(ev.forward_returns(rows, b))
    return x.select("market", "grade", "n", _r(F.col("mean"), "mean"), _r(F.col("median"), "median"), "monotone")


def _flagged(spark, sf_dir, strategy="donchian"):
    return sg.signals(sg.session_features(session_bars(spark, sf_dir)), strategy)


def candidate_sql(stop: float, hold: int) -> str:
    return GRID_SQL + _dz.replace(", z AS", ", dz AS") + f""",
e0 AS (SELECT *, row_number() OVER w AS k, lag(s) OVER w AS ps, lag(coalesce({_dw}, false)) OVER w AS was FROM dz WINDOW w AS (PARTITION BY market, ticker ORDER BY s)),
ent AS (SELECT market, ticker, s AS entry_s, k AS k0, o * (1 + CASE market WHEN 'MY' THEN 0.0030::DOUBLE ELSE 0.0010::DOUBLE END) AS entry,
  coalesce(o >= ma50, false) AS armed0, l AS l0 FROM e0 WHERE ps = s - 1 AND was AND o > 0),
pth AS (SELECT ent.*, entry * (1 - {stop}::DOUBLE) AS stop, b.s AS s1, b.k, b.o, b.l, b.c, b.ma50, armed0
  OR coalesce(bool_or(b.c >= b.ma50) OVER (PARTITION BY ent.market, ent.ticker, k0 ORDER BY b.k), false) AS armed
  FROM (SELECT *, unnest(list_distinct([(k0 + 1) // {hold}, (k0 + {hold}) // {hold}])) AS stretch FROM ent) ent
  JOIN (SELECT *, k // {hold} AS stretch FROM e0) b ON b.market = ent.market AND b.ticker = ent.ticker AND b.stretch = ent.stretch
    AND b.k > k0 AND b.k <= k0 + {hold}),
hw AS (SELECT *, CASE WHEN l <= stop THEN 'stop' WHEN armed AND c < ma50 THEN 'ma50_break' WHEN k - k0 >= {hold} THEN 'time' END AS reason, CASE
  WHEN l <= stop THEN least(stop, o) ELSE c END AS px FROM pth),
fin AS (SELECT * FROM hw WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, ticker, k0 ORDER BY k) = 1),
cand AS (SELECT ent.market, ent.ticker, ent.entry_s, ent.k0, ent.entry, ent.entry * (1 - {stop}::DOUBLE) AS stop, ent.l0 <= ent.entry * (1 - {stop}::DOUBLE) AS at_once,
  CASE WHEN at_once THEN 'stop' ELSE fin.reason END AS reason, CASE WHEN at_once THEN ent.entry_s ELSE fin.s1 END AS exit_s, CASE WHEN at_once
  THEN ent.entry * (1 - {stop}::DOUBLE) ELSE fin.px END AS px, CASE WHEN at_once THEN 0 ELSE fin.k - ent.k0 END AS held FROM ent LEFT
  JOIN fin USING (market, ticker, k0))"""


CAND_SQL = candidate_sql(config.STOP, config.MAX_HOLD)
#: Costs of a market, for the portfolio replay: a session a step, who leaves, who enters in ticker order while slots and cash last, then the mark.
_SLIP, _FEE = (f"CASE market {' '.join(f'WHEN {m!r} THEN {v[k]}::DOUBLE' for m, v in config.MARKETS.items())} END" for k in ("slip", "fee"))


def replay_sql(stop: float = config.STOP, hold: int = config.MAX_HOLD, risk: float = config.RISK, slots: int = config.SLOTS) -> str:
    return candidate_sql(stop, hold).replace("WITH daily", "WITH RECURSIVE daily", 1) + f""",
enter AS (SELECT market, entry_s AS s, list({{'ticker': ticker, 'entry_s': entry_s, 'entry': entry, 'stop': stop, 'exit_s': exit_s, 'px': px, 'held': held, 'reason': reason}} ORDER BY ticker) AS cs FROM cand GROUP BY 1, 2),
asked AS (SELECT DISTINCT market, ticker FROM cand),
marks AS (SELECT market, s, map_from_entries(list((ticker, c))) AS price FROM num JOIN asked USING (market, ticker) GROUP BY 1, 2),
edge AS (SELECT market, min(s) AS first, max(s) AS last, {_SLIP} AS slip, {_FEE} AS fee FROM num GROUP BY 1),
sess AS MATERIALIZED (SELECT d.market, d.s, slip, fee, coalesce(cs, []) AS cs, price FROM (SELECT DISTINCT market, s FROM num) d
  JOIN edge USING (market) LEFT JOIN enter USING (market, s) LEFT JOIN marks USING (market, s)),
run AS (
  SELECT market, first AS s, {config.START}::DOUBLE AS cash, {config.START}::DOUBLE AS eq, []::STRUCT(ticker VARCHAR, entry_s BIGINT, entry DOUBLE,
  stop DOUBLE, exit_s BIGINT, px DOUBLE, held BIGINT, reason VARCHAR, shares BIGINT)[] AS held_, []::STRUCT(ticker VARCHAR, entry_s BIGINT,
  entry DOUBLE, stop DOUBLE, exit_s BIGINT, px DOUBLE, held BIGINT, reason VARCHAR, shares BIGINT)[] AS done FROM edge
  UNION ALL
  SELECT market, s, st.cash, st.cash + coalesce(list_sum(list_transform(st.open, lambda p: p.shares * coalesce(price[p.ticker], p.entry))), 0),
  st.open, list_concat(gone, st.done) FROM (
    SELECT market, s, price, gone, list_reduce(cs, lambda st, x: CASE WHEN len(st.open) >= {slots} OR list_contains(list_transform(st.open,
  lambda p: p.ticker), x.ticker) OR x.shares <= 0 OR x.shares * x.entry * (1 + fee) > st.cash THEN st
      WHEN x.exit_s = s THEN {{'cash': st.cash - x.shares * x.entry * (1 + fee) + x.shares * (x.px * (1 - slip)) - x.shares * (x.px * (1 - slip)) * fee, 'open': st.open, 'done': list_append(st.done, x)}}
      ELSE {{'cash': st.cash - x.shares * x.entry * (1 + fee), 'open': list_append(st.open, x), 'done': st.done}} END,
      {{'cash': cash + coalesce(list_sum(list_transform(gone, lambda p: p.shares * (p.px * (1 - slip)) - p.shares * (p.px * (1 - slip)) * fee)), 0), 'open': stay, 'done': []::STRUCT(ticker VARCHAR, entry_s BIGINT, entry DOUBLE, stop DOUBLE, exit_s BIGINT, px DOUBLE, held BIGINT, reason VARCHAR, shares BIGINT)[]}}) AS st FROM (
      SELECT sess.market, sess.s, slip, fee, price, cash, list_filter(held_, lambda p: coalesce(p.exit_s = sess.s, false)) AS gone, list_filter(held_,
  lambda p: coalesce(p.exit_s <> sess.s, true)) AS stay,
        list_transform(cs, lambda x: {{'ticker': x.ticker, 'entry_s': CAST(x.entry_s AS BIGINT), 'entry': x.entry, 'stop': x.stop, 'exit_s': CAST(x.exit_s AS BIGINT), 'px': x.px, 'held': CAST(x.held AS BIGINT), 'reason': x.reason, 'shares': CAST(least(floor(eq * {risk}::DOUBLE / (x.entry - x.stop)), floor(eq * {config.MAX_POSITION}::DOUBLE / x.entry)) AS BIGINT)}}) AS cs
      FROM run JOIN sess ON sess.market = run.market AND sess.s = run.s + 1))),
closed AS (SELECT market, unnest(done) AS t FROM run UNION ALL
  SELECT market, {{'ticker': p.ticker, 'entry_s': p.entry_s, 'entry': p.entry, 'stop': p.stop, 'exit_s': s, 'px': coalesce((SELECT c FROM num WHERE num.market = o.market AND num.ticker = p.ticker AND num.s = o.s), p.entry), 'held': (SELECT count(*) FROM num WHERE num.market = o.market AND num.ticker = p.ticker AND num.s > p.entry_s), 'reason': 'end_of_data', 'shares': p.shares}} FROM (SELECT market, s, unnest(held_) AS p FROM run JOIN edge USING (market) WHERE s = last) o),
trades AS (SELECT market, t.ticker AS ticker, t.entry_s AS entry_s, t.exit_s AS exit_s, t.entry AS entry, t.px * (1 - slip) AS px, t.stop AS stop,
  t.shares AS shares, (t.px * (1 - slip) - t.entry) / (t.entry - t.stop) AS r, t.held AS held, t.reason AS reason,
  t.shares * (t.px * (1 - slip)) * fee AS fees FROM closed JOIN edge USING (market)),
curve AS (SELECT market, s, eq FROM run JOIN edge USING (market) WHERE s > first)"""


REPLAY_SQL = replay_sql()


@query(REPLAY_SQL + """ SELECT market, ticker, entry_s, exit_s, round(entry, 6) AS entry, round(px, 8) AS exit, round(stop, 6) AS stop, shares, round(r, 6) AS r, held,
  reason, round(fees, 4) AS fees FROM trades""")
def replay_trades(spark, sf_dir):
    x = rp.replay(_flagged(spark, sf_dir))
    return x.select("market", "ticker", "entry_s", "exit_s", _r(F.col("entry"), "entry"), F.round("exit", 8).alias("exit"), _r(F.col("stop"), "stop"), "shares", _r(F.col("r"), "r"), "held", "reason", F.round("fees", 4).alias("fees"))


@query(REPLAY_SQL + """ SELECT market, count(*) AS trades, round(count(*) FILTER (r > 0) / count(*) * 100, 6) AS win_rate, round(avg(r), 6) AS expectancy,
  round(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r <= 0)), 6) AS profit_factor,
 round(avg(r) FILTER (r > 0), 6) AS mean_win, round(avg(r) FILTER (r <= 0), 6) AS mean_loss, round(avg(held), 6) AS mean_hold FROM trades GROUP BY 1""")
def replay_statistics(spark, sf_dir):
    x = rp.statistics(rp.replay(_flagged(spark, sf_dir)))
    return x.select("market", "trades", *(_r(F.col(k), k) for k in ("win_rate", "expectancy", "profit_factor", "mean_win", "mean_loss", "mean_hold")))


@query(REPLAY_SQL + """, pk AS (SELECT *, max(eq) OVER w AS peak, eq / lag(eq) OVER w - 1 AS ret FROM curve WINDOW w AS (PARTITION BY market ORDER BY s))
SELECT market, round(arg_max(eq, s), 4) AS final_equity, round(min(eq / peak - 1) * 100, 6) AS max_drawdown, round(stddev_samp(ret) * sqrt(252) * 100,
  6) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252),
  6) AS sortino FROM pk GROUP BY 1""")
def replay_equity(spark, sf_dir):
    x = rp.drawdown(rp.replay(_flagged(spark, sf_dir), equity=True))
    return x.select("market", F.round("final_equity", 4).alias("final_equity"), *(_r(F.col(k), k) for k in ("max_drawdown", "volatility", "sharpe", "sortino")))


@query(REPLAY_SQL + " SELECT market, count(*) AS trades, count(*) < 20 AS thin, CASE WHEN count(*) < 20 THEN 0 ELSE 10000 END AS draws FROM trades GROUP BY 1")
def bootstrap_sizes(spark, sf_dir):
    return rp.bootstrap(rp.replay(_flagged(spark, sf_dir))).select("market", "trades", "thin", "draws")


#: The same counter as replay.scattered, a step a column.
_MIXED = "SELECT * REPLACE (xor({c}, {c} >> 16) AS {c}) FROM (SELECT * REPLACE ((xor({c}, {c} >> 15) * 739982445) & 4294967295 AS {c}) FROM (SELECT * REPLACE ((xor({c}, {c} >> 16) * 2146121005) & 4294967295 AS {c}) FROM {t}))"
BOOTSTRAP_SQL = REPLAY_SQL + f""", rs AS (SELECT market, list(r ORDER BY r) AS rs, count(*) AS n FROM trades WHERE r IS NOT NULL GROUP BY 1),
drawn AS (SELECT market, i, (i + 7 * 1000003) & 4294967295 AS x FROM rs, range(10000) q(i) WHERE n >= 20), drawx AS ({_MIXED.format(c="x", t="drawn")}),
placed AS (SELECT market, i, j, (x + j) & 4294967295 AS y, rs, n FROM drawx JOIN rs USING (market), range(10000) p(j) WHERE j < n), placey AS ({_MIXED.format(c="y", t="placed")}),
step AS (SELECT market, i, j, n, product(1 + {config.RISK}::DOUBLE * rs[((y * n) >> 32) + 1]) OVER (PARTITION BY market, i ORDER BY j) AS eq FROM placey),
topped AS (SELECT *, max(eq) OVER (PARTITION BY market, i ORDER BY j) AS top FROM step),
draws AS (SELECT market, arg_max(eq, j) AS final, (pow(greatest(0, arg_max(eq, j)), 50.0::DOUBLE / max(n)) - 1) * 100 AS growth, least(0, min(eq / top - 1)) * 100 AS fall FROM topped GROUP BY market, i)"""


@query(BOOTSTRAP_SQL + """ SELECT market, max(rs.n) AS trades, bool_or(rs.n < 20) AS thin, count(final) AS draws,
  """ + ", ".join(f"round(coalesce(quantile_cont({c}, {q / 100}), -1), 6) AS {c}_p{q}" for c in ("growth", "fall") for q in (5, 50, 95)) + """,
  round(coalesce(count(*) FILTER (fall <= -25) / nullif(count(final), 0) * 100, -1), 6) AS fall_25, round(coalesce(count(*) FILTER (fall <= -50) / nullif(count(final), 0) * 100, -1), 6) AS fall_50,
  round(coalesce(count(*) FILTER (final < 0.5) / nullif(count(final), 0) * 100, -1), 6) AS halved FROM rs LEFT JOIN draws USING (market) GROUP BY 1""")
def bootstrap_risk(spark, sf_dir):
    """-1 where a market has too few trades to draw from."""
    x = rp.bootstrap(rp.replay(_flagged(spark, sf_dir)))
    found = [f"{c}_p{q}" for c in ("growth", "fall") for q in (5, 50, 95)] + ["fall_25", "fall_50", "halved"]
    return x.select("market", "trades", "thin", "draws", *(F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in found))


#: A small grid: the stop, the longest hold, the risk and the slots vary.
PLANS = {"base": {}, "tight": {"stop": 0.04}, "short": {"hold": 15, "slots": 3}, "bold": {"risk": 0.03}}


@query(" UNION ALL ".join(f"""(SELECT '{name}' AS plan, * FROM ({replay_sql(**how)} SELECT market, count(*) AS trades, round(avg(r), 6) AS expectancy,
  round(avg(held), 6) AS mean_hold, round(sum(fees), 4) AS fees FROM trades GROUP BY 1))""" for name, how in PLANS.items()))
def replay_grid(spark, sf_dir):
    """Statistics of every plan of the grid, from one pass."""
    plans = [rp.Plan(name, "donchian", **how) for name, how in PLANS.items()]
    trades, _ = rp.grid(sg.fired(sg.session_features(session_bars(spark, sf_dir)), ["donchian"]), plans)
    x = trades.groupBy("plan", "market").agg(F.count("*").alias("trades"), F.avg("r").alias("expectancy"), F.avg("held").alias("mean_hold"), F.sum("fees").alias("fees"))
    return x.select("plan", "market", "trades", _r(F.col("expectancy"), "expectancy"), _r(F.col("mean_hold"), "mean_hold"), F.round("fees", 4).alias("fees"))


@query(CAND_SQL + """ SELECT ticker, entry_s, round(entry, 6) AS entry, coalesce(reason, 'open') AS reason, coalesce(exit_s, -1) AS exit_s, round(coalesce(px, 0),
  6) AS px FROM cand""")
def replay_candidates(spark, sf_dir):
    x = rp.candidates(_flagged(spark, sf_dir))
    return x.select("ticker", F.col("entry_s").cast("long").alias("entry_s"), _r(F.col("entry"), "entry"), F.coalesce("reason", F.lit("open")).alias("reason"), F.coalesce("exit_s", F.lit(-1)).cast("long").alias("exit_s"), _r(F.coalesce("px", F.lit(0.0)), "px"))
