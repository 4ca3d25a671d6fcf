"""Registered queries of behaviour and of the bandit's queue, weights and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.investigation import behaviour
from tracewell.operators import bandit
from tracewell.plans.desk import AL
from tracewell.plans.registry import A, E, L, query
from tracewell.sources import desk as tables
from tracewell.sources.ledgers import accounts, events_ledger, orders_ledger

OWN = """O AS (
  SELECT src AS account, CASE WHEN src = dst THEN amount END AS came, amount AS went, amount, ts, channel FROM {0}
  UNION ALL SELECT dst, amount, NULL, amount, ts, channel FROM {0} WHERE src <> dst)"""
VELOCITY = """
z AS (SELECT account, count(*) AS n, min(epoch_us(ts)) AS f, max(epoch_us(ts)) - {weeks} * 604800000000 AS cutoff FROM O GROUP BY account),
c AS (SELECT z.*, (SELECT count(*) FROM O WHERE O.account = z.account AND epoch_us(O.ts) <= cutoff) AS b FROM z),
v AS (SELECT account, CASE WHEN n >= 2 THEN (n - b) / {weeks} ELSE 0 END AS recent, CASE WHEN n >= 2 AND b > 0 THEN b / (greatest(floor((cutoff - f) / 86400000000), 1) / 7.0) ELSE 0 END AS baseline FROM c)"""
WAKING = """
s AS (SELECT account, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY account ORDER BY ts) AS p,
             count(*) OVER (PARTITION BY account ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND {burst} * 86400000000 FOLLOWING) AS burst FROM O),
g AS (SELECT account, t, (t - p) // 86400000000 AS rest, burst FROM s WHERE t - p >= {gap} * 86400000000 AND burst >= {least})"""


@query("i4_monthly_trends", """
SELECT account, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(coalesce(sum(came), 0), 2) AS total_in, round(coalesce(sum(went), 0), 2) AS total_out,
       round(round(coalesce(sum(came), 0), 2) + round(coalesce(sum(went), 0), 2), 2) AS total, count(*) FILTER (channel = '1-URGENT' AND came IS NOT NULL) AS n_cash,
       round(coalesce(sum(came) FILTER (channel = '1-URGENT'), 0), 2) AS cash_in, count(*) FILTER (amount >= 50000) AS n_transfers, round(coalesce(sum(amount) FILTER (amount >= 50000), 0), 2) AS transfers
FROM O GROUP BY ALL""", L, OWN.format("L"))
def monthly_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.monthly_trends(orders_ledger(spark, sf_dir), "1-URGENT", F.col("amount") >= 50_000)


@query("i4_reactivations", f", {WAKING.format(gap=90, burst=7, least=3).strip()} SELECT account, t AS gap_end, rest AS gap_days, burst FROM g", L, OWN.format("L"))
def reactivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.reactivations(orders_ledger(spark, sf_dir)).select("account", "gap_end", "gap_days", "burst")


@query("i4_behaviour", f""", {WAKING.format(gap=1, burst=2, least=4).strip()}, {VELOCITY.format(weeks=4).strip()},
w AS (SELECT account, string_agg(rest || ':' || burst, ',' ORDER BY t) AS events FROM g GROUP BY account), m AS (SELECT account, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months FROM O GROUP BY account)
SELECT account, n_months, events IS NOT NULL AS reactivated, coalesce(events, '') AS events, round(recent, 6) AS recent, round(baseline, 6) AS baseline, round(recent / nullif(baseline, 0), 6) AS ratio, coalesce(recent / nullif(baseline, 0) >= 2, false) AS increased
FROM m JOIN v USING (account) LEFT JOIN w USING (account) WHERE account IN (SELECT account FROM A)""", E, OWN.format("E"), A)
def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rests of a day and four transfers within two days of it: the ledger of events has no longer ones."""
    rows = behaviour.bundle(events_ledger(spark, sf_dir), accounts(spark, sf_dir), "click", gap_days=1, burst_days=2, burst_min=4)
    events = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["gap_days"].cast("string"), e["burst"].cast("string"))), ",")
    rates = [F.round(c, 6).alias(c) for c in ("recent", "baseline", "ratio")]
    return rows.select("account", F.size("months").cast("long").alias("n_months"), "reactivated", events.alias("events"), *rates, "increased")


#: The state of two features in closed form: the inverse of [[p, q], [q, r]] and the weights u and v.
_CLOSED = "*, r / (p * r - q * q) AS i00, -q / (p * r - q * q) AS i01, p / (p * r - q * q) AS i11, (r * s - q * t) / (p * r - q * q) AS u, (p * t - q * s) / (p * r - q * q) AS v"
_VERDICTS = "x AS (SELECT alert_id, account, created, risk / 100 AS f, CAST(hour(created) AS DOUBLE) / 24 AS h, CASE status WHEN 'closed' THEN true WHEN 'dismissed' THEN false END AS good FROM AL)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with two features and, where they were closed or dismissed, a verdict."""
    good = F.when(F.col("status") == "closed", True).when(F.col("status") == "dismissed", False)
    return tables.alerts(spark, sf_dir).select("alert_id", "account", "created", (F.col("risk") / 100).alias("f"), (F.hour("created") / 24).alias("h"), good.alias("good"))


@query("i11_queue", f""", {_VERDICTS},
w AS (SELECT {_CLOSED} FROM (SELECT 1 + sum(f * f) AS p, sum(f * h) AS q, 1 + sum(h * h) AS r, sum(f * CASE WHEN good THEN 1 ELSE -0.3 END) AS s, sum(h * CASE WHEN good THEN 1 ELSE -0.3 END) AS t FROM x WHERE good IS NOT NULL)),
b AS (SELECT alert_id, u * f + v * h AS e, sqrt(i00 * f * f + 2 * i01 * f * h + i11 * h * h) AS d FROM x, w WHERE good IS NULL)
SELECT row_number() OVER (ORDER BY round(e + d, 4) DESC, alert_id) AS place, alert_id, round(e, 4) AS expected, round(d, 4) AS uncertainty, round(e + d, 4) AS ucb, round(d, 4) > 0.3 AS exploring FROM b QUALIFY place <= 50""", AL)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    return bandit.ranked_by_bound(rows.where("good IS NULL"), ["f", "h"], rows, 50, "alert_id")


@query("i11_replay", f""", {_VERDICTS},
k AS (SELECT *, row_number() OVER (ORDER BY created, alert_id) AS n FROM x WHERE good IS NOT NULL),
z AS (SELECT n AS step, 1 + sum(f * f) OVER o AS p, sum(f * h) OVER o AS q, 1 + sum(h * h) OVER o AS r, sum(f * CASE WHEN good THEN 1 ELSE -0.3 END) OVER o AS s, sum(h * CASE WHEN good THEN 1 ELSE -0.3 END) OVER o AS t,
             sum(CAST(good AS INT)) OVER o AS n_good FROM k WINDOW o AS (ORDER BY n)),
w AS (SELECT {_CLOSED} FROM z WHERE step % 100 = 0 OR step = (SELECT max(step) FROM z))
SELECT step, CAST(n_good AS BIGINT) AS n_good, ((2000 * CAST(n_good AS BIGINT) + step) // (2 * step)) / 1000 AS precision, feature, round(weight, 4) AS weight FROM (SELECT *, 'f' AS feature, u AS weight FROM w UNION ALL SELECT *, 'h', v FROM w)""", AL)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandit.replayed(_verdicts(spark, sf_dir), ["f", "h"], ["created", "alert_id"], 100)


@query("i11_weights", f""", {_VERDICTS},
k AS (SELECT *, kind FROM x JOIN AL USING (alert_id)),
w AS (SELECT {_CLOSED} FROM (SELECT kind AS action, 1 + sum(f * f) AS p, sum(f * h) AS q, 1 + sum(h * h) AS r, sum(f * CASE WHEN good THEN 1 ELSE -0.3 END) AS s, sum(h * CASE WHEN good THEN 1 ELSE -0.3 END) AS t FROM k WHERE good IS NOT NULL GROUP BY kind))
SELECT action, 'f' AS feature, round(u, 4) AS weight FROM w UNION ALL SELECT action, 'h', round(v, 4) FROM w""", AL)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tables.alerts(spark, sf_dir).select("alert_id", F.col("kind").alias("action"))
    rows = _verdicts(spark, sf_dir).where("good IS NOT NULL").join(kinds, "alert_id").withColumn("reward", F.when(F.col("good"), bandit.REWARD).otherwise(bandit.PENALTY))
    learned = bandit.learned_weights(bandit.linucb_state(rows, ["f", "h"], "action", "reward"), ["f", "h"])
    return learned.select("action", "feature", F.round("weight", 4).alias("weight"))
