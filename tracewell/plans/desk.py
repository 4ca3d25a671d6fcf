"""Registered queries of the investigation desk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.investigation import desk
from tracewell.operators import scoring
from tracewell.plans.registry import A, E, query
from tracewell.sources import desk as tables
from tracewell.sources.ledgers import accounts, events_ledger

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
AL = f"""AL AS (
  SELECT 'A' || event_id AS alert_id, user_id AS account, {_LIST(tables.KINDS)}[event_id % 6 + 1] AS kind, round(least(value / 250, 1), 4) AS score, round(least(value / 2.5, 100), 2) AS risk,
         CASE WHEN round(least(value / 2.5, 100), 2) >= 90 THEN 'CRITICAL' WHEN round(least(value / 2.5, 100), 2) >= 75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {_LIST(tables.ALERT_STATES)}[event_id % 4 + 1] AS status,
         ts AS created, CASE WHEN event_id % 3 = 0 THEN user_id * 10 + event_id % 2 END AS case_id FROM events WHERE value >= 60)"""
CA = f"""CA AS (
  SELECT *, {_LIST(tables.CASE_STATES)}[case_id % 6 + 1] AS status, CASE WHEN case_id % 5 <> 0 THEN 'u' || case_id % 7 END AS assigned_to,
         CASE WHEN risk >= 97 THEN 'P1' WHEN risk >= 90 THEN 'P2' WHEN risk >= 80 THEN 'P3' ELSE 'P4' END AS priority,
         CASE {_LIST(tables.CASE_STATES)}[case_id % 6 + 1] WHEN 'CLOSED_TP' THEN 'TRUE_POSITIVE_SAR' WHEN 'CLOSED_FP' THEN 'FALSE_POSITIVE' END AS resolution
  FROM (SELECT case_id, min(account) AS primary_account, min(created) AS opened, max(risk) AS risk, count(*) AS n_alerts FROM AL WHERE case_id IS NOT NULL GROUP BY case_id))"""
US = "US AS (SELECT 'u' || i AS user_id, i % 4 <> 3 AS active FROM range(9) t(i))"
WL = """WL AS (SELECT 'a' || c_custkey AS entry_id, c_custkey AS account, CAST(NULL AS BIGINT) AS customer FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'c' || c_custkey, NULL, c_custkey FROM customer WHERE c_custkey % 10 = 0)"""


@query("f6_alert_filter", "SELECT alert_id, account, kind, risk FROM AL WHERE severity IN ('HIGH', 'CRITICAL') AND status = 'open' AND risk BETWEEN 80 AND 95 AND case_id IS NULL", AL)
def alert_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.filtered(tables.alerts(spark, sf_dir), {"severity": ["HIGH", "CRITICAL"], "status": "open"}, {"risk": (80, 95)}, ["case_id"]).select("alert_id", "account", "kind", "risk")


@query("f6_alerts_of_assignee", "SELECT alert_id, case_id FROM AL WHERE case_id IN (SELECT case_id FROM CA WHERE assigned_to = 'u3')", AL, CA)
def of_assignee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.alerts_of(tables.alerts(spark, sf_dir), tables.cases(spark, sf_dir), "u3").select("alert_id", "case_id")


@query("f7_case_filter", "SELECT case_id, priority, n_alerts FROM CA WHERE status IN ('NEW', 'ASSIGNED') AND priority = 'P1'", AL, CA)
def case_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.filtered(tables.cases(spark, sf_dir), {"status": ["NEW", "ASSIGNED"], "priority": "P1"}).select("case_id", "priority", "n_alerts")


@query("f11_overdue_cases", "SELECT case_id FROM CA WHERE status IN ('NEW', 'ASSIGNED', 'IN_PROGRESS', 'AWAITING_REVIEW') AND opened + CASE priority WHEN 'P1' THEN INTERVAL 4 HOURS WHEN 'P2' THEN INTERVAL 24 HOURS WHEN 'P3' THEN INTERVAL 72 HOURS ELSE INTERVAL 168 HOURS END < TIMESTAMP '2024-01-08 00:00:00'", AL, CA)
def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.overdue(tables.cases(spark, sf_dir), F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")).select("case_id")


@query("f3_search_count", "SELECT count(*) AS n FROM E WHERE amount BETWEEN 100 AND 300 AND channel <> 'view'", E)
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).where(F.col("amount").between(100, 300) & (F.col("channel") != "view")).agg(F.count("*").alias("n"))


@query("f1_most_recent", "SELECT txn_id, src, dst FROM E WHERE src = 5 OR dst = 5 ORDER BY ts DESC, txn_id DESC LIMIT 40", E)
def most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.account_window(events_ledger(spark, sf_dir), 5, limit=40, most_recent=True).select("txn_id", "src", "dst")


@query("f4_decorated_search", """
, s AS (SELECT account FROM A WHERE account % 50 = 3)
SELECT txn_id, x.city AS src_city, y.occupation AS dst_occupation, CASE WHEN src IN (FROM s) AND dst IN (FROM s) THEN 'internal' WHEN src IN (FROM s) THEN 'out' ELSE 'in' END AS direction
FROM E LEFT JOIN A x ON x.account = src LEFT JOIN A y ON y.account = dst WHERE src IN (FROM s) OR dst IN (FROM s)""", E, A)
def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = accounts(spark, sf_dir)
    return desk.decorated(events_ledger(spark, sf_dir), who, who.where("account % 50 = 3")).select("txn_id", "src_city", "dst_occupation", "direction")


@query("j7_workload", "SELECT user_id, count(case_id) AS n_open FROM US LEFT JOIN CA ON assigned_to = user_id AND status IN ('NEW', 'ASSIGNED', 'IN_PROGRESS', 'AWAITING_REVIEW') WHERE active GROUP BY user_id", AL, CA, US)
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.workload(tables.users(spark), tables.cases(spark, sf_dir))


@query("j9_prior_reports", """
, l AS (SELECT DISTINCT account, case_id FROM AL WHERE case_id IS NOT NULL AND case_id <> 31)
SELECT l.account, count(*) AS n_prior, bool_or(coalesce(resolution = 'TRUE_POSITIVE_SAR', false)) AS had_sar FROM l JOIN CA USING (case_id) GROUP BY l.account""", AL, CA)
def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir)
    return desk.prior_cases(rows.select("account"), rows, tables.cases(spark, sf_dir), 31)


@query("j17_watchlist_screen", """
, m AS (SELECT A.account, entry_id, 0 AS o FROM A JOIN WL USING (account) UNION ALL SELECT A.account, entry_id, 1 FROM A JOIN WL ON WL.customer = A.account)
SELECT account, entry_id, CASE o WHEN 0 THEN 'account' ELSE 'customer' END AS matched_by FROM m QUALIFY row_number() OVER (PARTITION BY account ORDER BY o, entry_id) = 1""", A, WL)
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = accounts(spark, sf_dir).select("account", F.col("account").alias("customer"))
    return desk.screened(who, tables.watchlist(spark, sf_dir))


@query("i5_watch_activity", """
, t AS (SELECT a, max(ts) AS last_ts FROM (SELECT src AS a, ts FROM E UNION ALL SELECT dst, ts FROM E) GROUP BY a), n AS (SELECT account, count(*) AS n FROM AL WHERE created >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY account)
SELECT entry_id, WL.account, last_ts, coalesce(n, 0) AS n_alerts FROM WL LEFT JOIN t ON t.a = WL.account LEFT JOIN n ON n.account = WL.account WHERE WL.account IS NOT NULL""", AL, WL, E)
def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return desk.watch_activity(tables.watchlist(spark, sf_dir), events_ledger(spark, sf_dir), tables.alerts(spark, sf_dir), since)


@query("a18_severity_counts", "SELECT s.severity, count(alert_id) AS n, coalesce(round(avg(risk), 4), 0) AS mean_risk FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity) s LEFT JOIN AL USING (severity) GROUP BY s.severity", AL)
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.severity_counts(tables.alerts(spark, sf_dir))


@query("a19_verdict_precision", "SELECT priority, count(*) FILTER (resolution = 'TRUE_POSITIVE_SAR') AS tp, count(*) FILTER (resolution = 'FALSE_POSITIVE') AS fp, round(count(*) FILTER (resolution = 'TRUE_POSITIVE_SAR') / count(*), 3) AS precision FROM CA WHERE resolution IS NOT NULL GROUP BY priority", AL, CA)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.verdict_precision(tables.cases(spark, sf_dir), "priority")


@query("a22_alert_history", """
, r AS (SELECT AL.*, resolution, row_number() OVER (PARTITION BY account ORDER BY created DESC, alert_id DESC) AS place FROM AL LEFT JOIN CA USING (case_id))
SELECT account, count(*) AS total, count(*) FILTER (resolution = 'TRUE_POSITIVE_SAR') AS n_sar, count(*) FILTER (resolution = 'FALSE_POSITIVE') AS n_false, count(*) FILTER (status = 'open') AS n_open,
       string_agg(printf('%.2f', risk), ',' ORDER BY place DESC) FILTER (place <= 20) AS risks FROM r GROUP BY account""", AL, CA)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.alert_history(tables.alerts(spark, sf_dir), tables.cases(spark, sf_dir))


@query("a21_kind_counts", "SELECT kind, severity, count(*) AS n FROM AL GROUP BY ALL", AL)
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.alerts(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("a24_recall", "SELECT kind AS pattern, count(*) AS attempts, CAST(sum(f) AS BIGINT) AS found, round(sum(f) / count(*), 6) AS recall FROM (SELECT case_id, kind, max(CAST(account IN (SELECT account FROM AL WHERE risk >= 97) AS INT)) AS f FROM AL WHERE case_id IS NOT NULL GROUP BY ALL) GROUP BY kind", AL)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir)
    attempts = rows.where("case_id IS NOT NULL").select(F.col("case_id").alias("attempt"), F.col("kind").alias("pattern"), "account")
    return desk.recall(attempts, rows.where("risk >= 97"))


@query("a26_separation", "SELECT round(avg(amount) FILTER (channel = 'error'), 4) AS mean_marked, round(avg(amount) FILTER (channel <> 'error'), 4) AS mean_clean, round(avg(amount) FILTER (channel = 'error') - avg(amount) FILTER (channel <> 'error'), 4) AS gap FROM E", E)
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.separation(events_ledger(spark, sf_dir).select((F.col("channel") == "error").cast("int").alias("label"), F.col("amount").alias("score")))


@query("i12_what_changed", "SELECT case_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, max(risk) AS top_risk FROM AL WHERE created > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 240 HOURS AND created <= TIMESTAMP '2024-01-20 00:00:00' AND case_id IS NOT NULL GROUP BY case_id", AL)
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.what_changed(tables.alerts(spark, sf_dir), 240, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("i13_accessible_cases", "SELECT 'reviewer' AS role, case_id FROM CA WHERE status IN ('AWAITING_REVIEW', 'ESCALATED') UNION ALL SELECT 'investigator', case_id FROM CA WHERE assigned_to = 'u2'", AL, CA)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.cases(spark, sf_dir)
    return desk.accessible(rows, "reviewer", "u2").select(F.lit("reviewer").alias("role"), "case_id").unionByName(desk.accessible(rows, "investigator", "u2").select(F.lit("investigator").alias("role"), "case_id"))


@query("i6_illegal_moves", """
, h AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY created, alert_id) AS seq, ['NEW', 'ASSIGNED', 'IN_PROGRESS', 'CLOSED_FP', 'MONITORING'][CAST(substr(alert_id, 2) AS BIGINT) % 5 + 1] AS status FROM AL WHERE case_id IS NOT NULL),
p AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY seq) AS before FROM h)
SELECT case_id, seq, before, status FROM p WHERE NOT CASE WHEN before IS NULL THEN status = 'NEW' ELSE (before, status) IN (('NEW', 'ASSIGNED'), ('ASSIGNED', 'IN_PROGRESS'), ('IN_PROGRESS', 'CLOSED_FP')) END""", AL)
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tables.alerts(spark, sf_dir).where("case_id IS NOT NULL")
    state = F.get(F.array(*map(F.lit, ["NEW", "ASSIGNED", "IN_PROGRESS", "CLOSED_FP", "MONITORING"])), (F.substring("alert_id", 2, 20).cast("long") % 5).cast("int"))
    log = rows.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("created", "alert_id")).alias("seq"), state.alias("status"))
    return desk.illegal_moves(log)


@query("i9_feedback", "SELECT case_id, CASE resolution WHEN 'TRUE_POSITIVE_SAR' THEN 1.0::DOUBLE ELSE -0.3::DOUBLE END AS reward FROM CA WHERE resolution IS NOT NULL", AL, CA)
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.feedback(tables.cases(spark, sf_dir))


@query("i9_learned_confidence", """
, v AS (SELECT kind AS rule, list(status = 'closed' ORDER BY created, alert_id) AS g FROM AL WHERE status IN ('closed', 'dismissed') GROUP BY kind)
SELECT rule, CAST(len(g) AS BIGINT) AS n, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(g, lambda x: CASE WHEN x THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END)),
       lambda c, x: greatest(0.05, least(0.99, c + 0.1 * (CASE WHEN x = 2 THEN 1 ELSE 0 END - c)))), 6) AS confidence FROM v""", AL)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir).where("status IN ('closed', 'dismissed')")
    return desk.learned_confidence(rows.select(F.col("kind").alias("rule"), F.struct("created", "alert_id").alias("seq"), (F.col("status") == "closed").alias("good")))


@query("l6_one_case_an_account", "SELECT account, alert_id, risk FROM (SELECT * FROM AL QUALIFY row_number() OVER (PARTITION BY account ORDER BY risk DESC, alert_id DESC) = 1) ORDER BY risk DESC, account LIMIT 20", AL)
def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.one_case_an_account(tables.alerts(spark, sf_dir), 20)


@query("w11_top_by_kind", "SELECT kind, alert_id, account, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, account, alert_id) AS place FROM AL QUALIFY place <= 200", AL)
def top_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_by_kind(tables.alerts(spark, sf_dir), 200, ("account", "alert_id")).select("kind", "alert_id", "account", "score", "place")


@query("w16_best_per_account", "SELECT account, kind, score FROM AL QUALIFY row_number() OVER (PARTITION BY account ORDER BY score DESC, kind, alert_id) = 1", AL)
def best_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir).withColumn("o", F.struct("kind", "alert_id"))
    return scoring.best_per_account(rows, "o").select("account", "kind", "score")


@query("m12_ranked_queue", """
, r AS (SELECT account, max(risk) AS risk, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM AL GROUP BY account),
t AS (SELECT *, row_number() OVER (ORDER BY risk DESC, account) AS k FROM r), s AS (SELECT *, CASE WHEN k <= 60 THEN round(sin(account) * 10, 4) END AS rank_score FROM t)
SELECT row_number() OVER (ORDER BY k > 60, CASE WHEN k <= 60 THEN -rank_score ELSE -risk END, account) AS place, account, kinds, risk, rank_score FROM s""", AL)
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir)
    return scoring.ranked_queue(rows, rows.select("account").distinct().withColumn("rank_score", F.round(F.sin("account") * 10, 4)), 60)


@query("m15_evidence_ranks", """
, r AS (SELECT kind AS rule, round(0.55 * max(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END) + 0.3 * max(score) + 0.15 * least(count(DISTINCT account) / 5, 1), 6) AS score FROM AL GROUP BY kind)
SELECT rule, score, row_number() OVER (ORDER BY score DESC, list_position(['dormancy', 'fan_out', 'layering', 'profile_mismatch', 'round_trip', 'structuring'], rule)) AS place FROM r""", AL)
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.evidence_ranks(tables.alerts(spark, sf_dir).withColumnRenamed("kind", "rule"), ["dormancy", "fan_out", "layering", "profile_mismatch", "round_trip", "structuring"])


@query("m16_drift", """
, a AS (SELECT kind, count(*) / (SELECT count(*) FROM AL WHERE created < TIMESTAMP '2024-01-15 00:00:00') AS x FROM AL WHERE created < TIMESTAMP '2024-01-15 00:00:00' GROUP BY kind),
b AS (SELECT kind, count(*) / (SELECT count(*) FROM AL WHERE created >= TIMESTAMP '2024-01-15 00:00:00') AS y FROM AL WHERE created >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY kind),
c AS (SELECT kind, coalesce(x, 0) AS x, coalesce(y, 0) AS y, CASE WHEN coalesce(x, 0) = 0 THEN 1.0 ELSE abs((coalesce(y, 0) - x) / x) END AS d FROM a FULL JOIN b USING (kind))
SELECT kind, round(x, 6) AS rate_before, round(y, 6) AS rate_after, round(d, 6) AS change, d > 0.05 AS drifted FROM c""", AL)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, day = tables.alerts(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return scoring.drift(rows.where(F.col("created") < day), rows.where(F.col("created") >= day), 0.05)


_HASH = lambda seq, what, before: "sha256(" + " || ".join(f"length({x}) || ':' || {x}" for x in (f"CAST({seq} AS VARCHAR)", what, before)) + ")"


@query("w15_broken_links", f"""
, h0 AS (SELECT event_id AS seq, event_type AS what, '' AS prev_hash, {_HASH("event_id", "event_type", "''")} AS row_hash FROM events WHERE event_id % 3 = 0),
h1 AS (SELECT event_id AS seq, event_type AS what, row_hash AS prev_hash, {_HASH("event_id", "event_type", "row_hash")} AS row_hash FROM events JOIN h0 ON event_id = h0.seq + 1),
h2 AS (SELECT event_id AS seq, event_type AS what, row_hash AS prev_hash, {_HASH("event_id", "event_type", "row_hash")} AS row_hash FROM events JOIN h1 ON event_id = h1.seq + 1),
log AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN what || '|' ELSE what END AS what, prev_hash, row_hash FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2)),
c AS (SELECT *, coalesce(lag(row_hash) OVER (ORDER BY seq), '') AS before, {_HASH("seq", "what", "prev_hash")} AS own FROM log)
SELECT seq, CASE WHEN prev_hash <> before THEN 'link' ELSE 'content' END AS broken FROM c WHERE prev_hash <> before OR own <> row_hash""", E)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all events that begins anew at every third entry, and whose every fifth entry was changed after it was hashed."""
    from tracewell.sources.ledgers import table

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("what"))
    part = rows.where("seq % 3 = 0").withColumn("prev_hash", F.lit(""))
    log = part = part.withColumn("row_hash", desk.entry_hash(["seq", "what", "prev_hash"]))
    for place in (1, 2):
        before = part.select((F.col("seq") + 1).alias("seq"), F.col("row_hash").alias("prev_hash"))
        part = rows.where(F.col("seq") % 3 == place).join(before, "seq").withColumn("row_hash", desk.entry_hash(["seq", "what", "prev_hash"]))
        log = log.unionByName(part)
    changed = F.when(F.col("seq") % 5 == 0, F.concat("what", F.lit("|"))).otherwise(F.col("what"))
    return desk.broken_links(log.withColumn("what", changed), ["seq", "what"])
