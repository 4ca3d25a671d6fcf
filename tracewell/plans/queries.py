"""Registered queries over the driver tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import aggregates, bandit, detectors, features, graph, rules, sets, walks
from tracewell.plans.registry import BE, BL, ORACLE, QUERIES, A, E, L, query
from tracewell.sources.ledgers import accounts, both_sides, events_ledger, orders_ledger, table

@query("a10_account_flow", "SELECT account, round(sum(CASE WHEN direction = 'in' THEN amount ELSE 0 END), 2) AS inflow, round(sum(CASE WHEN direction = 'out' THEN amount ELSE 0 END), 2) AS outflow, count(*) AS n, count(DISTINCT other) FILTER (other <> account) AS partners FROM B GROUP BY account", L, BL)
def account_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.account_flow(orders_ledger(spark, sf_dir))


@query("p1_amount_band_count", """
SELECT src, bin, n, round(total, 2) AS total, round(least(1.0, n / 10.0 * 0.5 + total / 500000.0 * 0.5), 6) AS score, CASE WHEN n >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM (SELECT src, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM L WHERE amount >= 50000 AND amount < 100000)) // 30 AS bin, count(*) AS n, sum(amount) AS total
      FROM L WHERE amount >= 50000 AND amount < 100000 GROUP BY ALL) WHERE n >= 3""", L)
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.amount_band_count(orders_ledger(spark, sf_dir), 50_000, 100_000, 3, 30)


@query("p2_split_sum", """
SELECT src, CAST(day AS VARCHAR) AS day, n, total, round(least(1.0, 0.3 + n / 10.0 * 0.4 + total / 100000.0 * 0.3), 6) AS score, 'HIGH' AS severity
FROM (SELECT src, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(amount), 2) AS total FROM L GROUP BY ALL) WHERE n >= 2 AND total >= 90000 AND total < 100000""", L)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.split_sum(orders_ledger(spark, sf_dir), 90_000, 100_000).withColumn("day", F.col("day").cast("string"))


@query("p3_inactivity_then_burst", """
, r AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM B),
g AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS gap, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY account ORDER BY ts, txn_id, direction)),
m AS (SELECT account, count(*) AS k, max(gap) AS gap_s, arg_min(nth, (-gap, nth)) AS pos FROM g GROUP BY account),
s AS (SELECT g.account, m.gap_s, count(*) FILTER (nth >= pos) AS n_after, count(*) FILTER (nth < pos) AS n_before, coalesce(sum(amount) FILTER (nth >= pos), 0) AS total,
      avg(amount) FILTER (nth >= pos) AS a, coalesce(avg(amount) FILTER (nth < pos), 0) AS b
      FROM g JOIN m USING (account) WHERE m.k > 5 AND m.gap_s >= 72000 GROUP BY ALL),
q AS (SELECT *, CASE WHEN b > 0 THEN a / b ELSE 2 END AS r, gap_s / 86400 AS d FROM s WHERE n_after >= 5 AND (b <> 0 OR n_before >= 2))
SELECT account, gap_s, n_after, round(r, 6) AS ratio, round(least(1.0, least(d / 365, 0.3) + least(r / 50, 0.4) + least(total / 5000, 0.3)), 6) AS score,
       CASE WHEN d > 365 AND r > 20 THEN 'CRITICAL' WHEN d > 180 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM q WHERE r >= 1""", E, BE)
def dormancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.inactivity_then_burst(events_ledger(spark, sf_dir), 72_000, min_ratio=1.0, unit=5000.0)


def _fan_sql(me: str, other: str) -> str:
    return f"""
, r AS (SELECT {me} AS account, epoch_us(ts) AS t, count(DISTINCT {other}) OVER w AS others FROM E
        WINDOW w AS (PARTITION BY {me} ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING)),
q AS (SELECT * FROM r WHERE others >= 5 QUALIFY row_number() OVER (PARTITION BY account ORDER BY others DESC, t) = 1),
i AS (SELECT q.account, {other} AS other, epoch_us(ts) AS t, amount FROM q JOIN E ON q.account = {me} WHERE epoch_us(ts) BETWEEN q.t AND q.t + 86400000000),
f AS (SELECT account, other, min(t) AS a, max(t) AS z, sum(amount) AS x FROM i GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY a, other) AS place FROM f),
h AS (SELECT account, count(*) AS others, min(a) AS a, max(z) - min(a) AS span, sum(x) AS total, string_agg(CAST(other AS VARCHAR), ',' ORDER BY place) FILTER (place <= 30) AS members FROM p GROUP BY account)
SELECT account, others, make_timestamp(a) AS starts, round(span / 86400000000, 6) AS span_days, round(total, 2) AS total, members,
       round(least(1.0, least((others - 5) / 12, 1.0) * 0.4 + least(total / 10000, 1.0) * 0.3 + greatest(0.0, 1 - span / 86400000000) * 0.3), 6) AS score,
       CASE WHEN others >= 10 THEN 'CRITICAL' WHEN others >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM h"""


@query("p6_fan_out", _fan_sql("src", "dst"), E)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.fan_degree(events_ledger(spark, sf_dir), 1, 5, "out", 10_000.0).withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("p6_fan_in", _fan_sql("dst", "src"), E)
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.fan_degree(events_ledger(spark, sf_dir), 1, 5, "in", 10_000.0).withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("p8_income_mismatch", """
, v AS (SELECT account, round(sum(amount), 2) AS volume FROM B GROUP BY account),
r AS (SELECT account, volume, volume / greatest(declared_income, 1.0) AS ratio FROM v JOIN A USING (account) WHERE declared_income > 0)
SELECT account, volume, round(ratio, 6) AS ratio, round(least(1.0, least(ratio / 100, 0.5) + 0.3 + least(volume / 1e7, 0.2)), 6) AS score,
       CASE WHEN ratio > 50 THEN 'CRITICAL' WHEN ratio > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r WHERE ratio > 10""", L, BL, A)
def mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.income_mismatch(orders_ledger(spark, sf_dir), accounts(spark, sf_dir))


@query("p9_peer_zscore", """
, v AS (SELECT account, sum(amount) AS volume FROM B GROUP BY account),
r AS (SELECT A.account, coalesce(volume, 0) AS volume, occupation, income_bracket FROM A LEFT JOIN v USING (account) WHERE occupation IS NOT NULL AND income_bracket IS NOT NULL),
p AS (SELECT occupation, income_bracket, avg(volume) AS mean, stddev_samp(volume) AS sd, count(*) AS n FROM r GROUP BY ALL),
q AS (SELECT account, occupation, income_bracket, (volume - mean) / greatest(sd, 1.0) AS z FROM r JOIN p USING (occupation, income_bracket) WHERE n >= 5 AND sd IS NOT NULL)
SELECT account, occupation, income_bracket, round(z, 6) AS z, round(least(1.0, abs(z) / 10 * 0.6 + 0.2), 6) AS score,
       CASE WHEN abs(z) > 5 THEN 'CRITICAL' WHEN abs(z) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM q WHERE abs(z) > 1.5""", L, BL, A)
def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.peer_zscore(orders_ledger(spark, sf_dir), accounts(spark, sf_dir), 1.5)


@query("p10_behavioural_shift", """
, r AS (SELECT account, txn_id, amount, avg(amount) OVER w AS mean, stddev_samp(amount) OVER w AS sd, count(*) OVER w AS n, count(*) OVER (PARTITION BY account) AS every, row_number() OVER o AS nth
        FROM B JOIN A USING (account) WHERE declared_income > 0
        WINDOW o AS (PARTITION BY account ORDER BY ts, txn_id, direction), w AS (PARTITION BY account ORDER BY ts, txn_id, direction ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (amount - mean) / greatest(sd, 1.0) AS z FROM r WHERE n >= 5 AND sd IS NOT NULL AND every >= 15),
q AS (SELECT * FROM z WHERE z > 3 QUALIFY row_number() OVER (PARTITION BY account ORDER BY z DESC, nth) = 1)
SELECT account, round(z, 6) AS z, txn_id, round(amount, 2) AS amount, round(least(1.0, z / 10 * 0.5 + 0.2), 6) AS score, CASE WHEN z > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM q""", E, BE, A)
def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.behavioural_shift(events_ledger(spark, sf_dir), accounts(spark, sf_dir))


def _group_sql(comparison: str, value: float) -> str:
    return f"""
, r AS (SELECT src AS account, round(sum(amount), 4) AS value FROM E WHERE ts >= (SELECT max(ts) FROM E) - INTERVAL 7 DAYS GROUP BY src)
SELECT account, value, round(least(1.0, 0.5 + least(abs(value - {value}) / {value}, 0.5)), 6) AS score, 'MEDIUM' AS severity FROM r WHERE value {comparison} {value}"""


@query("p11_group_aggregate", _group_sql(">=", 500), E)
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.group_aggregate(events_ledger(spark, sf_dir), "src", "SUM", "amount", 7, 500)


@query("p11_group_aggregate_below", _group_sql("<", 3000), E)
def group_aggregate_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.group_aggregate(events_ledger(spark, sf_dir), "src", "SUM", "amount", 7, 3000, "<")


@query("w13_gap_then_burst", """
, r AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM B),
g AS (SELECT account, txn_id, t - lag(t) OVER (PARTITION BY account ORDER BY ts, txn_id, direction) AS gap_s,
             count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING) AS burst FROM r)
SELECT * FROM g WHERE gap_s >= 72000 AND burst >= 3""", E, BE)
def gap_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.gap_then_burst(events_ledger(spark, sf_dir), 72_000, "1 DAY")


@query("w7_first_outlier", """
, r AS (SELECT account, txn_id, ts, amount, avg(amount) OVER w AS m, stddev_pop(amount) OVER w AS s, count(*) OVER w AS n FROM B WINDOW w AS (PARTITION BY account)),
q AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, txn_id) AS k FROM r WHERE n >= 3 AND s > 0 AND abs((amount - m) / s) > 2.5)
SELECT account, txn_id, ts, round(amount, 2) AS amount FROM q WHERE k = 1""", E, BE)
def first_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.first_outlier(events_ledger(spark, sf_dir))


@query("a6_channel_summary", "SELECT channel, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 4) AS mean, max(amount) AS most FROM L GROUP BY channel", L)
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.channel_summary(orders_ledger(spark, sf_dir))


@query("a8_channel_hours", "SELECT channel, hour(ts) AS hour, count(*) AS n FROM E GROUP BY ALL", E)
def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.channel_hours(events_ledger(spark, sf_dir))


@query("a7_flow_between", """
SELECT a.occupation AS src_kind, channel, b.occupation AS dst_kind, count(*) AS n, round(sum(amount), 2) AS total
FROM L JOIN A a ON L.src = a.account JOIN A b ON L.dst = b.account GROUP BY ALL ORDER BY total DESC, src_kind, channel, dst_kind LIMIT 50""", L, A)
def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = accounts(spark, sf_dir).select("account", F.col("occupation").alias("kind"))
    return aggregates.flow_between(orders_ledger(spark, sf_dir), kinds)


@query("a12_monthly_totals", """
SELECT account, strftime(ts, '%Y-%m') AS month, round(sum(CASE WHEN direction = 'in' THEN amount ELSE 0 END), 2) AS inflow,
       round(sum(CASE WHEN direction = 'out' THEN amount ELSE 0 END), 2) AS outflow, count(*) AS n FROM B GROUP BY ALL""", L, BL)
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.monthly_totals(orders_ledger(spark, sf_dir))


@query("a15_money_flow_share", """
, p AS (SELECT src, dst, round(sum(amount), 2) AS total, count(*) AS n FROM E WHERE src <> dst GROUP BY ALL)
SELECT src, dst, total, n, round(100 * total / sum(total) OVER (PARTITION BY src), 4) AS share FROM p""", E)
def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.money_flow_share(events_ledger(spark, sf_dir))


@query("w12_recent_velocity", """
, r AS (SELECT account, epoch_us(ts) // 1000000 AS t FROM B), x AS (SELECT account, max(t) AS last, min(t) AS first FROM r GROUP BY account),
c AS (SELECT account, first, last, count(*) FILTER (t > last - 604800) AS n_recent, count(*) FILTER (t <= last - 604800) AS n_before FROM r JOIN x USING (account) GROUP BY ALL),
q AS (SELECT *, n_recent / (n_before / greatest((last - first) / 604800.0 - 1, 1.0)) AS ratio FROM c WHERE n_before > 0)
SELECT account, n_recent, n_before, round(ratio, 6) AS ratio FROM q WHERE ratio >= 1.2""", E, BE)
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.recent_velocity(events_ledger(spark, sf_dir))


@query("a28_bucket_counts", "SELECT epoch_us(ts) // 1000000 // 600 * 600 AS bucket_s, count(*) AS n FROM E GROUP BY ALL", E)
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bucket_counts(events_ledger(spark, sf_dir))


@query("a18_daily_counts", """
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM L) d
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM L GROUP BY ALL) c USING (day)""", L)
def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.daily_counts(orders_ledger(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("a27_amount_histogram", "SELECT CAST(least(floor((amount - 0) / 50.0), 9) AS BIGINT) AS bin, count(*) AS n FROM E WHERE amount BETWEEN 0 AND 500 GROUP BY ALL", E)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.amount_histogram(events_ledger(spark, sf_dir), 0, 500)


@query("w8_amount_percentiles", "SELECT channel, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.75), 6) AS p75, round(quantile_cont(amount, 0.95), 6) AS p95 FROM E GROUP BY channel", E)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.amount_percentiles(events_ledger(spark, sf_dir))


@query("a25_ranking_quality", """
, s AS (SELECT is_laundering AS label, amount AS score FROM L), c AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY score),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
t AS (SELECT sum(pos * (below + (n + 1) / 2)) AS ranks, sum(pos) AS p, sum(n) AS a, sum(CASE WHEN score >= 60000 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= 60000 THEN n - pos ELSE 0 END) AS fp FROM r)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round((ranks - p * (p + 1) / 2) / (p * (a - p)), 6) AS auc FROM t""", L)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ranking_quality(orders_ledger(spark, sf_dir).select(F.col("is_laundering").alias("label"), F.col("amount").alias("score")), 60_000)


@query("s26_data_contract", """
, c AS (SELECT count(*) AS rows, CAST(sum(CAST(amount IS NULL AS INT)) AS BIGINT) AS null_amounts, CAST(sum(CAST(amount <= 0 AS INT)) AS BIGINT) AS not_positive, CAST(sum(CAST(amount > 1e12 AS INT)) AS BIGINT) AS extreme,
        CAST(sum(CAST(src = dst AS INT)) AS BIGINT) AS self_transfers, count(*) - count(DISTINCT txn_id) AS repeated_ids, round(avg(amount), 4) AS mean_amount FROM E)
SELECT *, null_amounts * 200 <= rows AND not_positive + extreme + repeated_ids = 0 AS passed FROM c""", E)
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.data_contract(events_ledger(spark, sf_dir))


@query("g3_centrality", """
, p AS (SELECT DISTINCT src, dst FROM E),
d AS (SELECT account, CAST(sum(o) AS BIGINT) AS out_partners, CAST(sum(i) AS BIGINT) AS in_partners FROM (SELECT src AS account, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY account),
f AS (SELECT dst AS account, sum(amount) AS x FROM E GROUP BY dst)
SELECT account, out_partners, in_partners, round(coalesce(x, 0) / (SELECT sum(amount) FROM E), 9) AS pagerank,
       round(out_partners * in_partners / (SELECT max(out_partners * in_partners) FROM d), 9) AS betweenness FROM d LEFT JOIN f USING (account)""", E)
def central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(events_ledger(spark, sf_dir))


@query("g11_roles", """
, f AS (SELECT account, round(sum(CASE WHEN direction = 'in' THEN amount ELSE 0 END), 2) AS inflow, round(sum(CASE WHEN direction = 'out' THEN amount ELSE 0 END), 2) AS outflow,
        count(*) FILTER (direction = 'in') AS n_in, count(*) FILTER (direction = 'out') AS n_out FROM B GROUP BY account),
h AS (SELECT *, round(coalesce(inflow / nullif(inflow + outflow, 0), 0), 5) AS si, round(coalesce(outflow / nullif(inflow + outflow, 0), 0), 5) AS so FROM f),
q AS (SELECT *, (SELECT quantile_cont(si, 0.75) FROM h) AS pi, (SELECT quantile_cont(so, 0.75) FROM h) AS po FROM h),
r AS (SELECT *, CASE WHEN inflow + outflow = 0 THEN 'NORMAL' WHEN so > po AND si < 0.3 THEN 'SOURCE' WHEN si > pi AND so < 0.3 THEN 'SINK'
             WHEN si BETWEEN 0.3 AND 0.7 AND n_in >= 2 AND n_out >= 2 THEN 'MULE' ELSE 'NORMAL' END AS role FROM q)
SELECT account, inflow, outflow, n_in, n_out, role, round(CASE WHEN inflow + outflow = 0 THEN 0.5 WHEN role = 'SOURCE' THEN least(so * 1.2, 1) WHEN role = 'SINK' THEN least(si * 1.2, 1)
       WHEN role = 'MULE' THEN 1 - abs(si - 0.5) ELSE 0.6 END, 3) AS confidence FROM r""", L, BL)
def role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roles(orders_ledger(spark, sf_dir))


@query("p4_short_cycles", """
, e AS (SELECT src, dst, round(sum(amount), 2) AS t FROM L WHERE src <> dst GROUP BY ALL),
c AS (SELECT 2 AS length, a.src AS n1, a.dst AS n2, CAST(NULL AS BIGINT) AS n3, a.t AS f, b.t AS l FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
      UNION ALL SELECT 3, a.src, a.dst, b.dst, a.t, c.t FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT length, n1, n2, coalesce(n3, -1) AS n3, round(coalesce(least(f, l) / nullif(greatest(f, l), 0), 0), 6) AS return_ratio FROM c WHERE round(coalesce(least(f, l) / nullif(greatest(f, l), 0), 0), 6) >= 0.85""", L)
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.short_cycles(orders_ledger(spark, sf_dir), 0.85).fillna({"n3": -1})


@query("g8_hop_distances", """
, e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM L UNION ALL SELECT dst, src FROM L)),
h1 AS (SELECT DISTINCT dst AS account FROM e WHERE src IN (1, 2)), h2 AS (SELECT DISTINCT dst AS account FROM e WHERE src IN (SELECT account FROM h1))
SELECT account, min(hops) AS hops FROM (SELECT unnest([1, 2]) AS account, 0 AS hops UNION ALL SELECT account, 1 FROM h1 UNION ALL SELECT account, 2 FROM h2) GROUP BY account""", L)
def hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_distances(orders_ledger(spark, sf_dir), [1, 2], 2)


@query("g7_ego_edges", """
, n AS (SELECT 1 AS a UNION SELECT dst FROM L WHERE src = 1 UNION SELECT src FROM L WHERE dst = 1)
SELECT txn_id, src, dst, amount FROM L WHERE src IN (SELECT a FROM n) AND dst IN (SELECT a FROM n)""", L)
def ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_edges(orders_ledger(spark, sf_dir), [1], 1).select("txn_id", "src", "dst", "amount")


def _trail_sql(forward: bool, start: int, depth: int) -> str:
    here, there, t = ("src", "dst", "epoch_us(ts)") if forward else ("dst", "src", "-epoch_us(ts)")
    steps = [f"""
, eg AS (SELECT {here} AS h, {there} AS o, CAST(txn_id AS VARCHAR) AS id, {t} AS t FROM E WHERE src <> dst),
p1 AS (SELECT 1 AS depth, [id] AS trail, o AS reached, t FROM eg WHERE h = {start})"""]
    for d in range(2, depth + 1):
        steps.append(f""",
p{d} AS (SELECT {d} AS depth, list_append(trail, id) AS trail, e.o AS reached, e.t FROM p{d - 1} p JOIN eg e ON p.reached = e.h AND e.t >= p.t AND e.t - p.t <= 3600000000 WHERE NOT list_contains(trail, id))""")
    every = " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(1, depth + 1))
    return "".join(steps) + f"\nSELECT depth, array_to_string(trail, '>') AS trail, reached FROM ({every})"


@query("g13_temporal_paths", _trail_sql(True, 3, 5), E)
def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.temporal_paths(events_ledger(spark, sf_dir), 3, 5, 3600)


@query("g13_temporal_paths_back", _trail_sql(False, 3, 5), E)
def trail_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.temporal_paths(events_ledger(spark, sf_dir), 3, 5, 3600, forward=False)


@query("j13_next_hops", """
, eg AS (SELECT txn_id, src, dst, epoch_us(ts) AS t, amount FROM E),
j AS (SELECT a.txn_id, b.txn_id AS next_id, a.amount AS x, b.amount AS y, row_number() OVER (PARTITION BY a.txn_id ORDER BY b.t, b.txn_id) AS k
      FROM eg a JOIN eg b ON a.dst = b.src AND b.t > a.t AND b.t <= a.t + 7200000000 WHERE b.dst <> a.src)
SELECT txn_id, next_id, round(y / nullif(x, 0), 6) AS kept_ratio FROM j WHERE k = 1""", E)
def next_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_hops(events_ledger(spark, sf_dir), 7200)


@query("j14_shared_senders", """
, e AS (SELECT DISTINCT src, dst FROM L WHERE src <> dst)
SELECT a.dst, b.dst AS dst2, count(*) AS shared FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst GROUP BY ALL HAVING count(*) >= 6""", L)
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_senders(orders_ledger(spark, sf_dir), 6)


@query("g18_graph_summary", """
, n AS (SELECT count(DISTINCT a) AS nodes FROM (SELECT src AS a FROM E UNION ALL SELECT dst FROM E)), m AS (SELECT count(*) AS edges FROM E)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density, round(2 * edges / nodes, 6) AS mean_degree FROM n, m""", E)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_summary(events_ledger(spark, sf_dir))


@query("g16_top_neighbours", """
, eg AS (SELECT src, dst, count(*) AS n, round(sum(amount), 2) AS total FROM E GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY total DESC, dst) AS place FROM eg)
SELECT * FROM r WHERE place <= 5""", E)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_neighbours(events_ledger(spark, sf_dir))


@query("m1_account_features", """
, o AS (SELECT account, count(*) FILTER (direction = 'in') AS in_degree, count(*) FILTER (direction = 'out') AS out_degree, sum(CASE WHEN direction = 'in' THEN amount ELSE 0 END) AS fi,
        sum(CASE WHEN direction = 'out' THEN amount ELSE 0 END) AS fo, avg(amount) AS av, coalesce(stddev_samp(amount), 0) AS sd, max(amount) AS mx, count(*) AS n, count(DISTINCT channel) AS ch,
        count(*) FILTER (direction = 'out' AND amount >= 90000 AND amount < 100000) AS near, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS span,
        avg(CAST(isodow(ts) >= 6 AS INT)) AS we, avg(CAST(hour(ts) IN (23, 0, 1, 2, 3, 4) AS INT)) AS ni, count(DISTINCT other) FILTER (direction = 'out') AS po, count(DISTINCT other) FILTER (direction = 'in') AS pi,
        avg(CAST(amount % 100 = 0 AS INT)) FILTER (direction = 'out') AS ro,
        count(DISTINCT to_bank) FILTER (direction = 'out') + count(DISTINCT from_bank) FILTER (direction = 'in') AS bk, avg(CAST(from_bank <> to_bank AS INT)) FILTER (direction = 'out') AS cb FROM B GROUP BY account),
d AS (SELECT account, max(k) AS day FROM (SELECT account, CAST(ts AS DATE), count(*) AS k FROM B GROUP BY ALL) GROUP BY account),
p AS (SELECT DISTINCT src, dst FROM L), mu AS (SELECT a.src AS account, count(*) AS mutual FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
dg AS (SELECT account, sum(x) * sum(y) AS pr FROM (SELECT src AS account, 1 AS x, 0 AS y FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY account),
fl AS (SELECT dst AS account, sum(amount) AS x FROM L GROUP BY dst)
SELECT account, CAST(in_degree AS DOUBLE) AS in_degree, CAST(out_degree AS DOUBLE) AS out_degree, round(fi + 1e-7, 4) + 0.0 AS total_in_flow, round(fo + 1e-7, 4) + 0.0 AS total_out_flow, round(fi - fo + 1e-7, 4) + 0.0 AS net_flow,
  round(coalesce(fl.x, 0) / (SELECT sum(amount) FROM L) + 1e-7, 4) + 0.0 AS pagerank, round(coalesce(pr / (SELECT max(pr) FROM dg), 0) + 1e-7, 4) + 0.0 AS betweenness, 0.0::DOUBLE AS clustering_coeff,
  round(av + 1e-7, 4) + 0.0 AS avg_txn_amount, round(sd + 1e-7, 4) + 0.0 AS std_txn_amount, round(mx + 1e-7, 4) + 0.0 AS max_txn_amount, n::DOUBLE AS txn_count, ch::DOUBLE AS unique_channels, round(ch / log2(n + 1) + 1e-7, 4) + 0.0 AS channel_entropy,
  day::DOUBLE AS velocity_1hour, near::DOUBLE AS near_threshold_count, floor(span / 86400)::DOUBLE AS dormancy_days,
  round(coalesce(declared_income, 0) / 12 / (fi + fo) + 1e-7, 4) + 0.0 AS income_volume_ratio, round(we + 1e-7, 4) + 0.0 AS is_weekend_heavy, round(ni + 1e-7, 4) + 0.0 AS night_txn_ratio, round(coalesce(mutual, 0) / (po + pi) + 1e-7, 4) + 0.0 AS reciprocity_ratio,
  day::DOUBLE AS max_daily_txn_count, round(coalesce(ro, 0) + 1e-7, 4) + 0.0 AS round_number_ratio, round(span / n + 1e-7, 4) + 0.0 AS temporal_regularity, round((po + pi) / n + 1e-7, 4) + 0.0 AS new_counterparty_ratio, round(least(bk, 50) / 50 + 1e-7, 4) + 0.0 AS geographic_dispersion, round(coalesce(cb, 0.5) + 1e-7, 4) + 0.0 AS cross_bank_ratio, round(least(sd / av, 10) + 1e-7, 4) + 0.0 AS amount_concentration
FROM o JOIN d USING (account) LEFT JOIN mu USING (account) LEFT JOIN dg USING (account) LEFT JOIN fl USING (account) LEFT JOIN A USING (account)""", L, BL, A)
def feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.account_features(orders_ledger(spark, sf_dir), accounts(spark, sf_dir), 90_000, 100_000, 100)
    # means of cents often lie halfway between two rounded values: both sides of the comparison push them up
    return rows.select("account", *((F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c) for c in rows.columns if c != "account"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = orders_ledger(spark, sf_dir)
    day = F.lit("2024-01-01").cast("date").alias("day")
    band_ = detectors.amount_band_count(txn, 50_000, 100_000).select(F.col("src").alias("account"), F.lit("structuring").alias("kind"), day, "score")
    pay = detectors.income_mismatch(txn, accounts(spark, sf_dir), 50).select("account", F.lit("profile_mismatch").alias("kind"), day, "score")
    return band_.unionByName(pay)


_FINDINGS = f"""{L}, {BL}, {A},
f AS (SELECT src AS account, 'structuring' AS kind, DATE '2024-01-01' AS day, round(least(1.0, n / 10.0 * 0.5 + total / 500000.0 * 0.5), 6) AS score
      FROM (SELECT src, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM L WHERE amount >= 50000 AND amount < 100000)) // 30 AS bin, count(*) AS n, sum(amount) AS total
            FROM L WHERE amount >= 50000 AND amount < 100000 GROUP BY ALL) WHERE n >= 3
      UNION ALL SELECT account, 'profile_mismatch', DATE '2024-01-01', round(least(1.0, least(r / 100, 0.5) + 0.3 + least(v / 1e7, 0.2)), 6)
      FROM (SELECT account, v, v / greatest(declared_income, 1.0) AS r FROM (SELECT account, round(sum(amount), 2) AS v FROM B GROUP BY account) JOIN A USING (account) WHERE declared_income > 0) WHERE r > 50)"""


@query("m5_pattern_scores", """
, k AS (SELECT DISTINCT account, kind, CASE kind WHEN 'structuring' THEN 20 ELSE 15 END AS w FROM f),
s AS (SELECT account, string_agg(kind, ',' ORDER BY kind) AS kinds, round(least(sum(w), 100) * 0.55, 2) AS pattern_score FROM k GROUP BY account)
SELECT *, CASE WHEN pattern_score >= 76 THEN 'CRITICAL' WHEN pattern_score >= 51 THEN 'HIGH' WHEN pattern_score >= 26 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM s""", _FINDINGS)
def pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pattern_scores(_findings(spark, sf_dir))


@query("m9_alerts", "SELECT 'ALT-' || upper(substr(sha256(concat_ws('-', account, kind, day)), 1, 12)) AS alert_id, account, kind, CAST(day AS VARCHAR) AS day, round(max(score), 6) AS score FROM f GROUP BY account, kind, day", _FINDINGS)
def alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.alerts(_findings(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("m13_similar_rows", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))), 4) AS cosine
FROM embeddings, q WHERE vec_id <> 7 ORDER BY cosine DESC, vec_id LIMIT 10""")
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.similar_rows(table(spark, sf_dir, "embeddings"), 7)


@query("m13_similar_rows_batch", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.e, q.e) / (v.n * q.n), 4) AS cosine
FROM v, v q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.e, q.e) / (v.n * q.n), 4) DESC, v.vec_id) <= 10""")
def similar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return features.similar_to_each(vectors.where("vec_id % 20 = 0"), vectors)


@query("x5_continuation", """
, a AS (SELECT DISTINCT src FROM L WHERE year(ts) = 1995), b AS (SELECT DISTINCT src FROM L WHERE year(ts) = 1996)
SELECT coalesce(a.src, b.src) AS account, CASE WHEN b.src IS NULL THEN 'left' WHEN a.src IS NULL THEN 'new' ELSE 'returning' END AS state FROM a FULL JOIN b ON a.src = b.src""", L)
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = orders_ledger(spark, sf_dir)
    return sets.continuation(txn.where(F.year("ts") == 1995), txn.where(F.year("ts") == 1996))


@query("x6_keep_last", ", r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, txn_id DESC) AS k FROM E) SELECT src, txn_id, amount FROM r WHERE k = 1", E)
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.keep_last(events_ledger(spark, sf_dir), "src", ["ts", "txn_id"]).select("src", "txn_id", "amount")


@query("x3_complement", "SELECT account FROM A WHERE account NOT IN (SELECT src FROM L WHERE amount >= 90000)", L, A)
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = orders_ledger(spark, sf_dir).where("amount >= 90000").select(F.col("src").alias("account"))
    return sets.complement(accounts(spark, sf_dir), big)


@query("f2_search", "SELECT txn_id, src, dst, amount FROM E WHERE amount BETWEEN 100 AND 300 AND channel <> 'view' ORDER BY amount DESC, txn_id LIMIT 50 OFFSET 100", E)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = sets.search(events_ledger(spark, sf_dir), F.col("amount").between(100, 300) & (F.col("channel") != "view"), [F.desc("amount"), F.asc("txn_id")], 100, 50)
    return page.select("txn_id", "src", "dst", "amount")


@query("j18_touching", "SELECT txn_id, src, dst FROM E WHERE src IN (SELECT DISTINCT src FROM E WHERE amount > 450) OR dst IN (SELECT DISTINCT src FROM E WHERE amount > 450)", E)
def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    return sets.touching(txn, txn.where("amount > 450").select(F.col("src").alias("account")).distinct()).select("txn_id", "src", "dst")


@query("r2_rule_tree", """
, p AS (SELECT src FROM (SELECT src, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM L WHERE amount >= 50000 AND amount < 100000)) // 30 AS b, count(*) AS n FROM L WHERE amount >= 50000 AND amount < 100000 GROUP BY ALL) WHERE n >= 3),
s AS (SELECT src FROM (SELECT src, CAST(ts AS DATE), count(*) AS n, round(sum(amount), 2) AS t FROM L GROUP BY ALL) WHERE n >= 2 AND t >= 90000 AND t < 100000)
SELECT DISTINCT src AS account FROM p WHERE src NOT IN (SELECT src FROM s)""", L)
def rule_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"op": "AND", "conditions": [
        {"primitive": "amount_band_count", "params": {"lower": 50_000.0, "upper": 100_000.0}},
        {"op": "NOT", "conditions": [{"primitive": "split_sum_threshold", "params": {"lower": 90_000.0, "upper": 100_000.0}}]},
    ]}
    return rules.matches(rule, orders_ledger(spark, sf_dir), accounts(spark, sf_dir))


@query("j8_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey")


@query("i1_timeline", "SELECT account, other, direction, txn_id, amount FROM B WHERE account = 5 ORDER BY ts DESC, txn_id DESC, direction LIMIT 10000", E, BE)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = both_sides(events_ledger(spark, sf_dir)).where("account = 5")
    return rows.orderBy(F.desc("ts"), F.desc("txn_id"), "direction").limit(10_000).select("account", "other", "direction", "txn_id", "amount")


def _chains_sql(window_us: int, min_hops: int, max_hops: int) -> str:
    steps = [f"""
, eg AS (SELECT txn_id, src, dst, epoch_us(ts) AS t, amount FROM E WHERE src <> dst),
nx AS (SELECT b.txn_id AS next_id FROM eg a JOIN eg b ON a.dst = b.src AND b.t > a.t AND b.t <= a.t + {window_us} WHERE b.dst <> a.src QUALIFY row_number() OVER (PARTITION BY a.txn_id ORDER BY b.t, b.txn_id) = 1),
c1 AS MATERIALIZED (SELECT txn_id AS start_id, [src, dst] AS nodes, dst AS at, t AS t0, t, amount AS f, amount AS l FROM eg WHERE txn_id NOT IN (SELECT next_id FROM nx))"""]
    for k in range(2, max_hops + 1):
        steps.append(f""",
c{k} AS MATERIALIZED (SELECT start_id, list_append(nodes, b.dst) AS nodes, b.dst AS at, t0, b.t, f, b.amount AS l FROM c{k - 1} p JOIN eg b ON p.at = b.src AND b.t > p.t AND b.t <= p.t0 + {window_us}
       WHERE NOT list_contains(nodes, b.dst) QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY b.t, b.txn_id) = 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, max_hops + 1))
    return "".join(steps) + f"""
SELECT start_id, array_to_string(nodes, '>') AS path, CAST(len(nodes) - 1 AS BIGINT) AS hops, (t - t0) // 1000000 AS span_s, round(l / f, 6) AS kept_ratio
FROM ({every}) WHERE len(nodes) - 1 >= {min_hops} QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY len(nodes) DESC) = 1"""


@query("g6_greedy_chains", _chains_sql(7_200_000_000, 3, 21), E)
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.greedy_chains(events_ledger(spark, sf_dir), 7200, 3, 21)


@query("g5_long_cycles", """
, eg AS (SELECT src, dst FROM L WHERE src <> dst GROUP BY ALL),
p2 AS (SELECT src AS s, [src, dst] AS nodes, dst AS z FROM eg WHERE src < dst),
p3 AS (SELECT s, list_append(nodes, dst) AS nodes, dst AS z FROM p2 JOIN eg ON z = src WHERE dst > s AND NOT list_contains(nodes, dst)),
p4 AS (SELECT s, list_append(nodes, dst) AS nodes, dst AS z FROM p3 JOIN eg ON z = src WHERE dst > s AND NOT list_contains(nodes, dst)),
p5 AS (SELECT s, list_append(nodes, dst) AS nodes, dst AS z FROM p4 JOIN eg ON z = src WHERE dst > s AND NOT list_contains(nodes, dst)),
p AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5),
c AS (SELECT min(nodes) AS nodes FROM p JOIN eg ON z = src AND dst = s GROUP BY list_sort(nodes))
SELECT CAST(len(nodes) AS BIGINT) AS length, array_to_string(nodes, '>') AS cycle FROM c""", L)
def more_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.long_cycles(orders_ledger(spark, sf_dir), 5, None)


@query("g18_components", """
, eg AS (SELECT src, dst FROM L WHERE amount >= 100000 UNION SELECT dst, src FROM L WHERE amount >= 100000),
k AS (SELECT src AS account, src AS reach FROM eg UNION SELECT account, dst FROM k JOIN eg ON reach = src)
SELECT account, min(reach) AS component FROM k GROUP BY account""", L)
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.components(orders_ledger(spark, sf_dir).where("amount >= 100000"))


ORACLE["g18_components"] = ORACLE["g18_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("g18_components_whole", """
, eg AS MATERIALIZED (SELECT src, dst FROM L WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM L WHERE src IS NOT NULL AND dst IS NOT NULL),
k(account, component) USING KEY (account) AS (
  SELECT DISTINCT src, src FROM eg
  UNION SELECT eg.dst, min(k.component) FROM k JOIN eg ON k.account = eg.src JOIN recurring.k AS r ON r.account = eg.dst WHERE k.component < r.component GROUP BY eg.dst)
SELECT account, component FROM k""", L)
def weak_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every transfer; g18_components is the same graph above an amount."""
    return walks.components(orders_ledger(spark, sf_dir))


ORACLE["g18_components_whole"] = ORACLE["g18_components_whole"].replace("WITH ", "WITH RECURSIVE ", 1)


def _walk_sql(start: int, restart: float, rounds: int) -> str:
    steps = [f"""
, m AS (SELECT s, d, count(*) AS n FROM (SELECT src AS s, dst AS d FROM E WHERE src <> dst UNION ALL SELECT dst, src FROM E WHERE src <> dst) GROUP BY ALL),
w AS MATERIALIZED (SELECT s, d, n / sum(n) OVER (PARTITION BY s) * (1 - {restart}) AS w FROM m),
r0 AS (SELECT CAST({start} AS BIGINT) AS account, 1.0::DOUBLE AS score)"""]
    for k in range(1, rounds + 1):
        steps.append(f""",
r{k} AS (SELECT account, sum(score) AS score FROM (SELECT d AS account, score * w AS score FROM r{k - 1} JOIN w ON account = s UNION ALL SELECT {start}, {restart}::DOUBLE) GROUP BY account)""")
    return "".join(steps) + f"\nSELECT account, round(score, 6) AS score FROM r{rounds}"


@query("g17_walk_with_restart", _walk_sql(3, 0.15, 10), E)
def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.walk_with_restart(events_ledger(spark, sf_dir), 3, 0.15, 10)


@query("m10_bandit_state", """
, x AS (SELECT channel AS action, ln(1 + amount) AS u, CAST(hour(ts) AS DOUBLE) / 24 AS v, CASE WHEN amount >= 50 THEN 1.0 ELSE -0.3 END AS r FROM E)
SELECT action, count(*) AS n, round(sum(u * u), 4) AS a_0_0, round(sum(u * v), 4) AS a_0_1, round(sum(v * v), 4) AS a_1_1, round(sum(r * u), 4) AS b_0, round(sum(r * v), 4) AS b_1 FROM x GROUP BY action""", E)
def bandit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir).select("channel", F.log1p("amount").alias("u"), (F.hour("ts") / 24).alias("v"), F.when(F.col("amount") >= 50, 1.0).otherwise(-0.3).alias("r"))
    state = bandit.linucb_state(rows, ["u", "v"], "channel", "r")
    return state.select("action", "n", *[F.round(c, 4).alias(c) for c in state.columns[2:]])


from tracewell.plans import behaviour, desk, facts, intake, models, networks, parts  # noqa: E402, F401  (registers its queries)
