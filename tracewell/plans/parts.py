"""Registered queries of strongly connected parts, of cycles within them, and of chains that use a transfer once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import materialise
from tracewell.operators import detectors, parts, walks
from tracewell.plans.registry import E, L, query
from tracewell.session import cut, few
from tracewell.sources.ledgers import events_ledger, orders_ledger


@query("g5_scc", """
, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM L WHERE src <> dst),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS account, a.dst AS mate FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src),
n AS (SELECT src AS account FROM L UNION SELECT dst FROM L)
SELECT account, least(account, coalesce(min(mate), account)) AS part, greatest(count(mate), 1) AS size FROM n LEFT JOIN m USING (account) GROUP BY account""", "RECURSIVE " + L)
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.strong_parts(orders_ledger(spark, sf_dir))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_ledger(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM"))


def _cycles_sql(size: str = "", longer: str = "") -> str:
    """Cycles within each month's parts: c (month, nodes), by growing paths from a cycle's least account; conditions on a part's size and on paths that grow."""
    return f"""
, e AS MATERIALIZED (SELECT DISTINCT strftime(ts, '%Y-%m') AS month, src, dst FROM L WHERE src <> dst),
r AS (SELECT month, src, dst FROM e UNION SELECT r.month, r.src, e.dst FROM r JOIN e ON r.month = e.month AND r.dst = e.src),
m AS (SELECT a.month, a.src, a.dst FROM r a JOIN r b ON a.month = b.month AND a.src = b.dst AND a.dst = b.src),
z AS (SELECT month, src AS account, count(*) AS size FROM m GROUP BY ALL),
i AS MATERIALIZED (
  SELECT e.month, e.src, e.dst FROM e JOIN m ON e.month = m.month AND e.src = m.src AND e.dst = m.dst JOIN z ON z.month = e.month AND z.account = e.src{size}),
p AS (
  SELECT month, [src, dst] AS nodes FROM i WHERE src < dst
  UNION ALL SELECT p.month, list_append(nodes, i.dst) FROM p JOIN i ON p.month = i.month AND p.nodes[-1] = i.src AND i.dst > nodes[1] AND NOT list_contains(nodes, i.dst){longer}),
o AS (SELECT p.month, nodes FROM p JOIN i ON p.month = i.month AND i.src = nodes[-1] AND i.dst = nodes[1]),
c AS (SELECT month, min(nodes) AS nodes FROM o GROUP BY month, list_sort(nodes))"""


@query("g5_part_cycles", _cycles_sql(" AND size BETWEEN 2 AND 500", " WHERE len(nodes) < 12") + "SELECT month, CAST(len(nodes) AS BIGINT) AS length, array_to_string(nodes, '>') AS cycle FROM c", "RECURSIVE " + L)
def part_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts.cycle_nodes(_monthly(spark, sf_dir), by=("month",))
    return found.select("month", F.size("nodes").cast("long").alias("length"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("cycle"))


@query("p4_part_round_trips", _cycles_sql() + """
, k AS (SELECT month, nodes, unnest(range(1, len(nodes) + 1)) AS leg FROM c),
t AS (SELECT strftime(ts, '%Y-%m') AS month, src, dst, amount, epoch_us(ts) AS t FROM L),
s AS (
  SELECT k.month, nodes, count(*) AS n, sum(amount) AS total, max(t) - min(t) AS span, sum(amount) FILTER (leg = 1) AS sent, sum(amount) FILTER (leg = len(nodes)) AS back
  FROM k JOIN t ON k.month = t.month AND t.src = nodes[leg] AND t.dst = nodes[leg % len(nodes) + 1] GROUP BY ALL),
x AS (SELECT *, coalesce(back / nullif(sent, 0), 0) AS ratio FROM s)
SELECT month, array_to_string(nodes, '>') AS cycle, CAST(len(nodes) AS BIGINT) AS length, n AS n_txns, round(total, 2) AS total, round(span / 3600000000, 4) AS span_hours, round(ratio, 6) AS return_ratio,
       round(least(1, CASE WHEN ratio >= 0.85 THEN 0.4 ELSE 0.1 END + least(len(nodes) / 10, 0.3) + least(total / 1234567, 0.3)), 6) AS score,
       CASE WHEN ratio >= 0.85 AND len(nodes) >= 3 THEN 'CRITICAL' WHEN ratio >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM x""", "RECURSIVE " + L)
def part_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved between each pair of a month is written once: cycles are looked for in it, and their few legs find their sums there."""
    moved = materialise(detectors.flows(_monthly(spark, sf_dir), ("month",)), "flows")
    pairs = moved.where(F.col("src") != F.col("dst")).select("month", "src", "dst")
    cycles = few(cut(parts.every_cycle(pairs, ("month",))))
    return detectors.trips_of(moved, cycles, unit=1_234_567.0, by=("month",))


@query("g6_used_once", """
, eg AS MATERIALIZED (SELECT txn_id, src, dst, epoch_us(ts) AS t, amount FROM E WHERE src <> dst),
walk AS (
  SELECT txn_id AS s, [src, dst] AS nodes, [t] AS times, t AS t0, amount AS total FROM eg
  UNION ALL
  SELECT s, list_append(nodes, dst), list_append(times, t), t0, total + amount
  FROM (SELECT p.s, p.nodes, p.times, p.t0, p.total, b.dst, b.t, b.amount, row_number() OVER (PARTITION BY p.s ORDER BY b.t, b.txn_id) AS k
        FROM walk p JOIN eg b ON p.nodes[-1] = b.src AND b.t > p.times[-1] AND b.t <= p.t0 + 7200000000 AND NOT list_contains(p.nodes, b.dst) WHERE len(p.times) < 21) WHERE k = 1),
whole AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY s ORDER BY len(times) DESC) = 1),
ranked AS MATERIALIZED (
  SELECT w.*, list_transform(range(1, len(times) + 1), lambda i: concat_ws(':', nodes[i], nodes[i + 1], times[i])) AS legs, row_number() OVER (ORDER BY d DESC, nodes[1], t0, s) AS r
  FROM whole w JOIN (SELECT src, count(*) AS d FROM eg GROUP BY src) o ON o.src = nodes[1] WHERE len(times) >= 3),
pick AS (
  SELECT 0::BIGINT AS r, []::VARCHAR[] AS used, false AS ok
  UNION ALL SELECT q.r, CASE WHEN list_contains(used, legs[1]) THEN used ELSE used || legs END, NOT list_contains(used, legs[1]) FROM pick p JOIN ranked q ON q.r = p.r + 1)
SELECT s AS start_id, array_to_string(nodes, '>') AS path, CAST(len(times) AS BIGINT) AS hops, (times[-1] - t0) // 1000000 AS span_s, round(total, 2) AS total FROM ranked JOIN pick USING (r) WHERE ok""", "RECURSIVE " + E)
def used_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.used_once(events_ledger(spark, sf_dir), 7200)
