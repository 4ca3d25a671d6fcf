"""Registered queries of networks and of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.investigation import networks
from tracewell.operators import detectors, scoring, walks
from tracewell.operators.graph import centrality
from tracewell.plans.desk import AL, CA
from tracewell.plans.registry import BE, A, E, L, query
from tracewell.sources import desk as tables
from tracewell.sources.ledgers import accounts, events_ledger, orders_ledger, table

_risk = lambda rows: rows.groupBy("account").agg(F.max("risk").alias("risk"))
R = "R AS (SELECT account, max(risk) AS risk FROM AL GROUP BY account)"
REP = "REP AS (SELECT DISTINCT account FROM AL JOIN CA USING (case_id) WHERE resolution = 'TRUE_POSITIVE_SAR')"


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = tables.cases(spark, sf_dir).where("resolution = 'TRUE_POSITIVE_SAR'").select("case_id")
    return tables.alerts(spark, sf_dir).join(closed, "case_id", "left_semi").select("account").distinct()


_EGO = """
, n AS (SELECT 3 AS a UNION SELECT dst FROM E WHERE src = 3 UNION SELECT src FROM E WHERE dst = 3),
g AS (SELECT * FROM E WHERE src IN (FROM n) AND dst IN (FROM n) AND amount >= 30 AND (src = 3 OR dst <> 3)),
k AS (SELECT account FROM R WHERE risk >= 40 AND account IN (SELECT src FROM g UNION SELECT dst FROM g) UNION SELECT 3)
SELECT txn_id, src, dst FROM g WHERE src IN (FROM k) AND dst IN (FROM k)"""


@query("g9_filtered_ego", _EGO, AL, R, E)
def filtered_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = _risk(tables.alerts(spark, sf_dir))
    _, edges = networks.filtered_ego(events_ledger(spark, sf_dir), 3, 1, F.col("amount") >= 30, F.col("risk") >= 40, risk, "out")
    return edges.select("txn_id", "src", "dst")


@query("g15_validation_subgraph", """
, nb AS (SELECT o AS account, max(amount) AS x FROM (SELECT dst AS o, amount FROM E WHERE src = 3 AND dst <> 3 UNION ALL SELECT src, amount FROM E WHERE dst = 3 AND src <> 3) GROUP BY o ORDER BY x DESC, account LIMIT 20),
u AS (SELECT 3 AS account, 0 AS o, 0.0 AS x UNION ALL SELECT account, 1, 0.0 FROM REP UNION ALL SELECT account, 2, -x FROM nb),
b AS (SELECT account, min(o) AS o, arg_min(x, (o, x)) AS x FROM u GROUP BY account)
SELECT account, ['centre', 'evidence', 'neighbour'][o + 1] AS why FROM b ORDER BY o, x, account LIMIT 40""", AL, CA, REP, E)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.validation_subgraph(events_ledger(spark, sf_dir), 3, _reported(spark, sf_dir))


@query("g16_drawn_subgraph", """
, t AS (SELECT account FROM R ORDER BY risk DESC, account LIMIT 30), eg AS (SELECT src, dst, round(sum(amount), 2) AS total FROM E WHERE src <> dst GROUP BY ALL)
SELECT src, dst, total FROM (SELECT * FROM eg WHERE src IN (FROM t) QUALIFY row_number() OVER (PARTITION BY src ORDER BY total DESC, dst) <= 5)
UNION SELECT src, dst, total FROM (SELECT * FROM eg WHERE dst IN (FROM t) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY total DESC, src) <= 5)""", AL, R, E)
def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.drawn_subgraph(events_ledger(spark, sf_dir), _risk(tables.alerts(spark, sf_dir)), 30)


@query("g20_filtered_graph", "SELECT txn_id, src, dst, amount FROM E WHERE src IN (SELECT account FROM R WHERE risk >= 60) AND dst IN (SELECT account FROM R WHERE risk >= 60) AND channel <> 'view' ORDER BY amount DESC, txn_id LIMIT 300", AL, R, E)
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = _risk(tables.alerts(spark, sf_dir)).where("risk >= 60")
    return networks.filtered_graph(events_ledger(spark, sf_dir), risky, F.col("channel") != "view")


@query("g23_path_facts", """
, x AS (SELECT dst AS other, 'out' AS direction, amount FROM E WHERE src = 3 AND dst <> 3 UNION ALL SELECT src, 'in', amount FROM E WHERE dst = 3 AND src <> 3),
s AS (SELECT other, direction, round(sum(amount), 2) AS total FROM x GROUP BY ALL)
SELECT other, direction, total, round(100 * total / sum(total) OVER (PARTITION BY direction), 2) AS share, other IN (FROM REP) AS prior_report FROM s""", AL, CA, REP, E)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.path_facts(events_ledger(spark, sf_dir), 3, _reported(spark, sf_dir))


@query("m3_labels", "SELECT account, CAST(account IN (SELECT src FROM L WHERE is_laundering = 1) AS INT) AS label FROM (SELECT src AS account FROM L UNION SELECT dst FROM L)", L)
def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.labels(orders_ledger(spark, sf_dir))


@query("m4_temporal_split", """
, l AS (SELECT account, max(epoch_us(ts)) AS t FROM B GROUP BY account), p AS (SELECT account, row_number() OVER (ORDER BY t, account) - 1 AS k, count(*) OVER () AS n FROM l)
SELECT account, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS part FROM p""", E, BE)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.temporal_split(events_ledger(spark, sf_dir))


@query("w9_percentile_rank", "SELECT alert_id, round(cume_dist() OVER (ORDER BY risk), 9) AS rank FROM AL", AL)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.percentile_rank(tables.alerts(spark, sf_dir).select("alert_id", "risk"), "risk", "rank").select("alert_id", F.round("rank", 9).alias("rank"))


_ENSEMBLE = """
, p AS (SELECT DISTINCT src, dst FROM E),
d AS (SELECT account, sum(o) * sum(i) AS pr FROM (SELECT src AS account, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY account),
f AS (SELECT dst AS account, round(sum(amount) / (SELECT sum(amount) FROM E), 9) AS pagerank FROM E GROUP BY dst),
c AS (SELECT account, pagerank, round(pr / (SELECT max(pr) FROM d), 9) AS betweenness FROM d LEFT JOIN f USING (account)),
n AS (SELECT greatest(count(*), 1) AS n FROM c WHERE pagerank IS NOT NULL),
a AS (SELECT account, (SELECT count(*) FROM c x WHERE x.pagerank <= c.pagerank) / n AS pp FROM c, n WHERE pagerank IS NOT NULL),
b AS (SELECT account, (SELECT count(*) FROM c x WHERE x.betweenness <= c.betweenness) / n AS bp FROM c, n),
k AS (SELECT account, sum(CASE kind WHEN 'layering' THEN 25 WHEN 'round_trip' THEN 30 WHEN 'structuring' THEN 20 WHEN 'dormancy' THEN 20 WHEN 'profile_mismatch' THEN 15 ELSE 22 END) AS raw FROM (SELECT DISTINCT account, kind FROM AL WHERE risk >= 60) GROUP BY account),
q AS (SELECT account, (account % 10) / 10 AS fp FROM c),
s AS (SELECT c.account, CASE WHEN fp >= 0.6 THEN fp * 30 ELSE 0 END AS ml, least(coalesce(raw, 0), 100) * 0.55 AS pattern,
      CASE WHEN raw IS NULL THEN 0 ELSE (greatest(0, coalesce(pp, 0) - 0.5) * 50 + greatest(0, coalesce(bp, 0) - 0.5) * 50) * 0.3 END AS graph,
      CASE WHEN raw IS NOT NULL AND fp > 0.5 THEN (fp - 0.5) / 0.5 * 15 ELSE 0 END AS bonus
      FROM c LEFT JOIN a USING (account) LEFT JOIN b USING (account) LEFT JOIN k USING (account) JOIN q USING (account))
SELECT account, round(ml, 4) AS ml, round(pattern, 4) AS pattern, round(graph, 4) AS graph, round(bonus, 4) AS bonus, round(least(ml + pattern + graph + bonus, 100), 2) AS score FROM s"""


@query("m5_ensemble", _ENSEMBLE, AL, E)
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    receives = txn.select(F.col("dst").alias("account")).distinct().withColumn("r", F.lit(True))
    central = centrality(txn).join(receives, "account", "left").select("account", F.when(F.col("r"), F.col("pagerank")).alias("pagerank"), "betweenness")
    fraud = central.select("account", (F.col("account") % 10 / 10).alias("fraud_prob")).withColumn("fraud_pred", F.col("fraud_prob") >= 0.6)
    return scoring.ensemble(tables.alerts(spark, sf_dir).where("risk >= 60"), central, fraud)


@query("m6_confidence", """
, k AS (SELECT account, count(DISTINCT kind) AS n, max(risk) AS risk, sum(score) AS s FROM AL GROUP BY account),
c AS (SELECT account, n + CAST(account % 10 > 5 AS INT) + CAST(risk / 10000 > 0.005 AS INT) + CAST(s / 1000 > 0.01 AS INT) AS signs FROM k)
SELECT account, signs, CASE WHEN signs >= 4 THEN 'Very Strong' WHEN signs >= 3 THEN 'Strong' WHEN signs >= 2 THEN 'Moderate' WHEN signs >= 1 THEN 'Weak' ELSE 'None' END AS level FROM c""", AL)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.alerts(spark, sf_dir).groupBy("account").agg(F.countDistinct("kind").alias("n"), F.max("risk").alias("risk"), F.sum("score").alias("s"))
    signs = scoring.indicator_count(F.col("n"), F.col("account") % 10 / 10, F.col("risk") / 10000, F.col("s") / 1000)
    return k.select("account", signs.alias("signs"), scoring.confidence(signs).alias("level"))


@query("m7_priority", """
, q AS (SELECT alert_id, CASE WHEN risk >= 76 THEN 40 WHEN risk >= 51 THEN 25 WHEN risk >= 26 THEN 10 ELSE 0 END
        + CASE ['Weak', 'Moderate', 'Strong', 'Very Strong'][account % 4 + 1] WHEN 'Very Strong' THEN 30 WHEN 'Strong' THEN 20 WHEN 'Moderate' THEN 10 ELSE 5 END
        + CASE WHEN score * 2e7 >= 10000000 THEN 20 WHEN score * 2e7 >= 1000000 THEN 10 ELSE 0 END + CASE WHEN account % 9 >= 5 THEN 10 ELSE 0 END AS p FROM AL)
SELECT alert_id, CASE WHEN p >= 88 THEN 'P1' WHEN p >= 58 THEN 'P2' WHEN p >= 28 THEN 'P3' ELSE 'P4' END AS priority FROM q""", AL)
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, ["Weak", "Moderate", "Strong", "Very Strong"])), (F.col("account") % 4).cast("int"))
    return tables.alerts(spark, sf_dir).select("alert_id", scoring.priority(F.col("risk"), level, F.col("score") * 2e7, F.col("account") % 9).alias("priority"))


@query("m9_alert_rows", """
, f AS (SELECT ['s' || account, 'p' || (account % 5), 's' || account] AS ids, kind, CAST(created AS DATE) AS day, score, severity FROM AL),
i AS (SELECT list_sort(list_distinct(ids)) AS ids, kind, day, max(score) AS score, arg_max(severity, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS severity FROM f GROUP BY ALL),
w AS (SELECT 's' || account AS account, max(risk) AS risk FROM AL GROUP BY account),
r AS (SELECT *, 'ALT-' || upper(substr(sha256(concat_ws('-', array_to_string(ids, ','), kind, day)), 1, 12)) AS alert_id, coalesce((SELECT risk FROM w WHERE w.account = ids[2]), 0) AS rs FROM i)
SELECT alert_id, array_to_string(ids, ',') AS account_ids, ids[CASE WHEN rs > 0 THEN 2 ELSE 1 END] AS primary_account, kind, CAST(day AS VARCHAR) AS day, round(score, 6) AS score, severity, round(rs, 2) AS risk,
       CASE WHEN list_contains(ids, 'p3') THEN 'P1' WHEN (CASE WHEN rs >= 76 THEN 40 WHEN rs >= 51 THEN 25 WHEN rs >= 26 THEN 10 ELSE 0 END) + 5 >= 28 THEN 'P3' ELSE 'P4' END AS priority FROM r""", AL)
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.alerts(spark, sf_dir)
    own, pool = F.concat(F.lit("s"), "account"), F.concat(F.lit("p"), F.col("account") % 5)
    found = rows.select(F.array(own, pool, own).alias("account_ids"), "kind", F.to_date("created").alias("day"), "score", "severity")
    scores = _risk(rows.withColumn("account", own))
    watched = spark.createDataFrame([("p3",)], "account string")
    return scoring.alert_rows(found, scores, watched).withColumn("day", F.col("day").cast("string"))


@query("m11_rl_context", """
, k AS (SELECT *, 1 + account % 12 AS n, account * 1000.0 AS x FROM AL), l AS (SELECT ['layering', 'round_trip', 'structuring', 'dormancy', 'profile_mismatch', 'fan_out', 'fan_in'] AS names)
SELECT alert_id, array_to_string(list_transform([least(risk / 100, 1), least(score, 1), least(n / 10, 1), least(ln(1 + x) / 20, 1), 0.0, 0.0, 0.0, 0.0] || list_transform(names, lambda z: CAST(z = kind AS DOUBLE)) || [1.0], lambda v: printf('%.4f', v)), ',') AS context FROM k, l""", AL)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.lit(None).cast("double").alias(c)
    rows = tables.alerts(spark, sf_dir).select("alert_id", "risk", "score", "kind", (1 + F.col("account") % 12).alias("n_accounts"), (F.col("account") * 1000.0).alias("amount"), *(none(c) for c in ("n_txns", "age_days", "prior_alerts", "velocity")))
    return scoring.rl_context(rows).select("alert_id", F.array_join(F.transform("context", lambda v: F.format_string("%.4f", v)), ",").alias("context"))


@query("m14_explained", """
, c AS (SELECT user_id AS account, event_type AS feature, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 4) AS value FROM events GROUP BY ALL),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY account ORDER BY abs(value) DESC, feature) <= 3)
SELECT account, coalesce(string_agg(feature, ',' ORDER BY abs(value) DESC, feature) FILTER (value > 0), '') AS drivers, coalesce(string_agg(feature, ',' ORDER BY abs(value) DESC, feature) FILTER (value <= 0), '') AS protective FROM t GROUP BY account""", E)
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account"), F.col("event_type").alias("feature")).agg(F.round(F.sum(signed), 4).alias("value"))
    return scoring.explained(rows, 3)


def _chain_steps(window_us: int, hops: int, name: str) -> str:
    out = [f"{name}1 AS MATERIALIZED (SELECT txn_id AS s, [src, dst] AS nodes, dst AS at, t AS t0, t, amount AS f, amount AS l, amount AS total, 0 AS less FROM eg WHERE txn_id NOT IN (SELECT next_id FROM {name}n))"]
    for k in range(2, hops + 1):
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT s, list_append(nodes, b.dst) AS nodes, b.dst AS at, t0, b.t, f, b.amount AS l, total + b.amount AS total, less + CAST(b.amount < l AS INT) AS less
  FROM {name}{k - 1} p JOIN eg b ON p.at = b.src AND b.t > p.t AND b.t <= p.t0 + {window_us} WHERE NOT list_contains(nodes, b.dst) QUALIFY row_number() OVER (PARTITION BY s ORDER BY b.t, b.txn_id) = 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(1, hops + 1))
    nxt = f"{name}n AS (SELECT b.txn_id AS next_id FROM eg a JOIN eg b ON a.dst = b.src AND b.t > a.t AND b.t <= a.t + {window_us} WHERE b.dst <> a.src QUALIFY row_number() OVER (PARTITION BY a.txn_id ORDER BY b.t, b.txn_id) = 1)"
    return f"{nxt}, " + ", ".join(out) + f", {name} AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY s ORDER BY len(nodes) DESC) = 1)"


@query("p5_layering", f"""
, eg AS (SELECT txn_id, src, dst, epoch_us(ts) AS t, amount FROM E WHERE src <> dst), {_chain_steps(3_600_000_000, 21, "x")}, {_chain_steps(7_200_000_000, 21, "y")},
c AS (SELECT * FROM x WHERE len(nodes) > 2 UNION ALL SELECT * FROM (SELECT * FROM y WHERE len(nodes) > 4 AND nodes NOT IN (SELECT nodes FROM x WHERE len(nodes) > 2) QUALIFY row_number() OVER (PARTITION BY nodes ORDER BY s) = 1)),
d AS (SELECT *, len(nodes) - 1 AS hops, less / (len(nodes) - 2) AS decay, CASE WHEN f > 0 THEN l / f ELSE 0 END AS kept, CASE WHEN f > 0 THEN 1 - l / f ELSE 0 END AS lost, (t - t0) / 1000000 AS span FROM c),
g AS (SELECT *, span <= 3600 AND decay >= 0.5 AS tight, span <= 7200 AND hops >= 4 AS far FROM d)
SELECT array_to_string(nodes, '>') AS path, CAST(hops AS BIGINT) AS hops, (t - t0) // 1000000 AS span_s, CASE WHEN tight THEN 'tight' ELSE 'extended' END AS mode, round(decay, 6) AS decay, round(kept, 6) AS preserved, round(total, 2) AS total,
       round(greatest(0, least(1, decay * 0.4 + least(hops / 10, 0.3) + (1 - kept) * 0.3)), 6) AS score, CASE WHEN hops >= 5 AND lost >= 0.15 THEN 'CRITICAL' WHEN hops >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM g WHERE tight OR far""", E)
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    return detectors.layering(walks.grown_chains(txn, 3600, 2, 21), walks.grown_chains(txn, 7200, 4, 21), 3600, 7200)


@query("p7_bipartite", """
, r AS (SELECT dst, epoch_us(ts) AS t, count(DISTINCT src) OVER (PARTITION BY dst ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 12 HOURS FOLLOWING) AS k FROM E),
q AS (SELECT * FROM r WHERE k >= 3 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY k DESC, t) = 1),
s AS (SELECT DISTINCT q.dst AS d, E.src AS s FROM q JOIN E ON q.dst = E.dst AND epoch_us(E.ts) BETWEEN q.t AND q.t + 43200000000),
p AS (SELECT a.d AS d1, b.d AS d2, list(a.s ORDER BY a.s) AS shared FROM s a JOIN s b ON a.s = b.s AND a.d < b.d GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT list_sort(list_distinct(shared || [d1, d2])) AS k, arg_min(shared, (d1, d2, shared)) AS shared FROM p GROUP BY 1), g AS (SELECT row_number() OVER () AS g, shared FROM u),
l AS (SELECT g, unnest(shared) AS s FROM g), h AS (SELECT g, d FROM l JOIN s USING (s) GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT l.g, sum(amount) AS total FROM l JOIN h ON l.g = h.g JOIN E ON E.src = l.s AND E.dst = h.d GROUP BY l.g),
o AS (SELECT g, list(d ORDER BY d) AS rs FROM h GROUP BY g HAVING count(*) >= 2)
SELECT array_to_string(shared, ',') AS "left", array_to_string(rs, ',') AS "right", CAST(len(shared) AS BIGINT) AS n_left, CAST(len(rs) AS BIGINT) AS n_right, round(coalesce(total, 0), 2) AS total,
       round(least(1, least(len(shared) / 8, 0.4) + least(len(rs) / 8, 0.3) + least(coalesce(total, 0) / 5000, 0.3)), 6) AS score,
       CASE WHEN len(shared) >= 5 AND len(rs) >= 5 THEN 'CRITICAL' WHEN len(shared) >= 3 AND len(rs) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM g JOIN o USING (g) LEFT JOIN t USING (g)""", E)
def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.bipartite(events_ledger(spark, sf_dir), 0.5, 3, 5000.0)


@query("p4_round_trips", """
, eg AS (SELECT src, dst, count(*) AS n, sum(amount) AS x, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM L GROUP BY ALL),
c AS (SELECT [a.src, a.dst] AS nodes FROM eg a JOIN eg b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst),
k AS (SELECT nodes, p.n + q.n AS n_txns, p.x + q.x AS total, (greatest(p.z, q.z) - least(p.a, q.a)) / 3600000000 AS span, coalesce(q.x / nullif(p.x, 0), 0) AS r FROM c JOIN eg p ON p.src = nodes[1] AND p.dst = nodes[2] JOIN eg q ON q.src = nodes[2] AND q.dst = nodes[1])
SELECT array_to_string(nodes, '>') AS cycle, CAST(2 AS BIGINT) AS length, n_txns, round(total, 2) AS total, round(span, 4) AS span_hours, round(r, 6) AS return_ratio,
       round(least(1, CASE WHEN r >= 0.85 THEN 0.4 ELSE 0.1 END + 0.2 + least(total / 1234567, 0.3)), 6) AS score, CASE WHEN r >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM k""", L)
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = orders_ledger(spark, sf_dir)
    return detectors.round_trips(txn, walks.cycle_nodes(txn, 2, largest_part=None), unit=1_234_567.0)


@query("g19_path_ranks", f"""
, eg AS (SELECT txn_id, src, dst, epoch_us(ts) AS t, amount FROM E WHERE src <> dst), {_chain_steps(3_600_000_000, 21, "x")},
c AS (SELECT DISTINCT nodes FROM x WHERE len(nodes) > 2), n AS (SELECT nodes, unnest(nodes) AS account FROM c),
s AS (SELECT nodes, avg(coalesce(risk, 0)) AS m, max(coalesce(risk, 0)) AS x FROM n LEFT JOIN R USING (account) GROUP BY nodes)
SELECT array_to_string(nodes, '>') AS path, round(m, 4) AS mean_risk, round(x, 4) AS max_risk, round(m * 0.4 + x * 0.4 + least((len(nodes) - 1) / 10, 1) * 20, 4) AS rank FROM s""", AL, R, E)
def path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = walks.grown_chains(events_ledger(spark, sf_dir), 3600, 2, 21).select("nodes").distinct()
    return networks.path_ranks(chains, _risk(tables.alerts(spark, sf_dir)))


@query("p12_structuring_union", """
, b AS (SELECT src AS account, 'band' AS form, n, total, round(least(1.0, n / 10.0 * 0.5 + total / 500000.0 * 0.5), 6) AS score, CASE WHEN n >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM (SELECT src, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM L WHERE amount >= 50000 AND amount < 100000)) // 30 AS bin, count(*) AS n, round(sum(amount), 2) AS total FROM L WHERE amount >= 50000 AND amount < 100000 GROUP BY ALL) WHERE n >= 3),
s AS (SELECT src AS account, 'split' AS form, n, total, round(least(1.0, 0.3 + n / 10.0 * 0.4 + total / 100000.0 * 0.3), 6) AS score, 'HIGH' AS severity
  FROM (SELECT src, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(amount), 2) AS total FROM L GROUP BY ALL) WHERE n >= 2 AND total >= 50000 AND total < 100000)
SELECT account, form, n, total, score, severity FROM (SELECT * FROM b UNION ALL SELECT * FROM s) QUALIFY row_number() OVER (PARTITION BY account ORDER BY score DESC, form, total DESC, n DESC) = 1""", L)
def structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.structuring(orders_ledger(spark, sf_dir), 50_000, 100_000)


@query("g10_annotated_nodes", """
, n AS (SELECT 3 AS a UNION SELECT dst FROM E WHERE src = 3 UNION SELECT src FROM E WHERE dst = 3), g AS (SELECT * FROM E WHERE src IN (FROM n) AND dst IN (FROM n))
SELECT a AS account, coalesce(risk, 0) AS risk, a IN (FROM REP) AS prior_report, CASE WHEN a = 3 THEN 0 ELSE 1 END AS hops FROM n LEFT JOIN R ON R.account = a WHERE a IN (SELECT src FROM g UNION SELECT dst FROM g)""", AL, CA, R, REP, E)
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = networks.filtered_ego(events_ledger(spark, sf_dir), 3, 1)
    return networks.annotated(edges, 3, 1, _risk(tables.alerts(spark, sf_dir)), _reported(spark, sf_dir)).drop("role")


@query("g22_relationships_touching", "SELECT c_custkey AS entity_a, c_custkey + 7 AS entity_b FROM customer WHERE c_custkey % 11 = 0 OR (c_custkey + 7) % 11 = 0", A)
def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_a"), (F.col("c_custkey") + 7).alias("entity_b"))
    return networks.relationships_touching(own, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 11).alias("customer_id")))


@query("g21_same_tax_number", """
, c AS (SELECT c_custkey AS id, 'T' || c_custkey % 400 AS t FROM customer)
SELECT a.id AS entity_a, b.id AS entity_b, 0.95 AS confidence FROM c a JOIN c b ON a.t = b.t AND a.id < b.id""", A)
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("t"), F.col("c_custkey") % 400).alias("tax_id"))
    return networks.related_customers(who, b"key").select("entity_a", "entity_b", "confidence")


@query("g12_network_risk", """
, m AS (SELECT DISTINCT case_id, account FROM AL WHERE case_id IS NOT NULL AND case_id % 4 = 0), i AS (SELECT * FROM E WHERE src IN (SELECT account FROM m) OR dst IN (SELECT account FROM m)),
f AS (SELECT account, round(sum(CASE WHEN d = 'in' THEN amount ELSE 0 END), 2) AS x, round(sum(CASE WHEN d = 'out' THEN amount ELSE 0 END), 2) AS y, count(*) FILTER (d = 'in') AS ni, count(*) FILTER (d = 'out') AS no
  FROM (SELECT src AS account, 'out' AS d, amount FROM i UNION ALL SELECT dst, 'in', amount FROM i) GROUP BY account),
h AS (SELECT *, round(coalesce(x / nullif(x + y, 0), 0), 5) AS si, round(coalesce(y / nullif(x + y, 0), 0), 5) AS so FROM f),
q AS (SELECT *, (SELECT quantile_cont(si, 0.75) FROM h) AS pi, (SELECT quantile_cont(so, 0.75) FROM h) AS po, (SELECT quantile_cont(x, 0.75) FROM h) AS px, (SELECT quantile_cont(ni * no, 0.75) FROM h) AS pd FROM h),
r AS (SELECT account, CAST(x + y > 0 AND NOT (so > po AND si < 0.3) AND NOT (si > pi AND so < 0.3) AND si BETWEEN 0.3 AND 0.7 AND ni >= 2 AND no >= 2 AS INT) AS mule, CAST(x > px OR ni * no > pd AS INT) AS central FROM q),
p AS (SELECT case_id, coalesce(sum(mule), 0) AS mules, coalesce(sum(central), 0) AS central, count(*) FILTER (account % 13 = 0) AS sanctioned, count(*) FILTER (account % 5 = 0) AS exposed FROM m LEFT JOIN r USING (account) GROUP BY case_id)
SELECT case_id, CAST(mules AS BIGINT) AS mules, case_id % 3 AS reports, sanctioned, exposed, case_id % 2 AS cycles, CAST(central AS BIGINT) AS central,
       CAST(least(100, least(mules * 6, 40) + least(case_id % 3 * 12, 30) + least(sanctioned * 10 + exposed * 4, 20) + least(case_id % 2 * 8 + central * 3, 20)) AS DOUBLE) AS risk FROM p""", AL, E)
def network_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tables.alerts(spark, sf_dir).where("case_id IS NOT NULL AND case_id % 4 = 0").select("case_id", "account").distinct()
    ids = members.select("case_id").distinct()
    flags = accounts(spark, sf_dir).select("account", (F.col("account") % 13 == 0).alias("sanctioned"), (F.col("account") % 5 == 0).alias("exposed"))
    return networks.network_risk(members, events_ledger(spark, sf_dir), ids.select("case_id", (F.col("case_id") % 2).alias("n")), ids.select("case_id", (F.col("case_id") % 3).alias("n")), flags)
