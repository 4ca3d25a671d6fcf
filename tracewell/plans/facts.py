"""Registered queries of facts, functions, rules and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.investigation import facts
from tracewell.operators import rules
from tracewell.operators.graph import roles
from tracewell.plans.desk import AL, CA
from tracewell.plans.registry import BE, BL, A, E, L, query
from tracewell.sources import desk as tables
from tracewell.sources.ledgers import accounts, events_ledger, orders_ledger, table


@query("a5_bank_diversity", "SELECT account, count(*) AS banks, least(count(*), 50) / 50 AS dispersion FROM (SELECT DISTINCT account, direction, CASE direction WHEN 'out' THEN to_bank ELSE from_bank END AS k FROM B) GROUP BY account", L, BL)
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.bank_diversity(orders_ledger(spark, sf_dir))


@query("a9_flagged_channels", "SELECT channel, count(*) AS n, round(sum(amount), 2) AS total, count(DISTINCT src) AS senders FROM E WHERE src IN (SELECT account FROM AL WHERE risk >= 95) GROUP BY channel", AL, E)
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.flagged_channels(events_ledger(spark, sf_dir), tables.alerts(spark, sf_dir).where("risk >= 95"))


@query("a11_overview", """
, r AS (SELECT a AS account, coalesce(risk, 0) AS risk FROM (SELECT src AS a FROM E UNION SELECT dst FROM E) LEFT JOIN (SELECT account, max(risk) AS risk FROM AL GROUP BY account) ON account = a)
SELECT 'risk' AS what, CASE WHEN risk >= 76 THEN 'CRITICAL' WHEN risk >= 51 THEN 'HIGH' WHEN risk >= 26 THEN 'MEDIUM' ELSE 'LOW' END AS name, count(*) AS n FROM r GROUP BY ALL""", AL, E)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = tables.alerts(spark, sf_dir).groupBy("account").agg(F.max("risk").alias("risk"))
    return facts.overview(risk, roles(events_ledger(spark, sf_dir))).where("what = 'risk'")


@query("a13_monthly_errors", "SELECT account, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(amount), 2) AS total FROM B WHERE channel = 'error' GROUP BY ALL", E, BE)
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.monthly_where(events_ledger(spark, sf_dir), F.col("channel") == "error")


@query("a14_channel_map", "SELECT account, string_agg(channel || '=' || n, ',' ORDER BY channel) AS channels FROM (SELECT account, channel, count(*) AS n FROM B GROUP BY ALL) GROUP BY account", E, BE)
def channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.channel_map(events_ledger(spark, sf_dir))


@query("a16_exposure", "SELECT B.account, count(DISTINCT CASE direction WHEN 'out' THEN to_bank ELSE from_bank END) AS n_banks, count(DISTINCT city) AS n_cities FROM B LEFT JOIN A ON A.account = other WHERE B.account <> other GROUP BY B.account", L, BL, A)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.exposure(orders_ledger(spark, sf_dir), accounts(spark, sf_dir))


@query("a17_purposes", "SELECT coalesce(CASE WHEN txn_id % 3 <> 0 THEN channel END, 'unspecified') AS purpose, count(*) AS n FROM E GROUP BY ALL", E)
def purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.purposes(events_ledger(spark, sf_dir).withColumn("p", F.when(F.col("txn_id") % 3 != 0, F.col("channel"))), "p")


@query("a29_last_minutes", "SELECT count(*) AS n, round(sum(amount), 2) AS total FROM E WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 7200 SECONDS AND ts <= TIMESTAMP '2024-01-15 12:00:00'", E)
def last_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.last_seconds(events_ledger(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 7200)


@query("a30_evidence_counts", "SELECT kind, count(*) AS n, count(DISTINCT account) AS accounts FROM AL WHERE account % 4 = 1 GROUP BY kind", AL)
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.evidence_counts(tables.alerts(spark, sf_dir), accounts(spark, sf_dir).where("account % 4 = 1"))


@query("j19_evidence_rows", "SELECT txn_id, src, dst FROM E WHERE src % 40 = 1 OR dst % 40 = 1 ORDER BY ts DESC, txn_id DESC LIMIT 50", E)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    who = txn.select(F.explode(F.array("src", "dst")).alias("account")).where("account % 40 = 1")
    return facts.evidence_rows(txn, who).select("txn_id", "src", "dst")


@query("i3_customer_profile", """
, g AS (SELECT account, count(DISTINCT strftime(ts, '%Y-%m')) AS months, sum(CAST(round(amount * 100) AS BIGINT)) AS cents FROM B GROUP BY account),
m AS (SELECT account, months, ((2 * cents + months) // (2 * months)) / 100 AS m, declared_income / 12 + 10000 AS e, occupation, declared_income FROM A LEFT JOIN g USING (account))
SELECT account, occupation, declared_income, coalesce(months, 0) AS months, coalesce(m, 0) AS mean_monthly, CAST(round(CAST(e AS DECIMAL(28, 6)), 2) AS DOUBLE) AS expected, CAST(round(CAST(100 * (coalesce(m, 0) - e) / e AS DECIMAL(28, 6)), 2) AS DOUBLE) AS variance FROM m""", L, BL, A)
def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.customer_profile(orders_ledger(spark, sf_dir), accounts(spark, sf_dir), F.col("declared_income") / 12 + 10_000)


@query("i2_case_transfers", ", m AS (SELECT DISTINCT case_id, account FROM AL WHERE case_id IS NOT NULL) SELECT DISTINCT case_id, txn_id FROM E JOIN m ON src = account OR dst = account", AL, E)
def case_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tables.alerts(spark, sf_dir).where("case_id IS NOT NULL").select("case_id", "account").distinct()
    return facts.case_transfers(events_ledger(spark, sf_dir), members)


@query("p14_mismatches", """
, v AS (SELECT account, round(round(sum(CASE direction WHEN 'in' THEN amount ELSE 0 END), 2) + round(sum(CASE direction WHEN 'out' THEN amount ELSE 0 END), 2), 2) AS volume FROM B GROUP BY account)
SELECT account, volume, round(volume / declared_income, 4) AS ratio FROM v JOIN A USING (account) WHERE declared_income > 0 AND round(volume / declared_income, 4) > 3 ORDER BY ratio DESC, account LIMIT 100""", L, BL, A)
def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.mismatches(orders_ledger(spark, sf_dir), accounts(spark, sf_dir))


@query("p15_pattern_edges", "SELECT txn_id, src, dst FROM E WHERE src IN (SELECT account FROM AL WHERE kind = 'layering' AND risk >= 70) AND dst IN (SELECT account FROM AL WHERE kind = 'layering' AND risk >= 70)", AL, E)
def pattern_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.pattern_edges(events_ledger(spark, sf_dir), tables.alerts(spark, sf_dir).where("risk >= 70"), "layering").select("txn_id", "src", "dst")


@query("p15_signal_digest", "SELECT account, count(DISTINCT kind) AS n_kinds, count(*) AS n, count(DISTINCT kind) >= 2 AS several FROM AL GROUP BY account", AL)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.signal_digest(tables.alerts(spark, sf_dir))


@query("p13_first_or_fallback", """
, r AS (SELECT account, txn_id, ts, avg(amount) OVER w AS m, stddev_pop(amount) OVER w AS s, count(*) OVER w AS n, amount FROM B WINDOW w AS (PARTITION BY account)),
f AS (SELECT account, txn_id FROM r WHERE n >= 3 AND s > 0 AND abs((amount - m) / s) > 6 QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts, txn_id) = 1)
SELECT * FROM f UNION ALL SELECT account, txn_id FROM r WHERE account % 2 = 0 AND account NOT IN (SELECT account FROM f) QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts, txn_id) = 1""", E, BE)
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators import detectors

    txn = events_ledger(spark, sf_dir)
    flagged = txn.select(F.explode(F.array("src", "dst")).alias("account")).where("account % 2 = 0")
    return detectors.first_outlier(txn, 6.0, flagged=flagged).select("account", "txn_id")


@query("s29_upload_summary", """
SELECT 'hour' AS section, CAST(hour(ts) AS VARCHAR) AS name, count(*) AS n, round(sum(amount), 2) AS total FROM E GROUP BY ALL UNION ALL SELECT 'channel', channel, count(*), round(sum(amount), 2) FROM E GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'account', CAST(account AS VARCHAR) AS name, count(*), round(sum(amount), 2) AS total FROM B GROUP BY ALL ORDER BY total DESC, name LIMIT 5)""", E, BE)
def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.upload_summary(events_ledger(spark, sf_dir))


@query("s30_health", """
, m AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS value, 1.0::DOUBLE AS low, NULL::DOUBLE AS high FROM E UNION ALL SELECT 'self_transfers', count(*) FILTER (src = dst), NULL, 10 FROM E)
SELECT metric, value, value >= coalesce(low, value) AND value <= coalesce(high, value) AS healthy FROM m""", E)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.sources import ingest

    one = events_ledger(spark, sf_dir).agg(F.count("*").alias("n"), F.sum((F.col("src") == F.col("dst")).cast("int")).alias("s"))
    none = F.lit(None).cast("double")
    row = lambda name, v, low, high: F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"), low.alias("low"), high.alias("high"))
    rows = one.select(F.explode(F.array(row("rows", F.col("n"), F.lit(1.0), none), row("self_transfers", F.col("s"), none, F.lit(10.0)))).alias("m")).select("m.*")
    return ingest.health(rows)


@query("ai1_account_facts", """
, f AS (SELECT account, round(sum(CASE direction WHEN 'in' THEN amount ELSE 0 END), 2) AS inflow, round(sum(CASE direction WHEN 'out' THEN amount ELSE 0 END), 2) AS outflow, count(*) AS n, count(DISTINCT other) FILTER (other <> account) AS partners FROM B GROUP BY account),
r AS (SELECT account, max(risk) AS risk FROM AL GROUP BY account)
SELECT f.*, round(coalesce(risk, 0), 2) AS risk, city, declared_income FROM f LEFT JOIN r USING (account) LEFT JOIN A USING (account)""", AL, E, BE, A)
def account_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    risk = tables.alerts(spark, sf_dir).groupBy("account").agg(F.max("risk").alias("risk"))
    return facts.account_facts(txn, accounts(spark, sf_dir), roles(txn), risk).drop("role")


@query("ai4_grounding", """
, f AS (SELECT event_id, user_id, round(value, 2) AS v FROM events)
SELECT event_id AS claim_id, event_id % 6 NOT IN (0, 1, 2, 3) AS accepted,
       CASE event_id % 6 WHEN 0 THEN 'cites no facts' WHEN 1 THEN 'unknown fact x' || event_id WHEN 2 THEN 'misreported f' || event_id WHEN 3 THEN 'states an ungrounded number' ELSE '' END AS reason FROM f""", E)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of six forms about each event: without facts, about an unknown one, misreporting, with a number of its own, and two sound ones."""
    e = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value"), 2).cast("string").alias("v"))
    i, key = F.col("event_id") % 6, F.concat(F.lit("f"), "event_id")
    cite = lambda k, v: F.array(F.struct(k.alias("fact_key"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<fact_key:string,value:string>>)")
    cites = F.when(i == 0, none).when(i == 1, cite(F.concat(F.lit("x"), "event_id"), F.col("v"))).when(i == 2, cite(key, F.concat(F.lit("9"), "v"))).otherwise(cite(key, F.col("v")))
    text = F.when(i == 3, "It moved Rs.999999999 on 2024-01-02 10:11:12.").otherwise(F.concat(F.lit("In March 2026 at 12:30 it moved ₹"), "v", F.lit(" by A1-77.")))
    return facts.grounding(e.select(F.col("event_id").alias("claim_id"), text.alias("statement"), cites.alias("citations")), e.select(key.alias("fact_key"), F.col("v").alias("value")))


@query("ai5_egress_leaks", r"""
WITH n AS (SELECT count(*) AS k FROM customer),
t AS (SELECT conv_id * 1000 + turn AS text_id, conv_id % k AS owner, coalesce(text, '') || ' for ' || lower(c_mktsegment) || ', no ' || CAST((conv_id * 31 + turn) % 1000003 * 104729000033 % (CASE WHEN turn % 2 = 0 THEN 10000000000 ELSE 1000000000000 END) AS VARCHAR) || '.' AS text
      FROM conversations, n JOIN customer ON c_custkey = (conv_id * 7 + turn) % k),
v AS (SELECT c_custkey AS owner, 'segment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'place', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'balance', CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) FROM customer),
l AS (SELECT text_id, name FROM t JOIN v USING (owner) WHERE length(value) >= 3 AND contains(lower(text), lower(value))
      UNION SELECT text_id, 'pan' FROM t WHERE regexp_matches(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b') UNION SELECT text_id, 'aadhaar' FROM t WHERE regexp_matches(text, '\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b')
      UNION SELECT text_id, 'mobile' FROM t WHERE regexp_matches(text, '(^|[^0-9])(\+91[\s-]?)?[6-9][0-9]{9}([^0-9]|$)'))
SELECT text_id, string_agg(DISTINCT name, ',' ORDER BY name) AS leaks FROM l GROUP BY text_id""")
def egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations of all customers, each turn with some customer's segment and a number: segments and balances of their owners leak, nations' numbers are too short."""
    who = table(spark, sf_dir, "customer")
    turns = table(spark, sf_dir, "conversations").join(F.broadcast(who.agg(F.count("*").alias("k"))))
    digits = F.when(F.col("turn") % 2 == 0, 10**10).otherwise(10**12)  # of ten digits some are a mobile's, of twelve some are another's
    number = ((F.col("conv_id") * 31 + F.col("turn")) % 1_000_003 * 104_729_000_033 % digits).cast("string")
    named = turns.withColumn("c_custkey", (F.col("conv_id") * 7 + F.col("turn")) % F.col("k")).join(who.select("c_custkey", "c_mktsegment"), "c_custkey")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" for "), F.lower("c_mktsegment"), F.lit(", no "), number, F.lit("."))
    texts = named.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), (F.col("conv_id") % F.col("k")).alias("owner"), text.alias("text"))
    values = F.explode(F.array(*(
        F.struct(F.lit(name).alias("name"), value.alias("value"))
        for name, value in (("segment", F.col("c_mktsegment")), ("place", F.col("c_nationkey").cast("string")), ("balance", F.floor(F.abs("c_acctbal")).cast("string")))
    )))
    return facts.egress_leaks(texts, who.select(F.col("c_custkey").alias("owner"), values.alias("v")).select("owner", "v.name", "v.value"))


@query("ai6_rehydrated", """
SELECT c_custkey AS account, c_mktsegment || ' of ' || coalesce(a.n_name, 'N' || c_nationkey) || ' to ' || b.n_name || 'x, N' AS text
FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 25""")
def rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nation and another one as placeholders N0 to N24, of which N1 and N2 begin others."""
    names = {f"N{r.n_nationkey}": r.n_name for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()}  # the nations
    text = F.concat("c_mktsegment", F.lit(" of N"), "c_nationkey", F.lit(" to N"), F.col("c_custkey") % 25, F.lit("x, N"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), facts.rehydrated(text, names).alias("text"))


_ACTIONS = " UNION ALL ".join(f"SELECT '{a}' AS action, {repr(k) if k else 'NULL'} AS for_kind" for a, kinds in facts.ACTIONS.items() for k in kinds or [None])


@query("ai8_eligible_actions", f"""
, t AS ({_ACTIONS}), f AS (SELECT DISTINCT account, kind FROM AL WHERE risk >= 50)
SELECT account, action, string_agg(DISTINCT kind, ',' ORDER BY kind) AS because FROM f JOIN t ON for_kind IS NULL OR for_kind = kind GROUP BY ALL""", AL)
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.eligible_actions(tables.alerts(spark, sf_dir).where("risk >= 50"))


@query("fn_entropy", "SELECT user_id, round(entropy(event_type), 6) AS entropy FROM events GROUP BY user_id")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars.shannon_entropy(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.round("entropy", 6).alias("entropy"))


@query("fn_gini", """
, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(2 * sum(i * value) / (max(n) * sum(value)) - (max(n) + 1) / max(n), 6) AS gini FROM r GROUP BY user_id""", E)
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars.gini(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("gini", 6).alias("gini"))


@query("fn_rupees", """
WITH a AS (SELECT event_id, CAST(value AS DECIMAL(18, 4)) * 100000 AS x FROM events), u AS (SELECT *, CASE WHEN x >= 10000000 THEN 7 WHEN x >= 100000 THEN 5 WHEN x >= 1000 THEN 3 ELSE 0 END AS z FROM a),
h AS (SELECT event_id, z, (CAST(x * 10000 AS HUGEINT) * 2 + CAST(pow(10, z + 2) AS HUGEINT)) // (CAST(pow(10, z + 2) AS HUGEINT) * 2) AS hundredths FROM u)
SELECT event_id, '₹' || (hundredths // 100) || '.' || lpad(CAST(hundredths % 100 AS VARCHAR), 2, '0') || CASE z WHEN 7 THEN 'Cr' WHEN 5 THEN 'L' WHEN 3 THEN 'K' ELSE '' END AS text FROM h""")
def rupees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.rupees(F.col("value").cast("decimal(18,4)") * 100_000).alias("text"))


@query("fn_shapes", r"""
WITH d AS (SELECT c_custkey, translate(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ') AS letters, lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR), 4, '0') AS four,
                  CAST(c_custkey * 104729 % 10000000000 AS VARCHAR) AS digits, CAST(c_acctbal AS VARCHAR) AS money, c_mktsegment FROM customer),
t AS (SELECT c_custkey, 'tax ' || letters || four || substr(c_mktsegment, 1, 1) || ' no ' || four || ' ' || four || ' ' || four || ', call ' || digits || ' or +91 ' || lpad(digits, 10, '9') || substr(money, 1, 1) AS text FROM d)
SELECT c_custkey, concat_ws(',', CASE WHEN regexp_matches(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b') THEN 'pan' END, CASE WHEN regexp_matches(text, '\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b') THEN 'aadhaar' END,
       CASE WHEN regexp_matches(text, '(^|[^0-9])(\+91[\s-]?)?[6-9][0-9]{9}([^0-9]|$)') THEN 'mobile' END) AS shapes FROM t""")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of each customer's own numbers, some of which have a shape and some only nearly."""
    key = F.col("c_custkey")
    four = F.lpad((key * 7919 % 10000).cast("string"), 4, "0")
    digits = (key * 104729 % 10000000000).cast("string")
    letters = F.translate(F.lpad(key.cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ")
    text = F.concat(
        F.lit("tax "), letters, four, F.substring("c_mktsegment", 1, 1), F.lit(" no "), four, F.lit(" "), four, F.lit(" "), four,
        F.lit(", call "), digits, F.lit(" or +91 "), F.lpad(digits, 10, "9"), F.substring(F.col("c_acctbal").cast("string"), 1, 1),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.shapes_in(text).alias("shapes"))


_BAND = "SELECT src, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM L WHERE amount >= 50000 AND amount < 100000)) // 30 AS b, count(*) AS n, sum(amount) AS total FROM L WHERE amount >= 50000 AND amount < 100000 GROUP BY ALL HAVING count(*) >= 3"


@query("r3_composite_rule", f"""
, p AS (SELECT src AS account, least(1.0, n / 10.0 * 0.5 + total / 500000.0 * 0.5) AS score, CASE WHEN n >= 5 THEN 4 ELSE 3 END AS s FROM ({_BAND})),
v AS (SELECT account, round(sum(amount), 2) AS volume FROM B GROUP BY account),
i AS (SELECT account, least(1.0, least(volume / greatest(declared_income, 1.0) / 100, 0.5) + 0.3 + least(volume / 1e7, 0.2)) AS score, CASE WHEN volume / greatest(declared_income, 1.0) > 50 THEN 4 WHEN volume / greatest(declared_income, 1.0) > 20 THEN 3 ELSE 2 END AS s
      FROM v JOIN A USING (account) WHERE declared_income > 0 AND volume / greatest(declared_income, 1.0) > 100),
u AS (SELECT * FROM p UNION ALL SELECT * FROM i)
SELECT CAST(account AS VARCHAR) AS account, round(max(score), 3) AS score, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(s)] AS severity FROM u WHERE account IN (SELECT account FROM p) AND account IN (SELECT account FROM i) GROUP BY account""", L, BL, A)
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"rule_id": "r", "detection_type": "structuring", "severity": "LOW", "combinator": "AND", "conditions": [
        {"primitive": "amount_band_count", "params": {"lower": 50_000.0, "upper": 100_000.0}}, {"primitive": "volume_vs_declared_income_ratio", "params": {"ratio_threshold": 100.0}},
    ]}
    found = rules.evaluate(rule, orders_ledger(spark, sf_dir), accounts(spark, sf_dir))
    return found.select(F.col("account_ids")[0].alias("account"), "score", "severity")


@query("r4_rules_run", f"""
SELECT 'band' AS rule_id, CAST(src AS VARCHAR) AS account, round(least(1.0, n / 10.0 * 0.5 + total / 500000.0 * 0.5), 3) AS score FROM ({_BAND})
UNION ALL SELECT 'most', CAST(dst AS VARCHAR), round(least(1.0, 0.5 + least(abs(m - 104000) / 104000, 0.5)), 3) FROM (SELECT dst, round(max(amount), 4) AS m FROM L WHERE ts >= (SELECT max(ts) FROM L) - INTERVAL 200 DAYS GROUP BY dst) WHERE m > 104000""", L)
def rules_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules, one of which can't be planned and doesn't stop the others."""
    run = [
        {"rule_id": "band", "detection_type": "structuring", "conditions": [{"primitive": "amount_band_count", "params": {"lower": 50_000.0, "upper": 100_000.0}}]},
        {"rule_id": "bad", "detection_type": "x", "conditions": [{"primitive": "generic_group_aggregate", "params": {"field": "no_such_column"}}]},
        {"rule_id": "most", "detection_type": "custom", "conditions": [{"primitive": "generic_group_aggregate", "params": {"group_by": "dest_account", "agg": "MAX", "window_days": 200, "value": 104_000.0}}]},
    ]
    found, errors = rules.run_all(run, orders_ledger(spark, sf_dir), accounts(spark, sf_dir))
    assert set(errors) == {"bad"}, errors
    return found.select("rule_id", F.explode("account_ids").alias("account"), "score")


@query("i14_governance", """
, k AS (SELECT *, ['structuring', 'layering', 'dormancy'][case_id % 3 + 1] AS kind FROM CA), v AS (SELECT kind, count(*) FILTER (resolution = 'TRUE_POSITIVE_SAR') AS tp, count(*) FILTER (resolution = 'FALSE_POSITIVE') AS fp FROM k WHERE resolution IS NOT NULL GROUP BY kind),
r AS (SELECT * FROM (VALUES ('r1', 'structuring', 0.7), ('r2', 'layering', 0.5), ('r3', 'fan_out', 0.4)) t(rule, kind, confidence))
SELECT rule, CAST(confidence AS DOUBLE) AS confidence, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision FROM r LEFT JOIN v USING (kind)""", AL, CA)
def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("structuring"), F.lit("layering"), F.lit("dormancy")), (F.col("case_id") % 3).cast("int"))
    known = spark.createDataFrame([("r1", "structuring", 0.7), ("r2", "layering", 0.5), ("r3", "fan_out", 0.4)], "rule string, kind string, confidence double")
    return facts.governance(tables.cases(spark, sf_dir).withColumn("kind", kind), known)
