"""Registered queries of ingestion, contracts and the light detectors, over raw rows projected from the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.registry import A, E, L, query
from tracewell.session import shared_folder
from tracewell.sources import daily, ingest
from tracewell.sources.ledgers import accounts, events_ledger, orders_ledger, table
from tracewell.streaming import light

FORMATS = ["Wire", "ACH", "Cheque", "Cash", "Credit Card", "Bitcoin", "Reinvestment", "Barter"]
CURRENCIES = ["US Dollar", "Euro", "UK Pound", "Yen", "Indian Rupee", "Cowrie", " ", "Bitcoin"]
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_CASE = lambda values, key, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"
RAW = f"""RAW AS (
  SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN strftime(ts, '%Y/%m/%d %H:%M') END AS ts, 'b' || user_id % 9 AS from_bank, 'c' || user_id AS src, 'b' || event_id % 9 AS to_bank, 'c' || (user_id * 3 + event_id) % 50 AS dst,
         CAST(value AS VARCHAR) AS amount_received, {_LIST(CURRENCIES)}[event_id % 8 + 1] AS receiving_currency, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS amount_paid,
         {_LIST(CURRENCIES)}[event_id % 8 + 1] AS payment_currency, {_LIST(FORMATS)}[user_id % 8 + 1] AS payment_format, CAST(event_id % 2 AS VARCHAR) AS is_laundering FROM events)"""


def _raw(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    i, u, text = F.col("event_id"), F.col("user_id"), F.col("value").cast("string")
    return e.select(
        *keep, F.when(i % 10 != 9, F.date_format("ts", "yyyy/MM/dd HH:mm")).alias("ts"), F.concat(F.lit("b"), u % 9).alias("from_bank"), F.concat(F.lit("c"), u).alias("src"),
        F.concat(F.lit("b"), i % 9).alias("to_bank"), F.concat(F.lit("c"), (u * 3 + i) % 50).alias("dst"), text.alias("amount_received"), pick(CURRENCIES, i % 8).alias("receiving_currency"),
        F.when(i % 17 == 0, "n/a").otherwise(text).alias("amount_paid"), pick(CURRENCIES, i % 8).alias("payment_currency"), pick(FORMATS, u % 8).alias("payment_format"), (i % 2).cast("string").alias("is_laundering"),
    )


@query("s9_currency_codes", f"SELECT event_id, CASE WHEN trim(payment_currency) = '' THEN 'INR' ELSE {_CASE(ingest.CODE_OF_CURRENCY, 'trim(payment_currency)', 'trim(payment_currency)')} END AS code, {_CASE({'Wire': 'RTGS', 'ACH': 'NEFT', 'Cheque': 'cheque', 'Cash': 'branch_cash'}, 'payment_format', repr('unknown'))} AS channel FROM RAW", RAW)
def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, ("event_id",)).select("event_id", ingest.currency_code(F.col("payment_currency")).alias("code"), ingest.channel_of(F.col("payment_format")).alias("channel"))


@query("s10_entity_type", """
WITH n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN '  ' || replace(c_name, 'Customer', 'Individual ') ELSE c_name END AS name FROM customer
           UNION ALL SELECT -1 - s_suppkey, s_name || ' of Individual' FROM supplier)
SELECT id, CASE WHEN name IS NOT NULL AND starts_with(trim(name), 'Individual') THEN 'INDIVIDUAL' ELSE 'BUSINESS' END AS kind FROM n""")
def entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, households among them as individuals behind blanks, those in debt without a name, and suppliers with the word at the end."""
    mine = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("  "), F.replace("c_name", F.lit("Customer"), F.lit("Individual ")))).otherwise(F.col("c_name"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), mine.alias("name"))
    names = names.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.concat("s_name", F.lit(" of Individual")).alias("name")))
    return names.select("id", ingest.entity_type(F.col("name")).alias("kind"))


@query("s13_bank_ledger", f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY ts IS NULL ORDER BY from_bank, src, to_bank, dst, amount_received, receiving_currency, amount_paid, payment_currency, payment_format, is_laundering) - 1 AS nth FROM RAW)
SELECT src, dst, round(coalesce(TRY_CAST(amount_paid AS DOUBLE), 0) * {_CASE(ingest.RUPEES_PER, 'payment_currency', '83.0')}, 2) AS amount,
       CASE WHEN ts IS NULL THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(nth) ELSE strptime(ts, '%Y/%m/%d %H:%M') END AS ts, {_CASE(ingest.BANK_CHANNELS, 'payment_format', repr('net_banking'))} AS channel, CAST(is_laundering AS INT) AS is_laundering FROM k""", RAW)
def bank_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_bank(_raw(spark, sf_dir)).select("src", "dst", "amount", F.col("ts").cast("timestamp_ntz").alias("ts"), "channel", "is_laundering")


@query("s14_wallet_ledger", "SELECT 'c' || user_id AS src, 'm' || event_id % 40 AS dst, value AS amount, TIMESTAMP '2024-01-01 00:00:00' + to_hours(event_id % 700) AS ts, CASE event_type WHEN 'click' THEN 'branch_cash' WHEN 'view' THEN 'UPI' ELSE 'net_banking' END AS channel, CAST(event_id % 2 AS INT) AS is_laundering FROM events")
def wallet_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "CASH_IN").when(F.col("event_type") == "view", "PAYMENT").otherwise("OTHER")
    raw = table(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("step"), kind.alias("type"), F.col("value").alias("amount"), F.concat(F.lit("c"), "user_id").alias("nameOrig"), F.concat(F.lit("m"), F.col("event_id") % 40).alias("nameDest"), (F.col("event_id") % 2).alias("isFraud"))
    return ingest.parse_wallet(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s15_generic_ledger", "SELECT 'c' || user_id AS src, 'm' || event_id % 40 AS dst, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS amount, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS ts, event_type AS channel, 0 AS is_laundering FROM events")
def generic_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), "user_id").alias("Sender Name"), F.concat(F.lit("m"), i % 40).alias("Beneficiary"), F.when(i % 9 == 0, "many").otherwise(F.col("value").cast("string")).alias("Sum"),
        F.when(i % 11 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Date of it"), F.col("event_type").alias("Method"),
    )
    return ingest.parse_generic(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s16_account_profiles", """
, b AS (SELECT src AS account, amount AS o, 0 AS i FROM L UNION ALL SELECT dst, 0, amount FROM L), f AS (SELECT account, round(sum(i), 2) AS inflow, round(sum(o), 2) AS outflow, count(*) AS n FROM b GROUP BY account)
SELECT account, inflow, outflow, n, CASE WHEN inflow + outflow > 5000000 THEN 'very_high' WHEN inflow + outflow > 1500000 THEN 'high' WHEN inflow + outflow > 500000 THEN 'medium' ELSE 'low' END AS income_bracket FROM f""", L)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.account_profiles(orders_ledger(spark, sf_dir))


@query("s18_synthetic_profiles", f"""
, h AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer),
r AS (SELECT c_custkey, {_LIST(ingest.INCOME_OF)}[CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(m, ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS HUGEINT))), lambda a, b: (a * 16 + b) % 7) AS INT) + 1] AS occupation, m FROM h),
q AS (SELECT *, {_CASE({k: v[0] for k, v in ingest.INCOME_OF.items()}, 'occupation', '0')} AS lo, {_CASE({k: v[1] - v[0] for k, v in ingest.INCOME_OF.items()}, 'occupation', '1')} AS w FROM r)
SELECT c_custkey AS account, occupation, CAST(lo + list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(m, ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS HUGEINT))), lambda a, b: (a * 16 + b) % w) AS DOUBLE) AS income FROM q""", A)
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupation, income = ingest.synthetic_profile(F.col("account"))
    return accounts(spark, sf_dir).select("account", occupation.alias("occupation"), income.alias("income"))


@query("s3_unseen_files", """
, f AS (SELECT 'file-' || event_id AS path, sha256(event_type || CAST(CAST(round(value) AS BIGINT) AS VARCHAR)) AS h, user_id FROM events),
m AS (SELECT h FROM f WHERE user_id % 4 = 0)
SELECT min(path) AS path, h AS sha256 FROM f WHERE h NOT IN (FROM m) GROUP BY h""", E)
def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are all events, with their kind and whole value as content; every fourth user's were loaded, the next one's failed."""
    content = F.sha2(F.concat("event_type", F.round("value").cast("long").cast("string")), 256)
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("file-"), "event_id").alias("path"), content.alias("sha256"), "user_id")
    loads = files.where("user_id % 4 IN (0, 1)").select("sha256", F.when(F.col("user_id") % 4 == 0, "SUCCESS").otherwise("FAILED").alias("status"))
    return ingest.unseen(files.drop("user_id"), loads)


@query("s20_daily_loads", """
, p AS (SELECT *, (src + txn_id) % 3 AS part FROM E)
SELECT '2024-01-0' || (part + 1) AS day, channel, count(*) AS n, count(DISTINCT src) AS senders, round(sum(amount), 2) AS total, (SELECT count(*) FROM (SELECT src FROM E UNION SELECT dst FROM E)) AS accounts FROM p GROUP BY ALL""", E)
def daily_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in three files, each loaded as of a day and one of them twice."""
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    store, txn = daily.DailyStore(spark, f"{folder}/store"), events_ledger(spark, sf_dir)
    for part in (0, 1, 2, 1):
        path = f"{folder}/part-{part}"
        txn.where((F.col("src") + F.col("txn_id")) % 3 == part).write.mode("overwrite").option("header", True).csv(path)
        store.load(path, dt.date(2024, 1, 1 + part))
    accounts = F.broadcast(store.accounts().agg(F.count("*").alias("accounts")))
    rows = store.ledger().groupBy(F.col("day").cast("string").alias("day"), "channel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"), F.round(F.sum("amount"), 2).alias("total"))
    return rows.join(accounts)


@query("s5_first_wins", "SELECT user_id, event_type, value FROM events WHERE user_id % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ingest.first_wins(e, "user_id", "event_id", e.where("user_id % 6 = 0").select("user_id").distinct()).select("user_id", "event_type", "value")


@query("s6_minted_accounts", "SELECT DISTINCT a AS account FROM (SELECT src AS a FROM E UNION ALL SELECT dst FROM E) WHERE a NOT IN (SELECT account FROM A WHERE account % 3 = 0)", E, A)
def minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.minted_accounts(events_ledger(spark, sf_dir), accounts(spark, sf_dir).where("account % 3 = 0"))


@query("s7_enriched_customers", """
, f AS (SELECT user_id, event_type, value FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT account AS customer_id, coalesce(CASE WHEN account % 2 = 0 THEN occupation END, event_type) AS occupation, value AS declared_income FROM A LEFT JOIN f ON f.user_id = account""", A)
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = accounts(spark, sf_dir).select(F.col("account").alias("customer_id"), F.when(F.col("account") % 2 == 0, F.col("occupation")).alias("occupation"), F.lit(None).cast("double").alias("declared_income"))
    keep = F.col("event_id") % 3 == 0
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("event_id").alias("pos"), F.when(keep, F.col("event_type")).alias("occupation"), F.when(keep, F.col("value")).alias("declared_income"))
    return ingest.enriched(who, rows)


@query("s22_upserted", """
, o AS (SELECT account, CASE WHEN account % 4 <> 0 THEN occupation ELSE '' END AS occupation, 1.0 AS risk FROM A WHERE account % 2 = 0), n AS (SELECT account, 'new' AS occupation, 2.0 AS risk FROM A WHERE account % 3 = 0)
SELECT coalesce(o.account, n.account) AS account, coalesce(nullif(o.occupation, ''), n.occupation, o.occupation) AS occupation, coalesce(n.risk, o.risk)::DOUBLE AS risk FROM o FULL JOIN n ON o.account = n.account""", A)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = accounts(spark, sf_dir)
    old = who.where("account % 2 = 0").select("account", F.when(F.col("account") % 4 != 0, F.col("occupation")).otherwise("").alias("occupation"), F.lit(1.0).alias("risk"))
    new = who.where("account % 3 = 0").select("account", F.lit("new").alias("occupation"), F.lit(2.0).alias("risk"))
    return ingest.upserted(old, new, "account", ["risk"])


@query("s25_without_prefix", "SELECT txn_id FROM L WHERE NOT starts_with(txn_id, '1')", L)
def without_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.without_prefix(orders_ledger(spark, sf_dir).select("txn_id"), "txn_id", "1")


@query("s26_violations", """
, c AS (SELECT count(*) AS n, [('null_source', 'error', 0), ('null_target', 'error', 0), ('null_amount', 'error', count(*) FILTER (amount IS NULL)), ('unreadable_time', 'error', 0), ('not_positive', 'error', count(*) FILTER (amount <= 0)),
        ('extreme_amount', 'error', count(*) FILTER (amount > 1e12)), ('self_transfer', 'warning', count(*) FILTER (src = dst))] AS x FROM E),
u AS (SELECT n, unnest(x) AS t FROM c)
SELECT t[1] AS "check", t[2] AS level, CAST(t[3] AS BIGINT) AS n, round(t[3] / n, 6) AS share FROM u""", E)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.violations(events_ledger(spark, sf_dir), ingest.ledger_checks())


@query("s27_repeated_keys", "SELECT 'repeated' AS \"check\", CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'missing', count(*) FILTER (l_orderkey IS NULL) FROM lineitem")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.repeated_keys(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query("s27_label_contract", "SELECT count(*) AS rows, round(avg(toxic), 6) AS rate, round(avg(toxic), 6) BETWEEN 0.0005 AND 0.5 AS passed FROM labels")
def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.label_contract(table(spark, sf_dir, "labels"), "toxic")


@query("s27_column_contract", """
SELECT 'l_quantity' AS "column", 0.0::DOUBLE AS missing_share, 0 AS infinite, min(l_quantity) = max(l_quantity) AS constant, count(*) FILTER (l_quantity < 2 OR l_quantity > 40) AS outside FROM lineitem
UNION ALL SELECT 'l_discount', 0.0, 0, min(l_discount) = max(l_discount), count(*) FILTER (l_discount < 2 OR l_discount > 40) FROM lineitem""")
def column_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.column_contract(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 2, 40)


def _light(pattern: str, rows: str, risk: str, level: str) -> str:
    return f"""
, r AS ({rows})
SELECT 'ALT-' || upper(substr(sha256(concat_ws('-', account, '{pattern}', '2024-01-31')), 1, 12)) AS alert_id, account, '{pattern}' AS pattern, round({risk}, 1)::DOUBLE AS risk, {level} AS level FROM r"""


DAY = "2024-01-31"


@query("t5_light_structuring", _light("structuring", "SELECT src AS account, count(*) AS n FROM E WHERE amount >= 90 AND amount < 100 GROUP BY src HAVING count(*) >= 3", "least(85.0, 50.0 + n * 5)", "CASE WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END"), E)
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.structuring(events_ledger(spark, sf_dir), DAY, 90, 100)


@query("t6_light_velocity", _light("velocity_spike", "SELECT src AS account, count(*) AS n FROM E GROUP BY src HAVING count(*) >= 20 AND count(*) / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000, 1) >= 0.1", "least(90.0, 40.0 + n * 2)", "CASE WHEN n >= 50 THEN 'HIGH' ELSE 'MEDIUM' END"), E)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.velocity_spike(events_ledger(spark, sf_dir), DAY, 20, 0.1)


@query("t7_light_reciprocal", _light("round_trip", "SELECT DISTINCT a.src AS account FROM (SELECT src, dst, min(epoch_us(ts)) AS t FROM E GROUP BY ALL) a JOIN (SELECT src, dst, min(epoch_us(ts)) AS t FROM E GROUP BY ALL) b ON a.src = b.dst AND a.dst = b.src WHERE abs(a.t - b.t) <= 172800000000", "70.0", "'HIGH'"), E)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.reciprocal(events_ledger(spark, sf_dir), DAY)


@query("t7_light_loops", _light("round_trip", """
SELECT account, max(l / f) AS q, max(n) AS n FROM (
  SELECT a.src AS account, 2 AS n, a.x AS f, b.x AS l, abs(b.t - a.t) AS span FROM e1 a JOIN e1 b ON a.dst = b.src AND b.dst = a.src WHERE (a.t, a.src) < (b.t, b.src)
  UNION ALL SELECT a.src, 3, a.x, c.x, greatest(a.t, b.t, c.t) - least(a.t, b.t, c.t) FROM e1 a JOIN e1 b ON a.dst = b.src JOIN e1 c ON b.dst = c.src AND c.dst = a.src
  WHERE b.dst <> a.src AND abs(b.t - a.t) <= 14400000000 AND (a.t, a.src) < (b.t, b.src) AND (a.t, a.src) < (c.t, c.src))
WHERE f > 0 AND span <= 14400000000 AND l / f >= 0.85 GROUP BY account""", "least(95.0, 70.0 + q * 20)", "CASE WHEN n >= 3 THEN 'CRITICAL' ELSE 'HIGH' END").replace(", r AS", ", e1 AS (SELECT src, dst, min(epoch_us(ts)) AS t, arg_min(amount, (epoch_us(ts), amount)) AS x FROM E WHERE src <> dst GROUP BY ALL), r AS", 1), E)
def t7_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.tight_loops(events_ledger(spark, sf_dir), DAY, 4)


@query("t8_light_fan_out", _light("fan_out", "SELECT src AS account, count(DISTINCT dst) AS n FROM E GROUP BY src HAVING count(DISTINCT dst) >= 10", "least(80.0, 45.0 + n * 3)", "CASE WHEN n >= 20 THEN 'HIGH' ELSE 'MEDIUM' END"), E)
def t8_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.fan(events_ledger(spark, sf_dir), DAY, "out", 10)


@query("t8_light_fan_in", _light("fan_in", "SELECT dst AS account, count(DISTINCT src) AS n FROM E GROUP BY dst HAVING count(DISTINCT src) >= 3", "least(85.0, 50.0 + n * 5)", "CASE WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END"), E)
def t8_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.fan(events_ledger(spark, sf_dir), DAY, "in", 3)


@query("t9_light_income", _light("profile_mismatch", "SELECT dst AS account, sum(amount) / declared_income AS q FROM L JOIN A ON A.account = dst WHERE declared_income > 0 GROUP BY dst, declared_income HAVING sum(amount) / declared_income > 10", "least(95.0, 55.0 + least(q, 40.0))", "CASE WHEN q > 50 THEN 'CRITICAL' WHEN q > 20 THEN 'HIGH' ELSE 'MEDIUM' END"), L, A)
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.income(orders_ledger(spark, sf_dir), accounts(spark, sf_dir), DAY)


@query("t10_light_pass_through", _light("mule_suspect", "SELECT account, o / i AS q FROM (SELECT account, sum(i) AS i, sum(o) AS o FROM (SELECT dst AS account, amount AS i, 0 AS o FROM L UNION ALL SELECT src, 0, amount FROM L) GROUP BY account) WHERE i > 100000 AND o > 0 AND o / i >= 0.8", "least(95.0, 60.0 + q * 30)", "CASE WHEN q >= 0.95 THEN 'CRITICAL' ELSE 'HIGH' END"), L)
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.pass_through(orders_ledger(spark, sf_dir), DAY)


@query("t3_lookback", """
, t AS (SELECT * FROM E WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-20 06:00:00'), h AS (SELECT txn_id, src, dst, amount, ts, channel FROM E WHERE ts < TIMESTAMP '2024-01-20 03:00:00' AND ts >= (SELECT min(ts) FROM t) - INTERVAL 7 DAYS),
k AS (SELECT src AS a FROM t WHERE src % 2 = 0 UNION SELECT dst FROM t WHERE dst % 2 = 0)
SELECT txn_id, src, dst FROM t UNION SELECT txn_id, src, dst FROM h WHERE src IN (FROM k) OR dst IN (FROM k)""", E)
def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = events_ledger(spark, sf_dir)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    today = txn.where((F.col("ts") >= at("2024-01-20 00:00:00")) & (F.col("ts") < at("2024-01-20 06:00:00")))
    known = txn.select(F.explode(F.array("src", "dst")).alias("account")).where("account % 2 = 0").distinct()
    return light.lookback(txn.where(F.col("ts") < at("2024-01-20 03:00:00")), today, known).select("txn_id", "src", "dst")
