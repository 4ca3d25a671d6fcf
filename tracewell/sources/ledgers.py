"""Ledgers as one schema: txn_id, src, dst, amount, ts, channel, from_bank, to_bank, is_laundering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payment formats to channels, and currency names to codes.
CHANNEL_OF_FORMAT = {"Wire": "RTGS", "ACH": "NEFT", "Cheque": "cheque", "Cash": "branch_cash"}
RAW_COLUMNS = "ts string, from_bank string, src string, to_bank string, dst string, amount_received string, receiving_currency string, amount_paid string, payment_currency string, payment_format string, is_laundering string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers paying parts' accounts: one transfer per order line. Customers join orders first, so lines are shuffled once, by order."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    many = F.broadcast(customer.agg(F.count("*").alias("n_accounts")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    known = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(known, F.col("l_orderkey") == F.col("o_orderkey")).join(many)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.col("o_custkey").alias("src"), (F.col("l_partkey") % F.col("n_accounts")).alias("dst"), F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("ts"), F.col("o_orderpriority").alias("channel"), F.col("c_nationkey").alias("from_bank"),
        (F.col("l_suppkey") % 25).alias("to_bank"), (F.col("l_returnflag") == "R").cast("int").alias("is_laundering"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users paying one another: one transfer per event, with unique times."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    many = F.broadcast(events.agg(F.countDistinct("user_id").alias("n_users")))
    return events.join(many).select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("src"), ((F.col("user_id") * 7 + F.col("event_id")) % F.col("n_users")).alias("dst"),
        F.col("value").alias("amount"), "ts", F.col("event_type").alias("channel"),
    )


def income_bracket(income: Column) -> Column:
    """Bracket of a declared income in the units of the driver tables."""
    return F.when(income > 6000, "high").when(income > 2000, "middle").when(income > 0, "low").otherwise("none")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, declared_income, income_bracket, occupation, city of each customer."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("declared_income"), income_bracket(F.col("c_acctbal")).alias("income_bracket"), F.col("c_mktsegment").alias("occupation"), F.col("n_name").alias("city")
    )


def both_sides(txn: DataFrame) -> DataFrame:
    """A row per transfer and side: account, other, direction; a self-transfer gives two."""
    rest = [c for c in txn.columns if c not in ("src", "dst")]
    out = txn.select(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(txn.select(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit("in").alias("direction"), *rest))


def sides_in_one_scan(txn: DataFrame) -> DataFrame:
    """The rows of both_sides from one reading of the ledger; filters on accounts don't reach the scan."""
    rest = [c for c in txn.columns if c not in ("src", "dst")]
    side = lambda me, other, name: F.struct(F.col(me).alias("account"), F.col(other).alias("other"), F.lit(name).alias("direction"))
    rows = txn.select(F.explode(F.array(side("src", "dst", "out"), side("dst", "src", "in"))).alias("s"), *rest)
    return rows.select("s.account", "s.other", "s.direction", *rest)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw ledger by position (its header repeats a name); short rows are padded with nulls."""
    return spark.read.schema(RAW_COLUMNS).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def normalise_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfers, rejected rows): ids from the raw fields and their occurrence, channels mapped, the paid side's amount."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in raw.columns[:10]]
    key = F.concat_ws("|", *fields)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    channel = F.create_map(*(F.lit(x) for pair in CHANNEL_OF_FORMAT.items() for x in pair))[F.col("payment_format")]
    rows = raw.withColumn("key", key).withColumn("nth", nth)
    rows = rows.select(
        F.concat(F.lit("TXN-"), F.substring(F.sha2(F.concat_ws("|", "key", F.col("nth").cast("string")), 256), 1, 32)).alias("txn_id"),
        "src", "dst", F.expr("try_cast(amount_paid AS double)").alias("amount"), F.expr("try_to_timestamp(ts, 'yyyy/MM/dd HH:mm')").alias("ts"),
        F.coalesce(channel, F.lit("unknown")).alias("channel"), "from_bank", "to_bank", F.expr("try_cast(is_laundering AS int)").alias("is_laundering"),
    )
    good = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("ts").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))
    return rows.where(good), rows.where(~good)
