"""Ingestion: checks before a load, file hashes, parsers of several ledger formats, customers and accounts, upserts, contracts."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources.ledgers import CHANNEL_OF_FORMAT

#: Currency names to codes, rates to rupees, channels of two other formats, and income ranges of occupations.
CODE_OF_CURRENCY = {"Indian Rupee": "INR", "US Dollar": "USD", "Euro": "EUR", "UK Pound": "GBP", "Bitcoin": "BTC"}
RUPEES_PER = {
    "US Dollar": 83.0, "USD": 83.0, "Euro": 91.0, "EUR": 91.0, "UK Pound": 106.0, "GBP": 106.0, "Yuan": 11.5, "CNY": 11.5, "Yen": 0.56, "JPY": 0.56,
    "Rupee": 1.0, "Indian Rupee": 1.0, "INR": 1.0, "Ruble": 0.93, "RUB": 0.93, "Bitcoin": 83.0, "BTC": 83.0, "Saudi Riyal": 22.1, "SAR": 22.1,
    "Swiss Franc": 95.0, "CHF": 95.0, "Australian Dollar": 55.0, "AUD": 55.0, "Canadian Dollar": 62.0, "CAD": 62.0, "Brazilian Real": 16.5, "BRL": 16.5,
    "Mexican Peso": 4.8, "MXN": 4.8,
}
BANK_CHANNELS = {"ACH": "NEFT", "Wire": "RTGS", "Cheque": "cheque", "Cash": "branch_cash", "Credit Card": "net_banking", "Bitcoin": "UPI", "Reinvestment": "IMPS"}
WALLET_CHANNELS = {"CASH_IN": "branch_cash", "CASH_OUT": "ATM", "DEBIT": "net_banking", "PAYMENT": "UPI", "TRANSFER": "NEFT"}
INCOME_OF = {
    "Business": (800_000, 5_000_000), "Salaried": (300_000, 1_200_000), "Self-Employed": (400_000, 2_000_000), "Trader": (600_000, 3_000_000),
    "Professional": (700_000, 2_500_000), "Retired": (200_000, 600_000), "Farmer": (150_000, 500_000),
}
#: Words in a column's name that say what it holds, in the order in which they are tried.
COLUMN_WORDS = {
    "src": ["from", "source", "sender", "payer", "orig"], "dst": ["to", "dest", "receiver", "payee", "beneficiary"], "amount": ["amount", "value", "sum"],
    "ts": ["time", "date", "timestamp"], "channel": ["type", "channel", "method", "format"], "is_laundering": ["fraud", "laundering", "label", "suspicious"],
}
MAX_BYTES, MAX_ROWS = 600 << 20, 6_000_000


class IngestError(ValueError):
    pass


def lookup(values: dict, key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in values.items() for x in p))[key], otherwise)


def channel_of(payment_format: Column) -> Column:
    return lookup(CHANNEL_OF_FORMAT, F.trim(payment_format), F.lit("unknown"))


def currency_code(name: Column) -> Column:
    """INR for a blank, the code of a known name, else what stands there."""
    text = F.trim(F.coalesce(name, F.lit("")))
    return F.when(text == "", "INR").otherwise(lookup(CODE_OF_CURRENCY, text, text))


def in_rupees(amount: Column, currency: Column) -> Column:
    return amount * lookup(RUPEES_PER, currency, F.lit(83.0))


def entity_type(name: Column) -> Column:
    return F.when(F.coalesce(F.trim(name).startswith("Individual"), F.lit(False)), "INDIVIDUAL").otherwise("BUSINESS")


def file_hash(path: str) -> str:
    """SHA-256 of a local file that is to be uploaded."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def check_upload(spark: SparkSession, path: str, required: list[str], max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> int:
    """Raise IngestError unless a local CSV may be loaded, cheap checks first; the number of its rows."""
    if not path.lower().endswith(".csv"):
        raise IngestError("only .csv files are taken")
    if os.path.getsize(path) > max_bytes:
        raise IngestError(f"over {max_bytes} bytes")
    with open(path, "rb") as f:
        head = f.readline()
    try:
        names = [n.strip().strip('"') for n in head.decode("utf-8-sig").split(",")]
    except UnicodeDecodeError as e:
        raise IngestError("not UTF-8") from e
    if missing := sorted(set(required) - set(names)):
        raise IngestError(f"missing columns: {', '.join(missing)}")
    rows = spark.read.option("header", True).csv(path).limit(max_rows + 1).count()
    if not 1 <= rows <= max_rows:
        raise IngestError(f"{rows} rows are not between 1 and {max_rows}")
    return rows


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that no successful load has taken, each content once; manifest: sha256, status."""
    done = manifest.where("status = 'SUCCESS'").select("sha256")
    return files.groupBy("sha256").agg(F.min("path").alias("path")).join(done, "sha256", "left_anti").select("path", "sha256")


def sniff(names: list[str]) -> str:
    """The format of a header: bank, wallet, normal or generic; IngestError if neither fits."""
    have = {n.strip().lower() for n in names}
    if {"payment format", "amount paid"} <= have:
        return "bank"
    if {"nameorig", "namedest", "step"} <= have:
        return "wallet"
    if {"src", "dst", "amount", "ts"} <= have:
        return "normal"
    if {"src", "dst", "amount", "ts"} <= set(guess_columns(names).values()):
        return "generic"
    raise IngestError(f"unknown header: {', '.join(names)}")


def guess_columns(names: list[str]) -> dict[str, str]:
    """Column name -> what it holds; each thing is given to the first name that fits."""
    out: dict[str, str] = {}
    for name in names:
        for target, words in COLUMN_WORDS.items():
            if target not in out.values() and any(w in name.lower() for w in words):
                out[name] = target
                break
    return out


def parse_bank(raw: DataFrame) -> DataFrame:
    """Ledger of raw bank rows (RAW_COLUMNS): the paid side in rupees; a row without a time gets the next minute from 2024-01-01 on.

    Rows without a time are numbered by ranges of their fields, not in one task.
    """
    from tracewell.operators.aggregates import counts_below

    rows = raw.withColumn("t", F.expr("try_to_timestamp(ts, 'yyyy/MM/dd HH:mm')"))
    fields = F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns), F.monotonically_increasing_id().alias("k"))
    undated = counts_below(rows.where("t IS NULL").withColumns({"o": fields, "one": F.lit(1)}), "o", "one", "nth").drop("o", "one")
    undated = undated.withColumn("t", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(nth as int))")).drop("nth")
    both = rows.where("t IS NOT NULL").unionByName(undated)
    amount = in_rupees(F.coalesce(F.expr("try_cast(amount_paid AS double)"), F.lit(0.0)), F.col("payment_currency"))
    return both.select(
        "src", "dst", F.round(amount, 2).alias("amount"), F.col("t").alias("ts"), lookup(BANK_CHANNELS, F.col("payment_format"), F.lit("net_banking")).alias("channel"),
        "from_bank", "to_bank", F.coalesce(F.expr("try_cast(is_laundering AS int)"), F.lit(0)).alias("is_laundering"),
    )


def parse_wallet(raw: DataFrame) -> DataFrame:
    """Ledger of rows (step, type, amount, nameOrig, nameDest, isFraud): steps are hours from 2024-01-01 on."""
    ts = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(step as int))")
    return raw.select(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst"), "amount", ts.alias("ts"), lookup(WALLET_CHANNELS, F.col("type"), F.lit("net_banking")).alias("channel"), F.col("isFraud").cast("int").alias("is_laundering"))


def parse_generic(raw: DataFrame) -> DataFrame:
    """Ledger of a CSV by its column names; an amount that can't be read is 0, a time null."""
    of = {v: k for k, v in guess_columns(raw.columns).items()}
    if missing := [c for c in ("src", "dst", "amount", "ts") if c not in of]:
        raise IngestError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.col(f"`{of[c]}`").cast("string")
    return raw.select(
        text("src").alias("src"), text("dst").alias("dst"), F.coalesce(text("amount").try_cast("double"), F.lit(0.0)).alias("amount"), F.try_to_timestamp(text("ts")).alias("ts"),
        (text("channel") if "channel" in of else F.lit("unknown")).alias("channel"), (F.coalesce(text("is_laundering").try_cast("int"), F.lit(0)) if "is_laundering" in of else F.lit(0)).alias("is_laundering"),
    )


def first_wins(rows: DataFrame, key: str, order: str, target: DataFrame | None = None) -> DataFrame:
    """The first row of each key in the file's order, without keys that the target has."""
    columns = [c for c in rows.columns if c not in (key, order)]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
    return one if target is None else one.join(target.select(key), key, "left_anti")


def enriched(customers: DataFrame, rows: DataFrame, order: str = "pos") -> DataFrame:
    """customers with occupation and declared_income of the first row of theirs that has either; what they have stays."""
    have = rows.where("occupation IS NOT NULL OR declared_income IS NOT NULL")
    first = have.groupBy("customer_id").agg(F.min_by(F.struct("occupation", "declared_income"), order).alias("f"))
    rest = [c for c in customers.columns if c not in ("occupation", "declared_income", "customer_id")]
    joined = customers.join(first, "customer_id", "left")
    return joined.select("customer_id", *rest, F.coalesce("occupation", "f.occupation").alias("occupation"), F.coalesce("declared_income", "f.declared_income").alias("declared_income"))


def minted_accounts(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """account of both sides that the accounts table lacks."""
    return txn.select(F.explode(F.array("src", "dst")).alias("account")).where("account IS NOT NULL").distinct().join(accounts.select("account"), "account", "left_anti")


def strict_amounts(txn: DataFrame) -> DataFrame:
    """txn, whose reading fails on the first amount that can't be read: a file is loaded as a whole or not at all."""
    bad = F.raise_error(F.concat(F.lit("unreadable amount in "), F.coalesce(F.col("txn_id").cast("string"), F.lit("?"))))
    return txn.withColumn("amount", F.when(F.col("amount").isNull(), bad.cast("double")).otherwise(F.col("amount")))


def load_in_order(accounts_status: str, load) -> str:
    """The status of a transaction load: ABORTED unless the accounts were loaded or had been before."""
    if accounts_status not in ("SUCCESS", "SKIPPED"):
        return "ABORTED"
    try:
        load()
    except Exception:
        return "FAILED"
    return "SUCCESS"


def account_profiles(txn: DataFrame) -> DataFrame:
    """account, inflow, outflow, n, income_bracket by volume: accounts known only from their transfers."""
    from tracewell.operators.aggregates import account_flow

    volume = F.col("inflow") + F.col("outflow")
    bracket = F.when(volume > 5_000_000, "very_high").when(volume > 1_500_000, "high").when(volume > 500_000, "medium").otherwise("low")
    return account_flow(txn).select("account", "inflow", "outflow", "n", bracket.alias("income_bracket"))


def synthetic_profile(account: Column) -> tuple[Column, Column]:
    """(occupation, declared income) that follow from the account's MD5 alone: the 128-bit number's remainders, by 32-bit digits."""
    digest = F.md5(account.cast("string"))
    digits = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]

    def remainder(n: Column) -> Column:
        r = F.lit(0).cast("long")
        for d in digits:
            r = (r * F.lit(1 << 32) + d) % n
        return r

    names = F.array(*map(F.lit, INCOME_OF))
    occupation = F.get(names, remainder(F.lit(len(INCOME_OF))).cast("int"))
    low = lookup({k: v[0] for k, v in INCOME_OF.items()}, occupation, F.lit(0))
    high = lookup({k: v[1] for k, v in INCOME_OF.items()}, occupation, F.lit(1))
    return occupation, (low + remainder((high - low).cast("long"))).cast("double")


def upserted(old: DataFrame, new: DataFrame, key: str, overwrite: list[str]) -> DataFrame:
    """old with new's rows: `overwrite` columns from new, others only where old has nothing; keys of either side."""
    mine = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*mine).alias("o")).join(new.select(key, F.struct(*mine).alias("n")), key, "full")
    empty = lambda c: F.when(c.cast("string") == "", None).otherwise(c)
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in overwrite else F.coalesce(empty(F.col(f"o.{c}")), F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in mine))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def violations(rows: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """check, level, n, share of the rows that break each check; checks: name -> (condition that holds for a bad row, level)."""
    one = rows.agg(F.count("*").alias("rows"), *(F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, (c, _) in checks.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(level).alias("level"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n, (_, level) in checks.items())))
    return one.select("rows", each.alias("x")).select("x.check", "x.level", "x.n", F.round(F.coalesce(F.try_divide("x.n", "rows"), F.lit(0.0)), 6).alias("share"))


def ledger_checks() -> dict[str, tuple[Column, str]]:
    a = F.col("amount")
    return {
        "null_source": (F.col("src").isNull(), "error"), "null_target": (F.col("dst").isNull(), "error"), "null_amount": (a.isNull(), "error"), "unreadable_time": (F.col("ts").isNull(), "error"),
        "not_positive": (a <= 0, "error"), "extreme_amount": (a > 1e12, "error"), "self_transfer": (F.col("src") == F.col("dst"), "warning"),
    }


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """check, n: how many rows stand beyond the first of their key, and how many have none."""
    per = rows.groupBy(key).agg(F.count("*").alias("k"))
    sums = per.agg(F.sum(F.when(F.col(key).isNotNull(), F.col("k") - 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col(key).isNull(), F.col("k")).otherwise(0)).alias("missing"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in ("repeated", "missing")))).alias("x")).select("x.*")


def label_contract(labels: DataFrame, column: str = "label", low: float = 0.0005, high: float = 0.5) -> DataFrame:
    """rows, rate, passed: the share of positive labels, and whether it lies within its bounds."""
    rate = F.coalesce(F.avg(F.col(column).cast("double")), F.lit(0.0))
    return labels.agg(F.count("*").alias("rows"), F.round(rate, 6).alias("rate")).withColumn("passed", F.col("rate").between(low, high))


def column_contract(rows: DataFrame, columns: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """column, missing_share, infinite, constant, outside: one pass over numeric columns, a row each."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        known = F.when(~F.isnan(v), v)
        outside = (known < low if low is not None else F.lit(False)) | (known > high if high is not None else F.lit(False))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.round(F.avg((v.isNull() | F.isnan(v)).cast("int")), 6).alias("missing_share"), F.sum((F.abs(known) == float("inf")).cast("int")).alias("infinite"),
            (F.min(known).eqNullSafe(F.max(known))).alias("constant"), F.sum(F.coalesce(outside, F.lit(False)).cast("int")).alias("outside"),
        ))
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def health(metrics: DataFrame) -> DataFrame:
    """metric, value, healthy of rows (metric, value, low, high)."""
    return metrics.select("metric", "value", (F.col("value") >= F.coalesce("low", "value")).__and__(F.col("value") <= F.coalesce("high", "value")).alias("healthy"))


def nth_of_key(rows: DataFrame, key: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
