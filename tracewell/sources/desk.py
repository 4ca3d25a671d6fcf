"""Alerts, cases, users and a watchlist projected from the driver's tables, for the queries of the investigation desk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.ledgers import table

KINDS = ["structuring", "layering", "round_trip", "dormancy", "fan_out", "profile_mismatch"]
ALERT_STATES = ["open", "in_review", "closed", "dismissed"]
CASE_STATES = ["NEW", "ASSIGNED", "IN_PROGRESS", "AWAITING_REVIEW", "CLOSED_TP", "CLOSED_FP"]
OPEN_STATES = CASE_STATES[:4]


def _pick(values: list[str], place) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alert_id, account, kind, score, risk, severity, status, created, case_id: one alert for each event of 60 or more."""
    e = table(spark, sf_dir, "events").where("value >= 60")
    risk = F.round(F.least(F.col("value") / 2.5, F.lit(100.0)), 2)
    return e.select(
        F.concat(F.lit("A"), F.col("event_id")).alias("alert_id"), F.col("user_id").alias("account"), _pick(KINDS, F.col("event_id") % 6).alias("kind"),
        F.round(F.least(F.col("value") / 250, F.lit(1.0)), 4).alias("score"), risk.alias("risk"), F.when(risk >= 90, "CRITICAL").when(risk >= 75, "HIGH").otherwise("MEDIUM").alias("severity"),
        _pick(ALERT_STATES, F.col("event_id") % 4).alias("status"), F.col("ts").alias("created"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") * 10 + F.col("event_id") % 2).alias("case_id"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, primary_account, opened, risk, n_alerts, status, assigned_to, priority, resolution of the alerts' cases."""
    rows = alerts(spark, sf_dir).where("case_id IS NOT NULL").groupBy("case_id").agg(
        F.min("account").alias("primary_account"), F.min("created").alias("opened"), F.max("risk").alias("risk"), F.count("*").alias("n_alerts")
    )
    status = _pick(CASE_STATES, F.col("case_id") % 6)
    return rows.select(
        "*", status.alias("status"), F.when(F.col("case_id") % 5 != 0, F.concat(F.lit("u"), F.col("case_id") % 7)).alias("assigned_to"),
        F.when(F.col("risk") >= 97, "P1").when(F.col("risk") >= 90, "P2").when(F.col("risk") >= 80, "P3").otherwise("P4").alias("priority"),
        F.when(status == "CLOSED_TP", "TRUE_POSITIVE_SAR").when(status == "CLOSED_FP", "FALSE_POSITIVE").alias("resolution"),
    )


def users(spark: SparkSession) -> DataFrame:
    return spark.range(9).select(F.concat(F.lit("u"), F.col("id")).alias("user_id"), (F.col("id") % 4 != 3).alias("active"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, account, customer, reason: every seventh account, and every tenth customer besides."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    by_account = own.where("k % 7 = 0").select(F.concat(F.lit("a"), "k").alias("entry_id"), F.col("k").alias("account"), F.lit(None).cast("long").alias("customer"), F.lit("account").alias("reason"))
    by_customer = own.where("k % 10 = 0").select(F.concat(F.lit("c"), "k").alias("entry_id"), F.lit(None).cast("long").alias("account"), F.col("k").alias("customer"), F.lit("customer").alias("reason"))
    return by_account.unionByName(by_customer)
