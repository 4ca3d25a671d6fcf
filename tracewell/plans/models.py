"""Registered queries of models and of similar names. They have no SQL: tests hold them against planted cases, all pairs and the trees themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import detectors, ml, names, scoring
from tracewell.operators.features import account_features
from tracewell.operators.graph import centrality
from tracewell.plans.registry import QUERIES
from tracewell.session import cut
from tracewell.sources.ledgers import accounts, orders_ledger, table


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = account_features(orders_ledger(spark, sf_dir), accounts(spark, sf_dir), 90_000, 100_000, 100)
    return rows, [c for c in rows.columns if c not in ("account", "clustering_coeff")]


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """Features, their columns, labels and parts, each table written once: training and scoring read them several times."""
    rows, columns = _features(spark, sf_dir)
    txn = orders_ledger(spark, sf_dir)
    return cut(rows), columns, cut(scoring.labels(txn.where("amount >= 90000"))), cut(scoring.temporal_split(txn))


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.isolation_scores(*_features(spark, sf_dir))


def fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.fraud_scores(*_training(spark, sf_dir))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drives and what lowers each account's score: its ten features of most weight."""
    rows, columns, labels, parts = _training(spark, sf_dir)
    model = ml.fraud_model(rows, columns, labels, parts)
    return scoring.explained(ml.by_feature(ml.contributions(rows, model), model), 10)


def features_to_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From transfers to the order of work: one table of features, trees, detectors, ensemble, and the accounts that stand out in order."""
    txn, who = orders_ledger(spark, sf_dir), accounts(spark, sf_dir)
    rows, columns, labels, parts = _training(spark, sf_dir)
    fraud = cut(ml.fraud_scores(rows, columns, labels, parts).select("account", "fraud_prob", "fraud_pred"))
    odd = ml.isolation_scores(rows, columns)
    named = lambda found, account, kind: found.select(F.col(account).alias("account"), F.lit(kind).alias("kind"), "score")
    found = named(detectors.amount_band_count(txn, 90_000, 100_000, 3, 30), "src", "structuring").unionByName(named(detectors.income_mismatch(txn, who), "account", "profile_mismatch"))
    found = cut(found.unionByName(named(detectors.inactivity_then_burst(txn, 120 * 86_400), "account", "dormancy")))
    risk = scoring.ensemble(found, centrality(txn), fraud)
    alerts = found.join(risk.select("account", F.col("score").alias("risk")), "account").select("account", "kind", "risk")
    order = odd.select("account", F.col("anomaly").alias("rank_score"))
    return scoring.ranked_queue(alerts, order)


def similar_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose names are alike. The ratio of two names can't be had in SQL; tests hold all pairs against it."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    return names.similar_names(rows, 0.85, ("s_nationkey",)).select("id_a", "id_b", F.round("ratio", 6).alias("ratio"))


QUERIES |= {"j10_similar_suppliers": similar_suppliers, "m1_isolation_scores": isolation, "m2_fraud_scores": fraud, "m14_contributions": contributions, "m8_features_to_queue": features_to_queue}
