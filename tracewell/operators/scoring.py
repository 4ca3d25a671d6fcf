"""Risk scores of accounts and alerts: ensemble, confidence, priority, percentile ranks, queue order and monitors, as columns after joins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import halves_up
from tracewell.operators.aggregates import counts_below
from tracewell.operators.features import PATTERN_WEIGHTS, ratio
from tracewell.operators.rules import SEVERITIES
from tracewell.session import cut

#: Centralities from which on an account counts as central.
HIGH_PAGERANK, HIGH_BETWEENNESS = 0.005, 0.01


def labels(txn: DataFrame) -> DataFrame:
    """account, label of each account: 1 if it ever sent a transfer that is marked."""
    marked = txn.where("is_laundering = 1").select(F.col("src").alias("account")).distinct().withColumn("label", F.lit(1))
    everyone = txn.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    return everyone.join(marked, "account", "left").select("account", F.coalesce("label", F.lit(0)).alias("label"))


def temporal_split(txn: DataFrame, train: float = 0.7, validate: float = 0.85) -> DataFrame:
    """account, part (train, validation, test): accounts in order of their last transfer, ties by account, cut at the two shares.

    The order is taken by ranges of time, so no task holds all accounts. Shares are decimals: 0.7 of 90,000 as doubles is a little less than 63,000.
    """
    last = txn.select(F.explode(F.array("src", "dst")).alias("account"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).groupBy("account").agg(F.max("t").alias("t"))
    placed = counts_below(cut(last).select("account", F.struct("t", "account").alias("o"), F.lit(1).alias("one")), "o", "one", "place")
    n = F.broadcast(placed.agg(F.count("*").alias("n")))
    until = lambda share: F.floor(F.col("n") * F.lit(Decimal(str(share))))
    part = F.when(F.col("place") < until(train), "train").when(F.col("place") < until(validate), "validation").otherwise("test")
    return placed.join(n).select("account", part.alias("part"))


def percentile_rank(rows: DataFrame, value: str, name: str, of: DataFrame | None = None) -> DataFrame:
    """rows with the share of values that are at most their own, over the number of values.

    The number is that of `of` (rows by default): where only some accounts have the other centrality, their ranks divide by its
    count, as in the reference, and may pass 1.
    """
    counts = counts_below(rows.groupBy(F.col(value).alias("v__")).agg(F.count("*").alias("k__")), "v__", "k__", "below__")
    n = F.broadcast((rows if of is None else of).agg(F.count("*").alias("n__")))
    shares = counts.join(n).select("v__", ((F.col("below__") + F.col("k__")) / F.greatest("n__", F.lit(1))).alias(name))
    return rows.join(shares, F.col(value).eqNullSafe(F.col("v__"))).drop("v__")


def ensemble(kinds: DataFrame, centrality: DataFrame, fraud: DataFrame | None = None) -> DataFrame:
    """account, ml, pattern, graph, bonus, score of each account in centrality (account, pagerank, betweenness).

    kinds: (account, kind) of findings; fraud: (account, fraud_prob, fraud_pred). pagerank is null for accounts that
    receive nothing; both ranks divide by the number of accounts that receive. Scores are 100 at most, rounded to cents.
    """
    weight = F.create_map(*(F.lit(x) for p in PATTERN_WEIGHTS.items() for x in p))
    flags = kinds.select("account", "kind").distinct().groupBy("account").agg(F.sum(F.coalesce(weight[F.col("kind")], F.lit(10))).alias("raw"))
    centrality = cut(centrality)  # read five times below
    receiving = centrality.where("pagerank IS NOT NULL")
    by_rank = percentile_rank(receiving.select("account", "pagerank"), "pagerank", "pr_pct").select("account", "pr_pct")
    by_between = percentile_rank(centrality.select("account", "betweenness"), "betweenness", "bc_pct", receiving).select("account", "bc_pct")
    rows = centrality.select("account").join(by_rank, "account", "left").join(by_between, "account", "left").join(flags, "account", "left")
    rows = rows.join(fraud, "account", "left") if fraud is not None else rows.withColumns({"fraud_prob": F.lit(0.0), "fraud_pred": F.lit(False)})
    p, hit = F.coalesce("fraud_prob", F.lit(0.0)), F.coalesce(F.col("fraud_pred").cast("boolean"), F.lit(False))
    flagged = F.col("raw").isNotNull()
    over = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)) - 0.5) * 50
    ml = F.when(hit, p * 30).otherwise(0.0)
    pattern = F.least(F.coalesce("raw", F.lit(0)), F.lit(100)) * 0.55
    graph = F.when(flagged, (over(F.col("pr_pct")) + over(F.col("bc_pct"))) * 0.3).otherwise(0.0)
    bonus = F.when(flagged & (p > 0.5), (p - 0.5) / 0.5 * 15).otherwise(0.0)
    parts = {"ml": ml, "pattern": pattern, "graph": graph, "bonus": bonus}
    return rows.select("account", *(F.round(c, 4).alias(n) for n, c in parts.items()), halves_up(F.least(ml + pattern + graph + bonus, F.lit(100.0)), 2).alias("score"))


def indicator_count(n_kinds: Column, fraud_prob: Column, pagerank: Column, betweenness: Column) -> Column:
    """How many independent signs speak against an account."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.coalesce(n_kinds, F.lit(0)) + one(fraud_prob > 0.5) + one(pagerank > HIGH_PAGERANK) + one(betweenness > HIGH_BETWEENNESS)


def confidence(count: Column) -> Column:
    return F.when(count >= 4, "Very Strong").when(count >= 3, "Strong").when(count >= 2, "Moderate").when(count >= 1, "Weak").otherwise("None")


def priority(risk: Column, level: Column, amount: Column, accounts: Column) -> Column:
    """P1 to P4 from risk, confidence, money and the number of accounts."""
    of_risk = F.when(risk >= 76, 40).when(risk >= 51, 25).when(risk >= 26, 10).otherwise(0)
    of_level = F.when(level == "Very Strong", 30).when(level == "Strong", 20).when(level == "Moderate", 10).when(level == "Weak", 5).otherwise(0)
    of_amount = F.when(amount >= 10_000_000, 20).when(amount >= 1_000_000, 10).otherwise(0)
    points = of_risk + of_level + of_amount + F.when(accounts >= 5, 10).otherwise(0)
    return F.when(points >= 88, "P1").when(points >= 58, "P2").when(points >= 28, "P3").otherwise("P4")


def alert_rows(findings: DataFrame, scores: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """One alert a finding (account_ids array<string>, kind, day, score, severity), ids repeatable.

    Of the same finding the greatest score and severity stay. The set of accounts is sorted and distinct; the primary one has the greatest risk score of scores (account as text, risk),
    ties by place; an alert on a watched account (account) is P1, else its priority follows risk, one indicator and no amount.
    """
    ids = F.array_sort(F.array_distinct("account_ids"))
    rows = findings.where(F.size("account_ids") > 0).withColumn("ids", ids)
    key = F.concat_ws("-", F.array_join("ids", ","), "kind", F.col("day").cast("string"))
    rows = rows.withColumn("alert_id", F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    rows = rows.groupBy("alert_id").agg(F.first("ids").alias("ids"), F.first("kind").alias("kind"), F.first("day").alias("day"), F.max("score").alias("score"), F.max(F.struct(rank, "severity"))["severity"].alias("severity"))
    each = rows.select("alert_id", F.posexplode("ids").alias("place", "account")).join(scores.select("account", "risk"), "account", "left")
    watched = each.join(watchlist.select("account").distinct().withColumn("w", F.lit(True)), "account", "left") if watchlist is not None else each.withColumn("w", F.lit(None).cast("boolean"))
    best = watched.groupBy("alert_id").agg(F.max(F.struct(F.coalesce("risk", F.lit(0.0)).alias("risk"), (-F.col("place")).alias("k"), "account")).alias("b"), F.max(F.coalesce("w", F.lit(False))).alias("watched"))
    usual = priority(F.col("b.risk"), confidence(F.lit(1)), F.lit(0.0), F.size("ids"))
    return rows.join(best, "alert_id").select(
        "alert_id", F.array_join("ids", ",").alias("account_ids"), F.col("b.account").alias("primary_account"), "kind", "day", F.round("score", 6).alias("score"),
        "severity", F.round("b.risk", 2).alias("risk"), F.when(F.col("watched"), "P1").otherwise(usual).alias("priority"),
    )


def rl_context(alerts: DataFrame) -> DataFrame:
    """alert_id and 16 numbers within fixed bounds that describe it, from its risk, score, kind, amounts and accounts.

    alerts: alert_id, risk, score, kind, n_accounts, amount, n_txns, age_days, prior_alerts, velocity; missing numbers are 0.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    upto = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(top))
    kinds = list(PATTERN_WEIGHTS)
    parts = [
        upto(n("risk") / 100, 1.0), upto(n("score"), 1.0), upto(n("n_accounts") / 10, 1.0), upto(F.log1p(n("amount")) / 20, 1.0), upto(F.log1p(n("n_txns")) / 10, 1.0),
        upto(n("age_days") / 365, 1.0), upto(n("prior_alerts") / 10, 1.0), upto(n("velocity") / 10, 1.0), *((F.col("kind") == k).cast("double") for k in kinds), F.lit(1.0),
    ]
    return alerts.select("alert_id", F.array(*(F.coalesce(p, F.lit(0.0)) for p in parts)).alias("context"))


def ranked_queue(alerts: DataFrame, scores: DataFrame, top: int = 200) -> DataFrame:
    """alerts (alert_id, account, kind, risk) in the order in which they are worked on: place, account, kinds, risk, rank_score.

    One row an account with the union of its kinds; the `top` by risk are ordered by scores (account, rank_score), the
    others follow in order of risk. Places beyond the top are found by ranges.
    """
    rows = alerts.groupBy("account").agg(F.max("risk").alias("risk"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    rows = cut(rows)  # read by the top, by the rest, and by the sample of ranges
    first = rows.orderBy(F.desc("risk"), "account").limit(top).join(scores, "account", "left")
    rest = rows.join(first.select("account"), "account", "left_anti").withColumn("rank_score", F.lit(None).cast("double"))
    order = F.struct(F.lit(0).alias("g"), (-F.coalesce("rank_score", F.lit(0.0))).alias("s"), "account"), F.struct(F.lit(1).alias("g"), (-F.col("risk")).alias("s"), "account")
    both = first.select("account", "kinds", "risk", "rank_score", order[0].alias("o")).unionByName(rest.select("account", "kinds", "risk", "rank_score", order[1].alias("o")))
    placed = counts_below(both.withColumn("one", F.lit(1)), "o", "one", "place")
    return placed.select((F.col("place") + 1).alias("place"), "account", "kinds", "risk", "rank_score")


def explained(contributions: DataFrame, top: int = 10) -> DataFrame:
    """account, drivers, protective: the `top` features by size of (account, feature, value), split by sign, largest first."""
    place = F.row_number().over(Window.partitionBy("account").orderBy(F.desc(F.abs("value")), "feature"))
    rows = contributions.withColumn("place", place).where(F.col("place") <= top)
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", "feature")))), lambda x: x["feature"]), ",")
    return rows.groupBy("account").agg(names(F.col("value") > 0).alias("drivers"), names(F.col("value") <= 0).alias("protective"))


def evidence_ranks(findings: DataFrame, order: list[str]) -> DataFrame:
    """rule, score, place of each rule by its findings (rule, account, severity, score); ties in the order given."""
    weight = F.when(F.col("severity") == "CRITICAL", 1.0).when(F.col("severity") == "HIGH", 0.75).when(F.col("severity") == "MEDIUM", 0.5).otherwise(0.25)
    rows = findings.groupBy("rule").agg(F.max(weight).alias("w"), F.max("score").alias("s"), F.countDistinct("account").alias("n"))
    score = 0.55 * F.col("w") + 0.3 * F.col("s") + 0.15 * F.least(F.col("n") / 5, F.lit(1.0))
    names = F.array(*map(F.lit, order))
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.array_position(names, F.col("rule")), "rule"))  # a row a rule
    return rows.select("rule", F.round(score, 6).alias("score")).withColumn("place", place)


def drift(before: DataFrame, after: DataFrame, most: float = 0.5) -> DataFrame:
    """kind, rate_before, rate_after, change, drifted: shares of each kind of finding in two runs (kind), and whether they moved over `most`."""
    of = lambda d, n: d.groupBy("kind").agg(F.count("*").alias(n)).join(F.broadcast(d.agg(F.count("*").alias(n + "_all")))).select("kind", ratio(F.col(n), F.col(n + "_all")).alias(n))
    rows = of(before, "rate_before").join(of(after, "rate_after"), "kind", "full").fillna(0.0)
    change = F.abs(ratio(F.col("rate_after") - F.col("rate_before"), F.col("rate_before"), 1.0))
    return rows.select("kind", F.round("rate_before", 6).alias("rate_before"), F.round("rate_after", 6).alias("rate_after"), F.round(change, 6).alias("change"), (change > most).alias("drifted"))


def top_by_kind(findings: DataFrame, most: int = 200, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """The `most` findings of each kind by score, ties by keys: a report's limit."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), *keys))
    return findings.withColumn("place", place).where(F.col("place") <= most)


def best_per_account(findings: DataFrame, order: str = "kind") -> DataFrame:
    """The finding of the greatest score of each account; of equal ones the first in order."""
    place = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("score"), order))
    return findings.withColumn("place", place).where("place = 1").drop("place")
