"""The desk: filters over alerts, cases and logs, workload, watchlists, dashboards, verdicts, case life cycle and its feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.features import ratio
from tracewell.sources.desk import OPEN_STATES

#: Legal moves of a case, and hours within which it is due.
MOVES = {
    "NEW": ["ASSIGNED"], "ASSIGNED": ["IN_PROGRESS"], "IN_PROGRESS": ["AWAITING_REVIEW", "ESCALATED", "CLOSED_FP"],
    "AWAITING_REVIEW": ["IN_PROGRESS", "CLOSED_TP", "CLOSED_FP", "MONITORING"], "ESCALATED": ["AWAITING_REVIEW", "CLOSED_TP", "CLOSED_FP", "MONITORING"],
}
DUE_HOURS = {"P1": 4, "P2": 24, "P3": 72, "P4": 168}


def filtered(rows: DataFrame, equal: dict | None = None, ranges: dict | None = None, missing: list[str] | None = None) -> DataFrame:
    """Rows whose columns equal a value or are in a list, lie in a closed range (either end may be None), or are null."""
    tests: list[Column] = []
    for c, v in (equal or {}).items():
        tests.append(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    for c, (low, high) in (ranges or {}).items():
        tests += [F.col(c) >= low] if low is not None else []
        tests += [F.col(c) <= high] if high is not None else []
    tests += [F.col(c).isNull() for c in missing or []]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def alerts_of(alerts: DataFrame, cases: DataFrame, assignee: str) -> DataFrame:
    """Alerts that belong to a case of an assignee."""
    return alerts.join(cases.where(F.col("assigned_to") == assignee).select("case_id"), "case_id", "left_semi")


def account_window(txn: DataFrame, account, start=None, end=None, sent: bool = True, received: bool = True, limit: int = 500, most_recent: bool = False) -> DataFrame:
    """Transfers of an account within closed ends, oldest first; most_recent takes the newest `limit` and then puts them in order."""
    side = (F.col("src") == account if sent else F.lit(False)) | (F.col("dst") == account if received else F.lit(False))
    rows = txn.where(side)
    rows = rows.where(F.col("ts") >= F.lit(start)) if start is not None else rows
    rows = rows.where(F.col("ts") <= F.lit(end)) if end is not None else rows
    if most_recent:
        return rows.orderBy(F.desc("ts"), F.desc("txn_id")).limit(limit).orderBy("ts", "txn_id")
    return rows.orderBy("ts", "txn_id").limit(limit)


def decorated(txn: DataFrame, accounts: DataFrame, scope: DataFrame) -> DataFrame:
    """Transfers that touch the scope (account), with city and occupation of both ends and the direction as seen from the scope."""
    of = lambda side: accounts.select(F.col("account").alias(side), F.col("city").alias(f"{side}_city"), F.col("occupation").alias(f"{side}_occupation"))
    inside = lambda side: scope.select(F.col("account").alias(side), F.lit(True).alias(f"{side}_in")).distinct()
    rows = txn.join(inside("src"), "src", "left").join(inside("dst"), "dst", "left").where("src_in OR dst_in")
    direction = F.when(F.col("src_in") & F.col("dst_in"), "internal").when(F.col("src_in"), "out").otherwise("in")
    return rows.join(of("src"), "src", "left").join(of("dst"), "dst", "left").withColumn("direction", direction).drop("src_in", "dst_in")


def workload(users: DataFrame, cases: DataFrame) -> DataFrame:
    """user_id, n_open of the active users, those without open cases included."""
    mine = cases.where(F.col("status").isin(OPEN_STATES)).select(F.col("assigned_to").alias("user_id"), "case_id")
    return users.where("active").join(mine, "user_id", "left").groupBy("user_id").agg(F.count("case_id").alias("n_open"))


def assigned(new_cases: list[tuple], load: dict[str, int]) -> list[tuple]:
    """(case, user) in order, each to the user with fewest open cases, ties by name: a fold over one batch of new cases."""
    load, out = dict(load), []
    if new_cases and not load:
        raise ValueError("no active user")
    for case in new_cases:
        user = min(load, key=lambda u: (load[u], u))
        load[user] += 1
        out.append((case, user))
    return out


def due(priority: Column, since: Column) -> Column:
    hours = F.create_map(*(F.lit(x) for p in DUE_HOURS.items() for x in p))[priority]
    return since + F.make_dt_interval(hours=hours)


def overdue(cases: DataFrame, now: Column) -> DataFrame:
    """Open cases that should have been done by now."""
    return cases.where(F.col("status").isin(OPEN_STATES) & (due(F.col("priority"), F.col("opened")) < now))


def illegal_moves(history: DataFrame) -> DataFrame:
    """case_id, seq, before, status of each entry of a log (case_id, seq, status) that the life cycle doesn't allow; the first has to be NEW."""
    before = F.lag("status").over(Window.partitionBy("case_id").orderBy("seq"))
    legal = F.create_map(*(x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = history.withColumn("before", before)
    fine = F.when(F.col("before").isNull(), F.col("status") == "NEW").otherwise(F.coalesce(F.array_contains(legal[F.col("before")], F.col("status")), F.lit(False)))
    return rows.where(~fine).select("case_id", "seq", "before", "status")


def screened(accounts: DataFrame, watchlist: DataFrame) -> DataFrame:
    """account, entry_id, matched_by of accounts (account, customer) on the watchlist: an account's own entry before its customer's."""
    by_account = accounts.join(watchlist.where("account IS NOT NULL").select("account", "entry_id"), "account").select("account", "entry_id", F.lit(0).alias("o"))
    entries = watchlist.where("customer IS NOT NULL").select("customer", "entry_id")
    by_customer = accounts.join(entries, "customer").select("account", "entry_id", F.lit(1).alias("o"))
    best = by_account.unionByName(by_customer).groupBy("account").agg(F.min(F.struct("o", "entry_id")).alias("b"))
    return best.select("account", "b.entry_id", F.when(F.col("b.o") == 0, "account").otherwise("customer").alias("matched_by"))


def watch_activity(watchlist: DataFrame, txn: DataFrame, alerts: DataFrame, since: Column) -> DataFrame:
    """entry_id, account, last_ts, n_alerts of watched accounts: the latest transfer, and alerts since a time."""
    own = watchlist.where("account IS NOT NULL").select("entry_id", "account")
    last = txn.select(F.explode(F.array("src", "dst")).alias("account"), "ts").join(own.select("account"), "account", "left_semi").groupBy("account").agg(F.max("ts").alias("last_ts"))
    n = alerts.where(F.col("created") >= since).groupBy("account").agg(F.count("*").alias("n_alerts"))
    return own.join(last, "account", "left").join(n, "account", "left").select("entry_id", "account", "last_ts", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))


def prior_cases(accounts: DataFrame, alerts: DataFrame, cases: DataFrame, case_id) -> DataFrame:
    """account, n_prior, had_sar: other cases of the accounts' alerts, and whether one ended in a report."""
    links = alerts.where(F.col("case_id").isNotNull() & (F.col("case_id") != case_id)).select("account", "case_id").distinct()
    rows = accounts.select("account").distinct().join(links, "account").join(cases.select("case_id", "resolution"), "case_id")
    return rows.groupBy("account").agg(F.count("*").alias("n_prior"), F.coalesce(F.bool_or(F.col("resolution") == "TRUE_POSITIVE_SAR"), F.lit(False)).alias("had_sar"))


def alert_history(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """account, total, n_sar, n_false, n_open, risks (in order of time, the last twenty): what is known of an account's alerts."""
    place = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("created"), F.desc("alert_id")))
    rows = alerts.join(cases.select("case_id", "resolution"), "case_id", "left").withColumn("place", place)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    trend = F.array_sort(F.collect_list(F.when(F.col("place") <= 20, F.struct((-F.col("place")).alias("o"), "risk"))))
    return rows.groupBy("account").agg(
        F.count("*").alias("total"), n(F.col("resolution") == "TRUE_POSITIVE_SAR").alias("n_sar"), n(F.col("resolution") == "FALSE_POSITIVE").alias("n_false"),
        n(F.col("status") == "open").alias("n_open"), F.array_join(F.transform(trend, lambda x: F.format_string("%.2f", x["risk"])), ",").alias("risks"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """severity, n, mean_risk of every severity, those without alerts with 0."""
    every = alerts.sparkSession.createDataFrame([(s,) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")], "severity string")
    n = alerts.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 4).alias("mean_risk"))
    return every.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_risk", F.lit(0.0)).alias("mean_risk"))


def verdict_precision(cases: DataFrame, by: str) -> DataFrame:
    """by, tp, fp, precision: how many closed cases of each group were real."""
    n = lambda r: F.sum(F.coalesce((F.col("resolution") == r).cast("int"), F.lit(0)))
    rows = cases.where("resolution IS NOT NULL").groupBy(by).agg(n("TRUE_POSITIVE_SAR").alias("tp"), n("FALSE_POSITIVE").alias("fp"))
    return rows.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3))


def what_changed(alerts: DataFrame, hours: int, until: Column) -> DataFrame:
    """case_id, n, kinds, top_risk of the alerts of the last hours (720 at most)."""
    since = until - F.make_dt_interval(hours=F.lit(min(int(hours), 720)))
    rows = alerts.where((F.col("created") > since) & (F.col("created") <= until) & F.col("case_id").isNotNull())
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("risk").alias("top_risk"))


def accessible(cases: DataFrame, role: str, user: str) -> DataFrame:
    """Cases that a role may see: all for admins and auditors, an investigator's own, those up for review for reviewers."""
    if role in ("admin", "auditor"):
        return cases
    if role == "reviewer":
        return cases.where(F.col("status").isin("AWAITING_REVIEW", "ESCALATED"))
    return cases.where(F.col("assigned_to") == user)


def feedback(cases: DataFrame) -> DataFrame:
    """case_id, reward: 1 for a report, -0.3 for a false alarm, of cases that are closed."""
    return cases.where("resolution IS NOT NULL").select("case_id", F.when(F.col("resolution") == "TRUE_POSITIVE_SAR", 1.0).otherwise(-0.3).alias("reward"))


def learned_confidence(verdicts: DataFrame, start: float = 0.5, step: float = 0.1) -> DataFrame:
    """rule, n, confidence after its verdicts (rule, seq, good), taken in order."""
    from tracewell.operators.rules import confidence_after

    rows = verdicts.groupBy("rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "good"))).alias("v"))
    return rows.select("rule", "n", F.round(confidence_after(start, F.transform("v", lambda x: x["good"]), step), 6).alias("confidence"))


def entry_hash(columns: list[str | Column]) -> Column:
    """SHA-256 of columns, each with its length before it, so that no other row of texts gives the same; null counts as empty."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts)), 256)


def broken_links(log: DataFrame, fields: list[str]) -> DataFrame:
    """seq, broken (link, content) of an audit log (seq, fields, prev_hash, row_hash): entries whose hashes don't follow.

    A row's hash is that of its fields and the hash before (`entry_hash`), so the check is parallel: each row is held against its
    predecessor, found by seq in ranges.
    """
    from tracewell.session import cut

    dealt = cut(log.repartitionByRange("seq").withColumn("range", F.spark_partition_id()))
    edge = dealt.groupBy("range").agg(F.max(F.struct("seq", "row_hash")).alias("e"))
    edge = edge.select("range", F.lag("e").over(Window.orderBy("range")).alias("e"))  # a row a partition; empty ones have none
    before = F.lag("row_hash").over(Window.partitionBy("range").orderBy("seq"))
    rows = dealt.withColumn("b", before).join(F.broadcast(edge), "range").withColumn("before", F.coalesce("b", "e.row_hash", F.lit("")))
    own = entry_hash([*fields, "prev_hash"])
    broken = F.when(F.coalesce("prev_hash", F.lit("")) != F.col("before"), "link").when(~own.eqNullSafe(F.col("row_hash")), "content")
    return rows.select("seq", broken.alias("broken")).where("broken IS NOT NULL")


def candidates_reranked(rows: DataFrame, scores: DataFrame, top: int, key: str = "account") -> DataFrame:
    from tracewell.operators.scoring import ranked_queue

    return ranked_queue(rows.withColumnRenamed(key, "account"), scores, top)


def one_case_an_account(alerts: DataFrame, top: int) -> DataFrame:
    """The best alert of each account, and of these the `top` by risk: for which cases are opened."""
    best = alerts.groupBy("account").agg(F.max(F.struct("risk", "alert_id")).alias("b"))
    return best.select("account", "b.alert_id", "b.risk").orderBy(F.desc("risk"), "account").limit(top)


def recall(attempts: DataFrame, flagged: DataFrame) -> DataFrame:
    """pattern, attempts, found, recall: attempts (attempt, pattern, account) of which any account was flagged (account)."""
    hit = attempts.join(flagged.select("account").distinct().withColumn("hit", F.lit(1)), "account", "left")
    per = hit.groupBy("attempt", "pattern").agg(F.max(F.coalesce("hit", F.lit(0))).alias("found"))
    rows = per.groupBy("pattern").agg(F.count("*").alias("attempts"), F.sum("found").alias("found"))
    return rows.withColumn("recall", F.round(ratio(F.col("found"), F.col("attempts")), 6))


def separation(scored: DataFrame) -> DataFrame:
    """mean_marked, mean_clean, gap of (label, score)."""
    mean = lambda v: F.coalesce(F.avg(F.when(F.col("label") == v, F.col("score"))), F.lit(0.0))
    rows = scored.agg(mean(1).alias("a"), mean(0).alias("b"))
    return rows.select(F.round("a", 4).alias("mean_marked"), F.round("b", 4).alias("mean_clean"), F.round(F.col("a") - F.col("b"), 4).alias("gap"))


def run_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """state, n of an alert diff: what a daily run reports."""
    from tracewell.operators.sets import alert_changes

    return alert_changes(old, new).groupBy("state").agg(F.count("*").alias("n"))
