"""Facts for reports and validators of what is said about them: overviews, exposures, profiles, upload summaries, grounding, egress checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import SHAPES, quantities_in
from tracewell.operators.aggregates import account_flow
from tracewell.operators.features import ratio, risk_bucket
from tracewell.sources.ledgers import sides_in_one_scan

#: What may be done about a finding, and the kinds of findings that call for it; none: any kind.
ACTIONS = {
    "TRACE_LAYERING_CHAIN": ["layering"],
    "INVESTIGATE_ROUND_TRIP": ["round_trip"],
    "REVIEW_STRUCTURING_DEPOSITS": ["structuring"],
    "REVIEW_DORMANCY_REACTIVATION": ["dormancy"],
    "VERIFY_KYC_PROFILE_MISMATCH": ["profile_mismatch"],
    "EXPAND_NETWORK_INVESTIGATION": [],
    "REVIEW_RELATIONSHIP_LINKS": [],
    "REVIEW_PRIOR_SAR_LINKS": [],
    "APPLY_ENHANCED_DUE_DILIGENCE": [],
    "FILE_STR": [],
    "PLACE_UNDER_MONITORING": [],
    "ESCALATE_TO_L2": [],
    "CLOSE_AS_FALSE_POSITIVE": [],
}


def bank_diversity(txn: DataFrame, most: int = 50) -> DataFrame:
    """account, banks, dispersion: distinct banks paid to and paid from, and their share of `most`."""
    rows = sides_in_one_scan(txn)
    bank = F.when(F.col("direction") == "out", F.col("to_bank")).otherwise(F.col("from_bank"))
    pairs = rows.select("account", "direction", bank.alias("bank")).where("bank IS NOT NULL").distinct()
    return pairs.groupBy("account").agg(F.count("*").alias("banks")).withColumn("dispersion", F.least(F.col("banks"), F.lit(most)) / most)


def flagged_channels(txn: DataFrame, flagged: DataFrame) -> DataFrame:
    """channel, n, total, senders of what flagged accounts (account) sent."""
    rows = txn.join(flagged.select(F.col("account").alias("src")).distinct(), "src", "left_semi")
    per = rows.groupBy("channel", "src").agg(F.count("*").alias("n"), F.sum("amount").alias("x"))
    return per.groupBy("channel").agg(F.sum("n").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.count("*").alias("senders"))


def overview(scores: DataFrame, roles: DataFrame) -> DataFrame:
    """what, name, n: how many accounts fall into each risk bucket and role, those without a score included as LOW."""
    joined = roles.join(scores, "account", "left")
    risk = joined.groupBy(risk_bucket(F.coalesce("risk", F.lit(0.0))).alias("name")).agg(F.count("*").alias("n")).select(F.lit("risk").alias("what"), "name", "n")
    role = joined.groupBy(F.col("role").alias("name")).agg(F.count("*").alias("n")).select(F.lit("role").alias("what"), "name", "n")
    return risk.unionByName(role)


def monthly_where(txn: DataFrame, condition: Column) -> DataFrame:
    """account, month, n, total of the transfers that an account took part in and the condition holds for."""
    rows = sides_in_one_scan(txn.where(condition))
    return rows.groupBy("account", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def channel_map(txn: DataFrame) -> DataFrame:
    """account, channels: channel=count of all an account's channels in order of name; counts are combined before they are listed."""
    per = sides_in_one_scan(txn).groupBy("account", "channel").agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("channel", "n"))), lambda x: F.concat_ws("=", x["channel"], x["n"].cast("string")))
    return per.groupBy("account").agg(F.array_join(text, ",").alias("channels"))


def exposure(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """account, n_banks, n_cities: distinct banks and cities of an account's counterparties."""
    rows = sides_in_one_scan(txn).where("account <> other")
    bank = F.when(F.col("direction") == "out", F.col("to_bank")).otherwise(F.col("from_bank"))
    per = rows.select("account", "other", bank.alias("bank")).distinct().join(accounts.select(F.col("account").alias("other"), "city"), "other", "left")
    return per.groupBy("account").agg(F.size(F.collect_set("bank")).cast("long").alias("n_banks"), F.size(F.collect_set("city")).cast("long").alias("n_cities"))


def purposes(txn: DataFrame, column: str) -> DataFrame:
    return txn.groupBy(F.coalesce(F.col(column), F.lit("unspecified")).alias("purpose")).agg(F.count("*").alias("n"))


def last_seconds(txn: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """n, total of what came in within the last seconds."""
    recent = txn.where((F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))
    return recent.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"))


def evidence_counts(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """kind, n, accounts of the findings (kind, account) that touch a scope (account)."""
    rows = findings.join(scope.select("account").distinct(), "account", "left_semi")
    return rows.groupBy("kind", "account").agg(F.count("*").alias("k")).groupBy("kind").agg(F.sum("k").alias("n"), F.count("*").alias("accounts"))


def evidence_rows(txn: DataFrame, scope: DataFrame, limit: int = 50) -> DataFrame:
    """The newest transfers that touch a scope, `limit` of them: the report's table."""
    from tracewell.operators.sets import touching

    return touching(txn, scope.select("account").distinct()).orderBy(F.desc("ts"), F.desc("txn_id")).limit(limit)


def customer_profile(txn: DataFrame, accounts: DataFrame, expected_monthly: Column) -> DataFrame:
    """account, occupation, declared_income, months, mean_monthly, expected, variance: actual against expected volume, as per cent of it.

    Sums are decimal, so that the mean doesn't depend on their order; it is rounded to cents, halves up, before it is compared.
    """
    sums = sides_in_one_scan(txn).groupBy("account", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.col("amount").cast("decimal(28,4)")).alias("x"))
    mean = sums.groupBy("account").agg(F.count("*").alias("months"), F.sum("x").cast("decimal(26,4)").alias("x"))
    mean = mean.select("account", "months", F.round(F.col("x") / F.col("months").cast("decimal(8,0)"), 2).cast("double").alias("m"))
    rows = accounts.join(mean, "account", "left").withColumn("e", expected_monthly)
    m = F.coalesce("m", F.lit(0.0))
    cents = lambda c: F.round(c.cast("decimal(28,6)"), 2).cast("double")
    return rows.select(
        "account", "occupation", "declared_income", F.coalesce("months", F.lit(0)).alias("months"), m.alias("mean_monthly"),
        cents(F.col("e")).alias("expected"), cents(F.try_divide(100 * (m - F.col("e")), F.col("e"))).alias("variance"),
    )


def case_transfers(txn: DataFrame, members: DataFrame) -> DataFrame:
    """case_id, txn_id once for each case (members: case_id, account) that a transfer touches."""
    out = txn.select("txn_id", F.col("src").alias("account")).join(members, "account")
    inn = txn.select("txn_id", F.col("dst").alias("account")).join(members, "account")
    return out.select("case_id", "txn_id").unionByName(inn.select("case_id", "txn_id")).distinct()


def mismatches(txn: DataFrame, accounts: DataFrame, over: float = 3.0, top: int = 100) -> DataFrame:
    """account, volume, ratio of the `top` accounts whose volume is most times their income."""
    rows = account_flow(txn).select("account", F.round(F.col("inflow") + F.col("outflow"), 2).alias("volume")).join(accounts.where("declared_income > 0"), "account")
    rows = rows.withColumn("ratio", F.round(F.col("volume") / F.col("declared_income"), 4)).where(F.col("ratio") > over)
    return rows.orderBy(F.desc("ratio"), "account").limit(top).select("account", "volume", "ratio")


def pattern_edges(txn: DataFrame, findings: DataFrame, kind: str) -> DataFrame:
    """Transfers between accounts that show a kind of finding."""
    who = findings.where(F.col("kind") == kind).select("account").distinct()
    return txn.join(who.withColumnRenamed("account", "src"), "src", "left_semi").join(who.withColumnRenamed("account", "dst"), "dst", "left_semi")


def signal_digest(findings: DataFrame) -> DataFrame:
    """account, n_kinds, n, several: how many kinds of signs each account shows."""
    rows = findings.groupBy("account", "kind").agg(F.count("*").alias("k")).groupBy("account").agg(F.count("*").alias("n_kinds"), F.sum("k").alias("n"))
    return rows.withColumn("several", F.col("n_kinds") >= 2)


def upload_summary(txn: DataFrame) -> DataFrame:
    """section, name, n, total: hours, channels and the five largest accounts of an upload."""
    sums = lambda d, key, name: d.groupBy(key.cast("string").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total")).select(F.lit(name).alias("section"), "name", "n", "total")
    top = sums(sides_in_one_scan(txn), F.col("account"), "account").orderBy(F.desc("total"), "name").limit(5)
    return sums(txn, F.hour("ts"), "hour").unionByName(sums(txn, F.col("channel"), "channel")).unionByName(top)


def account_facts(txn: DataFrame, accounts: DataFrame, roles: DataFrame, scores: DataFrame) -> DataFrame:
    """account and what is known of it in one row: flows, counterparties, role, risk, city and income."""
    rows = account_flow(txn).join(roles.select("account", "role"), "account", "left").join(scores, "account", "left").join(accounts.select("account", "city", "declared_income"), "account", "left")
    return rows.select("account", "inflow", "outflow", "n", "partners", "role", F.round(F.coalesce("risk", F.lit(0.0)), 2).alias("risk"), "city", "declared_income")


def eligible_actions(findings: DataFrame) -> DataFrame:
    """account, action, because of the findings (account, kind): each action once, with the kinds that call for it.

    An action for any kind is because of all kinds that an account shows; findings without a kind call for these alone.
    """
    pairs = [(a, k) for a, kinds in ACTIONS.items() for k in kinds or [None]]
    table = F.broadcast(findings.sparkSession.createDataFrame(pairs, "action string, for_kind string"))
    rows = findings.select("account", "kind").distinct().join(table, F.col("for_kind").isNull() | (F.col("for_kind") == F.col("kind")))
    return rows.groupBy("account", "action").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("because"))


def _number(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "[,%]", "").try_cast("double")


def same_value(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Numbers within the tolerance, other values as trimmed text in any case, nulls only with nulls."""
    x, y = _number(a), _number(b)
    close = F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * tolerance, F.lit(tolerance))
    return F.when(x.isNotNull() & y.isNotNull(), close).otherwise(F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b))))


def grounding(claims: DataFrame, facts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """claim_id, accepted, reason of claims (claim_id, statement, citations array<struct<fact_key, value>>) against facts (fact_key, value).

    A claim has to cite, each citation has to name a known fact with its value, and each number stated has to be a cited one.
    """
    cited = claims.select("claim_id", F.posexplode("citations").alias("k", "c")).select("claim_id", "k", "c.fact_key", F.col("c.value").alias("said"))
    known = facts.select("fact_key", F.col("value").alias("actual"), F.lit(True).alias("known"))
    per = cited.join(known, "fact_key", "left")
    bad = F.when(F.col("known").isNull(), F.concat(F.lit("unknown fact "), "fact_key")).when(~same_value(F.col("said"), F.col("actual"), tolerance), F.concat(F.lit("misreported "), "fact_key"))
    per = per.groupBy("claim_id").agg(F.min(F.when(bad.isNotNull(), F.struct("k", bad.alias("why")))).alias("first"), F.collect_list(_number(F.col("actual"))).alias("values"))
    rows = claims.select("claim_id", quantities_in(F.col("statement")).alias("numbers")).join(per, "claim_id", "left")
    near = lambda n: F.exists("values", lambda v: F.abs(n - v) <= F.greatest(F.abs(v) * tolerance, F.lit(tolerance)))
    loose = F.filter("numbers", lambda n: ~F.coalesce(near(n), F.lit(False)))
    reason = F.when(F.col("values").isNull(), "cites no facts").when(F.col("first").isNotNull(), F.col("first.why")).when(F.size(loose) > 0, "states an ungrounded number")
    return rows.select("claim_id", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))


def egress_leaks(texts: DataFrame, known: DataFrame, shortest: int = 3) -> DataFrame:
    """text_id, leaks: names of what a text (text_id, owner, text) gives away: known values (owner, name, value) of its owner as
    substrings in any case, and shapes of national identifiers."""
    values = known.where(F.length(F.trim("value")) >= shortest)
    joined = texts.join(values, "owner").where(F.contains(F.lower("text"), F.lower(F.trim("value"))))
    literal = joined.select("text_id", "name")
    shaped = texts.select("text_id", F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), n) for n, p in SHAPES.items())))).alias("name"))
    return literal.unionByName(shaped).groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("leaks"))


def rehydrated(text: Column, names: dict[str, str]) -> Column:
    """The text with each placeholder replaced by its name, longest first, so that no placeholder is cut by a shorter one."""
    for key in sorted(names, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(key), F.lit(names[key]))
    return text


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, total, mules, top_account: the facts of an ego network (nodes: account, role, risk; edges: src, dst, amount)."""
    e = edges.agg(F.count("*").alias("n_edges"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.sum((F.col("role") == "MULE").cast("int")).alias("mules"), F.max(F.struct("risk", (-F.col("account")).alias("k"))).alias("m"))
    return n.join(e).select("n_nodes", "n_edges", "total", "mules", (-F.col("m.k")).alias("top_account"))


def governance(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, confidence, tp, fp, precision of the rules (rule, kind, confidence) by the verdicts on cases of their kind, best first."""
    from tracewell.investigation.desk import verdict_precision

    rows = rules.join(verdict_precision(cases, "kind"), "kind", "left").fillna(0, ["tp", "fp"])
    return rows.select("rule", F.round("confidence", 6).alias("confidence"), "tp", "fp", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3).alias("precision")).orderBy(F.desc("precision"), F.desc("confidence"), "rule")
