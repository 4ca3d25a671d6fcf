"""The rule language: eleven primitives, single conditions, and AND, OR and NOT over the accounts that they match.

A rule is a dict: rule_id, name, detection_type, severity, combinator (AND or OR) and conditions; a condition names a
primitive, with params and perhaps negate. A condition may also be a combination of its own: {"op": "AND" | "OR" | "NOT",
"conditions": [..]}. Rules compile to plans over the ledger; nothing is collected but by `dry_run`, whose report is bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import detectors, walks
from tracewell.operators.sets import complement

FOUND = "rule_id string, detection_type string, account_ids array<string>, score double, severity string, indicator string"


@dataclass(frozen=True)
class Primitive:
    """A detector as (txn, accounts, params) -> (account_ids, score, severity), its defaults, and the bounds of its parameters."""

    run: Callable[[DataFrame, DataFrame, dict], DataFrame]
    defaults: dict
    ceilings: dict = field(default_factory=dict)
    choices: dict = field(default_factory=dict)


def _alone(found: DataFrame, account: str = "account") -> DataFrame:
    return found.select(F.array(F.col(account).cast("string")).alias("account_ids"), "score", "severity")


def _split(found: DataFrame, text: Column, separator: str) -> DataFrame:
    return found.select(F.array_distinct(F.split(text, separator)).alias("account_ids"), "score", "severity")


def _cycle(txn: DataFrame, accounts: DataFrame, p: dict) -> DataFrame:
    found = detectors.round_trips(txn, walks.cycle_nodes(txn, p["max_length"], p["min_total"]))
    return _split(found.where(F.col("return_ratio") >= p["min_return_ratio"]), F.col("cycle"), ">")


def _chain(txn: DataFrame, accounts: DataFrame, p: dict) -> DataFrame:
    tight, far = int(p["time_window_minutes"] * 60), int(p["extended_window_minutes"] * 60)
    chains = walks.grown_chains(txn, tight, p["min_hops"]), walks.grown_chains(txn, far, p["extended_min_hops"])
    return _split(detectors.layering(*chains, tight, far, p["extended_min_hops"], p["decay_ratio_threshold"]), F.col("path"), ">")


def _fan(txn: DataFrame, accounts: DataFrame, p: dict) -> DataFrame:
    found = detectors.fan_degree(txn, p["window_days"], p["min_degree"], p["direction"].removeprefix("fan_"))
    return _split(found, F.concat_ws(",", F.col("account").cast("string"), "members"), ",")


def _bipartite(txn: DataFrame, accounts: DataFrame, p: dict) -> DataFrame:
    return _split(detectors.bipartite(txn, p["window_days"], p["min_side"]), F.concat_ws(",", "left", "right"), ",")


def _aggregate(txn: DataFrame, accounts: DataFrame, p: dict) -> DataFrame:
    by = {"source_account": "src", "dest_account": "dst"}[p["group_by"]]
    return _alone(detectors.group_aggregate(txn, by, p["agg"], p["field"], p["window_days"], p["value"], p["operator"]))


#: Names, defaults and ceilings of the primitives' parameters.
PRIMITIVES = {
    "cycle": Primitive(_cycle, {"max_length": 12, "min_return_ratio": 0.85, "min_total": 0.0}, {"max_length": 20}),
    "chain": Primitive(_chain, {"min_hops": 3, "time_window_minutes": 120, "extended_min_hops": 4, "extended_window_minutes": 43200, "decay_ratio_threshold": 0.5}, {"extended_window_minutes": 129_600}),
    "fan_degree": Primitive(_fan, {"direction": "fan_out", "min_degree": 3, "window_days": 30}, {"window_days": 365}, {"direction": ("fan_out", "fan_in")}),
    "bipartite_scatter_gather": Primitive(_bipartite, {"min_side": 3, "window_days": 30}, {"window_days": 365}),
    "amount_band_count": Primitive(
        lambda t, a, p: _alone(detectors.amount_band_count(t, p["lower"], p["upper"], p["min_count"], p["window_days"]), "src"),
        {"lower": 900_000.0, "upper": 1_000_000.0, "min_count": 3, "window_days": 30},
    ),
    "split_sum_threshold": Primitive(
        lambda t, a, p: _alone(detectors.split_sum(t, p["lower"], p["upper"], p["min_count"]), "src"), {"lower": 900_000.0, "upper": 1_000_000.0, "min_count": 2}
    ),
    "inactivity_then_burst": Primitive(
        lambda t, a, p: _alone(detectors.inactivity_then_burst(t, int(p["threshold_days"] * 86400), p["min_burst_txns"], p["multiplier"])),
        {"threshold_days": 180.0, "min_burst_txns": 5, "multiplier": 10.0},
    ),
    "volume_vs_declared_income_ratio": Primitive(lambda t, a, p: _alone(detectors.income_mismatch(t, a, p["ratio_threshold"])), {"ratio_threshold": 10.0}),
    "peer_zscore_deviation": Primitive(
        lambda t, a, p: _alone(detectors.peer_zscore(t, a, p["z_threshold"], p["min_peer_group_size"])), {"z_threshold": 3.0, "min_peer_group_size": 5}
    ),
    "behavioural_shift": Primitive(
        lambda t, a, p: _alone(detectors.behavioural_shift(t, a, p["shift_z_threshold"], p["min_txn_count"], p["rolling_window"])),
        {"shift_z_threshold": 3.0, "min_txn_count": 15, "rolling_window": 20}, {"rolling_window": 10_000},
    ),
    "generic_group_aggregate": Primitive(
        _aggregate, {"group_by": "source_account", "agg": "SUM", "field": "amount", "window_days": 30, "operator": ">", "value": 1_000_000.0}, {"window_days": 365},
        {"group_by": ("source_account", "dest_account"), "agg": ("SUM", "COUNT", "AVG", "MAX", "MIN"), "operator": tuple(detectors.COMPARISONS)},
    ),
}
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: The rules that are there from the start.
BUILT_IN = [
    {"rule_id": f"builtin_{i}", "name": n, "detection_type": d, "severity": s, "combinator": "AND", "conditions": [{"primitive": p, "params": {}}]}
    for i, n, d, s, p in (
        ("round_trip", "Round-Trip Circular Flow", "round_trip", "HIGH", "cycle"),
        ("layering", "Multi-Hop Layering Chain", "layering", "HIGH", "chain"),
        ("structuring_classic", "Structuring - Near-Threshold Amounts", "structuring", "HIGH", "amount_band_count"),
        ("structuring_split", "Structuring - Split Daily Total", "structuring", "HIGH", "split_sum_threshold"),
        ("dormancy", "Dormant Account Reactivation", "dormancy", "MEDIUM", "inactivity_then_burst"),
        ("income_mismatch", "Income vs. Volume Mismatch", "profile_mismatch", "MEDIUM", "volume_vs_declared_income_ratio"),
        ("peer_deviation", "Peer Group Volume Deviation", "profile_mismatch", "MEDIUM", "peer_zscore_deviation"),
        ("behavioural_shift", "Sudden Behavioural Shift", "profile_mismatch", "MEDIUM", "behavioural_shift"),
    )
]


class RuleError(ValueError):
    pass


def validate(condition: dict) -> None:
    """Raise RuleError unless the condition, rule or combination is well-formed, with known parameters within their bounds."""
    if not isinstance(condition, dict):
        raise RuleError("a condition has to be an object")
    if "primitive" not in condition:
        parts, op = condition.get("conditions"), condition.get("op", condition.get("combinator", "AND"))
        if not isinstance(parts, list) or not parts or op not in ("AND", "OR", "NOT") or op == "NOT" and len(parts) != 1:
            raise RuleError(f"bad combination: {op}")
        for p in parts:
            validate(p)
        return
    primitive = PRIMITIVES.get(condition["primitive"])
    if primitive is None:
        raise RuleError(f"unknown primitive: {condition['primitive']}")
    for name, value in condition.get("params", {}).items():
        if name not in primitive.defaults:
            raise RuleError(f"unknown parameter: {name}")
        kind = type(primitive.defaults[name])
        if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise RuleError(f"{name} has to be {kind.__name__}")
        if name in primitive.choices and value not in primitive.choices[name]:
            raise RuleError(f"{name} has to be one of {', '.join(primitive.choices[name])}")
        if kind in (int, float) and name != "value" and not 0 <= value <= primitive.ceilings.get(name, float("inf")):
            raise RuleError(f"{name} is out of bounds")


def grounded(condition: dict) -> dict:
    """The parameters that a condition runs with: defaults under those it gives."""
    return PRIMITIVES[condition["primitive"]].defaults | condition.get("params", {})


def findings(condition: dict, txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_ids, score, severity) of one primitive."""
    return PRIMITIVES[condition["primitive"]].run(txn, accounts, grounded(condition))


def matches(condition: dict, txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct accounts (as text) that a valid condition or combination matches; NOT is taken against accounts."""
    validate(condition)
    if "primitive" in condition:
        found = findings(condition, txn, accounts).select(F.explode("account_ids").alias("account")).distinct()
        return complement(_texts(accounts), found) if condition.get("negate") else found
    parts = [matches(c, txn, accounts) for c in condition["conditions"]]
    op = condition.get("op", condition.get("combinator", "AND"))
    if op == "NOT":
        return complement(_texts(accounts), parts[0])
    if op == "AND":
        return reduce(lambda a, b: a.join(b, "account", "left_semi"), parts)
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def _texts(accounts: DataFrame) -> DataFrame:
    return accounts.select(F.col("account").cast("string").alias("account"))


def _primitives(condition: dict) -> list[dict]:
    return [condition] if "primitive" in condition else [p for c in condition["conditions"] for p in _primitives(c)]


def evaluate(rule: dict, txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """The findings of a rule as FOUND.

    A single condition that isn't negated gives its detector's findings under the rule's type. Other rules give one for each
    account matched: the greatest score and severity of the findings that contributed, else 0.5 and the rule's severity.
    """
    validate(rule)
    head = F.lit(rule.get("rule_id", "")).alias("rule_id"), F.lit(rule["detection_type"]).alias("detection_type")
    conditions = rule["conditions"]
    used = ", ".join(c["primitive"] for c in _primitives(rule))
    if len(conditions) == 1 and "primitive" in conditions[0] and not conditions[0].get("negate"):
        rows = findings(conditions[0], txn, accounts)
        return rows.select(*head, "account_ids", F.round(F.col("score").cast("double"), 3).alias("score"), "severity", F.lit(used).alias("indicator"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    parts = [findings(c, txn, accounts).select(F.explode("account_ids").alias("account"), "score", rank.alias("rank")) for c in _primitives(rule)]
    best = reduce(lambda a, b: a.unionByName(b), parts).groupBy("account").agg(F.max("score").alias("score"), F.max("rank").alias("rank"))
    rows = matches(rule, txn, accounts).join(best, "account", "left")
    severity = F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int") - 1), F.lit(rule.get("severity", "MEDIUM")))
    score = F.round(F.coalesce(F.col("score").cast("double"), F.lit(0.5)), 3)
    return rows.select(*head, F.array("account").alias("account_ids"), score.alias("score"), severity.alias("severity"), F.lit(f"{rule.get('combinator', 'AND')} of {used}").alias("indicator"))


def run_all(rules: list[dict], txn: DataFrame, accounts: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(findings of all rules, the error of each that can't be planned): one bad rule doesn't stop the others."""
    out, errors = txn.sparkSession.createDataFrame([], FOUND), {}
    for rule in rules:
        try:
            out = out.unionByName(evaluate(rule, txn, accounts))
        except Exception as e:  # whatever is wrong with a rule is its own
            errors[rule.get("rule_id", "") if isinstance(rule, dict) else str(rule)] = f"{type(e).__name__}: {e}"
    return out, errors


def dry_run(rule: dict, txn: DataFrame, accounts: DataFrame, samples: int = 20, flagged: int = 50) -> dict:
    """What a rule would do: the number of accounts it matches, a few findings, and the first accounts."""
    found = evaluate(rule, txn, accounts)
    names = found.select(F.explode("account_ids").alias("account")).distinct()
    return {
        "matched_count": names.count(),
        "sample_matches": [r.asDict(recursive=True) for r in found.orderBy(F.desc("score"), "account_ids").limit(samples).collect()],
        "newly_flagged_accounts": [r.account for r in names.orderBy("account").limit(flagged).collect()],
    }


def confidence_after(confidence: float, verdicts: Column, step: float = 0.1) -> Column:
    """A rule's confidence after verdicts (array of booleans in order): each moves it a step of the way to 1 or 0, within [0.05, 0.99]."""
    towards = lambda c, good: F.greatest(F.lit(0.05), F.least(F.lit(0.99), c + step * (F.when(good, 1.0).otherwise(0.0) - c)))
    return F.aggregate(verdicts, F.lit(float(confidence)), towards)
