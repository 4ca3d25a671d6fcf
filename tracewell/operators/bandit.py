"""A linear bandit with upper confidence bounds: its state is a sum over rewarded rows, its scores are columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Features at most: the state has one sum for each pair of them.
MAX_FEATURES = 16


def linucb_state(rows: DataFrame, features: list[str], action: str, reward: str) -> DataFrame:
    """For each action the sums of x_i * x_j (i <= j) as a_i_j and of reward * x_i as b_i; a null feature or reward counts as 0."""
    if not 0 < len(features) <= MAX_FEATURES:
        raise ValueError(f"between 1 and {MAX_FEATURES} features are supported")
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    r = F.coalesce(F.col(reward).cast("double"), F.lit(0.0))
    outer = [F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"), *outer, *[F.sum(r * v).alias(f"b_{i}") for i, v in enumerate(x)])


def linucb_scores(rows: DataFrame, features: list[str], state: DataFrame, alpha: float = 1.0, max_actions: int = 1000) -> DataFrame:
    """rows with an `ucb` map: action to theta . x + alpha * sqrt(x' A^-1 x), A the identity plus the action's sums.

    One small matrix an action reaches the driver; more than max_actions are refused.
    """
    d = len(features)
    known = state.limit(max_actions + 1).collect()
    if len(known) > max_actions:
        raise ValueError(f"more than {max_actions} actions")
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    entries = []
    for s in known:
        a = np.eye(d)
        for i in range(d):
            for j in range(i, d):
                a[i, j] += s[f"a_{i}_{j}"]
                a[j, i] = a[i, j]
        inverse = np.linalg.inv(a)
        theta = inverse @ np.array([s[f"b_{i}"] for i in range(d)])
        mean = sum((F.lit(float(theta[i])) * x[i] for i in range(d)), F.lit(0.0))
        spread = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(d) for j in range(d)), F.lit(0.0))
        entries += [F.lit(str(s["action"])), mean + alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))]
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return rows.withColumn("ucb", F.create_map(*entries) if entries else empty)


#: What a verdict is worth, and the uncertainty above which a place in the queue counts as exploration.
REWARD, PENALTY = 1.0, -0.3
EXPLORING = 0.3


def _sums(d: int) -> list[str]:
    return [f"a_{i}_{j}" for i in range(d) for j in range(i, d)] + [f"b_{i}" for i in range(d)]


def _solved(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, theta) of each row of sums, the identity added to its matrix."""
    a = np.tile(np.eye(d), (len(sums), 1, 1))
    i, j = np.triu_indices(d)
    a[:, i, j] += sums[:, : len(i)]
    a[:, j, i] = a[:, i, j]
    inverse = np.linalg.inv(a)
    return inverse, np.einsum("nij,nj->ni", inverse, sums[:, len(i) :])


def learned_weights(state: DataFrame, features: list[str], keys: tuple[str, ...] = ("action",)) -> DataFrame:
    """keys, feature, weight: what each feature adds to an expected reward, for each row of a state."""
    d, kept = len(features), [state.schema[k] for k in keys]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            _, theta = _solved(rows[_sums(d)].to_numpy(float), d)
            out = rows[list(keys)].loc[rows.index.repeat(d)].reset_index(drop=True)
            yield out.assign(feature=features * len(rows), weight=theta.reshape(-1))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["feature string", "weight double"])
    return state.select(*keys, *_sums(d)).mapInPandas(solve, schema)


def ranked_by_bound(rows: DataFrame, features: list[str], verdicts: DataFrame, top: int, key: str = "account", alpha: float = 1.0) -> DataFrame:
    """place, key, expected, uncertainty, ucb, exploring of the `top` rows by upper bound, after the verdicts (features, good).

    One matrix of all verdicts reaches the driver; rows are scored by expressions. Ties in order of key.
    """
    d = len(features)
    graded = verdicts.where("good IS NOT NULL").withColumn("reward", F.when(F.col("good"), REWARD).otherwise(PENALTY)).withColumn("action", F.lit("all"))
    state = linucb_state(graded, features, "action", "reward").select(*_sums(d)).collect()
    inverse, theta = _solved(np.array(state, float) if state else np.zeros((1, len(_sums(d)))), d)
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    mean = sum((F.lit(float(theta[0, i])) * x[i] for i in range(d)), F.lit(0.0))
    spread = sum((F.lit(float(inverse[0, i, j])) * x[i] * x[j] for i in range(d) for j in range(d)), F.lit(0.0))
    unsure = alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))
    scored = rows.select(key, F.round(mean, 4).alias("expected"), F.round(unsure, 4).alias("uncertainty"), F.round(mean + unsure, 4).alias("ucb"))
    best = scored.orderBy(F.desc("ucb"), key).limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("ucb"), key))  # over `top` rows
    return best.select(place.alias("place"), key, "expected", "uncertainty", "ucb", (F.col("uncertainty") > EXPLORING).alias("exploring"))


def replayed(verdicts: DataFrame, features: list[str], order: list[str], every: int) -> DataFrame:
    """step, n_good, precision, feature, weight: what was learned after each `every` verdicts (features, good) in order, and after the last.

    A state is a sum, so no verdict waits for the one before: rows are numbered within ranges of the order, summed up by step, and
    the sums of steps are added up. Only steps meet in one task. Rows without a verdict are left out.
    """
    from tracewell.operators.aggregates import counts_below

    if every < 1:
        raise ValueError("a step has a verdict at least")
    d = len(features)
    graded = verdicts.where("good IS NOT NULL").withColumn("one", F.lit(1)).withColumn("at", F.struct(*order))
    numbered = counts_below(graded, "at", "one", "nth")
    numbered = numbered.withColumn("block", F.floor(F.col("nth") / every)).withColumn("reward", F.when(F.col("good"), REWARD).otherwise(PENALTY))
    sums = linucb_state(numbered, features, "block", "reward").withColumnRenamed("action", "block")
    good = numbered.groupBy("block").agg(F.count_if("good").alias("good"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = sums.join(good, "block").select(F.sum("n").over(upto).alias("step"), F.sum("good").over(upto).alias("n_good"), *(F.sum(c).over(upto).alias(c) for c in _sums(d)))
    weights = learned_weights(steps, features, ("step", "n_good"))
    thousandths = F.expr("(2000 * n_good + step) div (2 * step)")  # halves up, without a fraction in between
    return weights.select("step", "n_good", (thousandths / 1000).alias("precision"), "feature", F.round("weight", 4).alias("weight"))
