"""Models over account features: isolation trees grown on a bounded sample, boosted trees with a threshold from validation.

Features are a wide table, one double column each; nulls count as 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import cut, shared_folder

#: Trees, and rows of the sample that each grows on: the sample is all that reaches the driver, TREES * ROWS at most.
TREES, ROWS, SEED = 200, 256, 42


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list) -> int:
    """Append the nodes of a random tree over x to out as (column, cut, left, right, size); the root's place."""
    at = len(out)
    out.append((-1, 0.0, -1, -1, len(x)))
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else np.zeros(0, int)
    if depth >= limit or not len(spread):
        return at
    column = int(rng.choice(spread))
    value = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    under = x[:, column] < value
    if not under.any() or under.all():
        return at
    left, right = _grow(x[under], rng, depth + 1, limit, out), _grow(x[~under], rng, depth + 1, limit, out)
    out[at] = (column, value, left, right, len(x))
    return at


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n."""
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def isolation_scores(features: DataFrame, columns: list[str], key: str = "account", trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """key, anomaly (0 to 100, most isolated highest) of every row.

    The sample is the rows of the least hash of key and seed, so it doesn't depend on how rows are dealt; trees are a few
    hundred numbers each and are broadcast; every row is scored where it lies, and scores are scaled by their range.
    """
    table = features.select(F.col(key).alias("key"), *_values(columns))
    sample = table.withColumn("h", F.xxhash64(F.lit(seed), F.col("key").cast("string"))).orderBy("h", F.col("key").cast("string")).limit(trees * rows).drop("h", "key").collect()
    data, rng = np.array([tuple(r) for r in sample], np.float64).reshape(-1, len(columns)), np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(rows, 2))))
    forest = []
    for _ in range(trees if len(data) else 0):
        nodes: list = []
        own = data[rng.choice(len(data), min(rows, len(data)), replace=False)]
        _grow(own, rng, 0, limit, nodes)
        forest.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    norm = float(_mean_path(np.array([min(rows, max(len(data), 1))], float))[0]) or 1.0
    shared = features.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) if batch.num_rows else np.zeros((0, len(columns)))
            total = np.zeros(len(x))
            for column, value, left, right, size in shared.value:
                at, depth = np.zeros(len(x), int), np.zeros(len(x))
                while True:
                    inner = np.flatnonzero(column[at] >= 0)
                    if not len(inner):
                        break
                    node = at[inner]
                    at[inner] = np.where(x[inner, column[node]] < value[node], left[node], right[node])
                    depth[inner] += 1
                total += depth + _mean_path(size[at].astype(float))
            raw = 2 ** (-total / max(len(shared.value), 1) / norm)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(raw)], ["key", "raw"])

    kind = dict(table.dtypes)["key"]
    scored = cut(table.mapInArrow(score, f"key {kind}, raw double"))
    bounds = F.broadcast(scored.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))
    scaled = F.coalesce(F.try_divide(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 100
    return scored.join(bounds).select(F.col("key").alias(key), F.round(scaled, 4).alias("anomaly"))


def best_threshold(scored: DataFrame) -> float:
    """The score from which on a row counts as positive, for the greatest F1 on (label, score); 0.5 without positives.

    Scores are rounded to four digits, so the sums run over 10,001 values at most.
    """
    counts = scored.groupBy(F.round("score", 4).alias("s")).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    above = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("s", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("k"), F.sum("p").over(Window.partitionBy(F.lit(0))).alias("all"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("k") + F.col("all"))
    best = sums.where("all > 0").orderBy(F.desc(f1), F.desc("s")).limit(1).collect()
    return float(best[0].s) if best else 0.5


#: Boosting rounds, depth and step of the boosted trees; rounds after the one that serves the validation part best are taken away.
ROUNDS, DEPTH, STEP = 100, 4, 0.1


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as arrays of nodes (column, cut, left, right, value), each value times the tree's weight; value is the mean at inner nodes too."""

    columns: tuple[str, ...]
    trees: tuple[tuple[np.ndarray, ...], ...]
    threshold: float

    @property
    def base(self) -> float:
        """The raw score before any feature is looked at: the sum of the roots' values."""
        return float(sum(value[0] for *_, value in self.trees))


def _values(columns: tuple[str, ...] | list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]


def _trees_of(spark: SparkSession, model) -> tuple[tuple[np.ndarray, ...], ...]:
    """The model's nodes, a few thousand rows, read from the tables that Spark saves it as."""
    folder = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    weights = {r.treeID: r.weights for r in spark.read.parquet(f"{folder}/treesMetadata").toDF("treeID", "metadata", "weights").collect()}
    trees = []
    for k in sorted(weights):
        own = sorted((r for r in nodes if r.treeID == k), key=lambda r: r.id)
        place = {r.id: i for i, r in enumerate(own)}
        inner = [r.leftChild >= 0 for r in own]
        trees.append((
            np.array([r.split.featureIndex if x else -1 for r, x in zip(own, inner, strict=True)]), np.array([r.split.leftCategoriesOrThreshold[0] if x else 0.0 for r, x in zip(own, inner, strict=True)]),
            np.array([place[r.leftChild] if x else -1 for r, x in zip(own, inner, strict=True)]), np.array([place[r.rightChild] if x else -1 for r, x in zip(own, inner, strict=True)]),
            np.array([r.prediction for r in own]) * weights[k],
        ))
    return tuple(trees)


def fraud_model(
    features: DataFrame, columns: list[str], labels: DataFrame, parts: DataFrame, key: str = "account", rounds: int = ROUNDS, weight: float = 15.0
) -> BoostedTrees | float:
    """Boosted trees trained on the earliest accounts, stopped by the next ones, and cut by these at the threshold of the best F1.

    Spark's own early stop has no patience, it ends at the first round without gain; so all rounds are made, and of those the
    first ones stay that have the least loss on the validation part.
    labels: (key, label), parts: (key, part) as scoring.temporal_split gives them. Positives count `weight` times. Without
    both labels in the training part there is no model but the share of positives.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features.join(labels, key).join(parts, key).where("part <> 'test'")
    rows = rows.select(key, (F.col("part") == "validation").alias("later"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, weight).otherwise(1.0).alias("w"), *_values(columns))
    rows = cut(VectorAssembler(inputCols=columns, outputCol="v").transform(rows).select(key, "later", "label", "w", "v"))
    stats = rows.groupBy("later").agg(F.countDistinct("label").alias("k"), F.avg("label").alias("share")).collect()
    of = {r.later: r for r in stats}
    if False not in of or of[False].k < 2:
        return float(of[False].share) if False in of else 0.0
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", maxIter=rounds, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(rows.where("not later"))
    trees = _trees_of(features.sparkSession, model)
    if True in of:
        losses = model.evaluateEachIteration(rows.where("later"))
        trees = trees[: int(np.argmin(losses)) + 1]
    kept = BoostedTrees(tuple(columns), trees, 0.5)
    later = features.join(labels, key).join(parts, key).where("part = 'validation'")
    scored = contributions(later, kept, key).join(labels, key).select("label", probability(F.col("raw")).alias("score"))
    return replace(kept, threshold=best_threshold(scored))


def probability(raw: Column) -> Column:
    """The trees' raw score as a probability."""
    return 1 / (1 + F.exp(-2 * raw))


def contributions(features: DataFrame, model: BoostedTrees, key: str = "account") -> DataFrame:
    """key, raw (the trees' score), parts: what each of the model's columns adds to it; model.base and the parts add up to raw.

    On its way down a tree a row's expected value changes at each node; the change counts for the node's column. Trees are a
    few thousand numbers, which are broadcast.
    """
    shared = features.sparkSession.sparkContext.broadcast(model)
    columns = list(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, base = shared.value.trees, shared.value.base
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) if n else np.zeros((0, len(columns)))
            added = np.zeros((n, len(columns)))
            for column, cutoff, left, right, value in trees:
                at = np.zeros(n, int)
                while len(inner := np.flatnonzero(column[at] >= 0)):
                    node = at[inner]
                    then = np.where(x[inner, column[node]] <= cutoff[node], left[node], right[node])
                    np.add.at(added, (inner, column[node]), value[then] - value[node])
                    at[inner] = then
            offsets = pa.array(np.arange(0, n * len(columns) + 1, max(len(columns), 1)), pa.int32())
            parts = pa.ListArray.from_arrays(offsets, pa.array(added.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(base + added.sum(1)), parts], ["key", "raw", "parts"])

    table = features.select(F.col(key).alias("key"), *_values(columns))
    out = table.mapInArrow(run, f"key {dict(table.dtypes)['key']}, raw double, parts array<double>")
    return out.withColumnRenamed("key", key)


def by_feature(parts: DataFrame, model: BoostedTrees, key: str = "account") -> DataFrame:
    """key, feature, value of contributions(), without those that add nothing."""
    named = F.arrays_zip(F.array(*map(F.lit, model.columns)).alias("feature"), F.col("parts").alias("value"))
    return parts.select(key, F.explode(named).alias("x")).select(key, "x.feature", "x.value").where("value <> 0")


def fraud_scores(features: DataFrame, columns: list[str], labels: DataFrame, parts: DataFrame, key: str = "account", rounds: int = ROUNDS, weight: float = 15.0) -> DataFrame:
    """key, part, fraud_prob, fraud_pred of every labelled row by fraud_model; where there is none, the share of positives and false."""
    model = fraud_model(features, columns, labels, parts, key, rounds, weight)
    rows = features.join(parts, key).join(labels.select(key), key)
    if isinstance(model, float):
        return rows.select(key, "part", F.lit(model).alias("fraud_prob"), F.lit(False).alias("fraud_pred"))
    scored = contributions(rows, model, key).withColumn("p", probability(F.col("raw")))
    scored = scored.select(key, F.round("p", 6).alias("fraud_prob"), (F.round("p", 4) >= model.threshold).alias("fraud_pred"))
    return scored.join(parts, key).select(key, "part", "fraud_prob", "fraud_pred")
