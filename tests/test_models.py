import random

from tracewell.operators import ml, scoring


def rows_of(spark, n=400):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), None if i % 50 == 0 else rng.random()) for i in range(n)]
    rows += [(n + i, 12.0 + i, -9.0, 0.5) for i in range(3)]
    return spark.createDataFrame(rows, "account int, a double, b double, c double")


def test_isolation_finds_what_lies_apart(spark):
    rows = rows_of(spark)
    got = {r.account: r.anomaly for r in ml.isolation_scores(rows, ["a", "b", "c"], trees=60, rows=128).collect()}
    assert len(got) == 403 and set(sorted(got, key=got.get)[-3:]) == {400, 401, 402} and max(got.values()) == 100.0
    again = {r.account: r.anomaly for r in ml.isolation_scores(rows.repartition(7), ["a", "b", "c"], trees=60, rows=128).collect()}
    assert again == got
    assert ml.isolation_scores(rows.limit(0), ["a", "b", "c"], trees=5).collect() == []
    assert {r.anomaly for r in ml.isolation_scores(rows.limit(5).selectExpr("account", "1.0 as a"), ["a"], trees=5).collect()} == {0.0}


def test_boosted_trees_learn_and_are_cut_by_validation(spark):
    rows = rows_of(spark)
    labels = rows.selectExpr("account", "int(coalesce(a, 0) > 0.8) as label")
    parts = rows.selectExpr("account", "case when account % 10 < 7 then 'train' when account % 10 = 7 then 'validation' else 'test' end as part")
    got = ml.fraud_scores(rows, ["a", "b", "c"], labels, parts, rounds=5).join(labels, "account").where("part = 'test'").collect()
    assert sum(r.fraud_pred == bool(r.label) for r in got) >= 0.95 * len(got) > 50
    none = ml.fraud_scores(rows, ["a"], labels.selectExpr("account", "0 as label"), parts).collect()
    assert len(none) == 403 and {(r.fraud_prob, r.fraud_pred) for r in none} == {(0.0, False)}
    assert ml.best_threshold(spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.3), (0, 0.1)], "label int, score double")) == 0.6


def test_contributions_add_up_to_the_trees_scores(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rows = rows_of(spark)
    columns = ["a", "b", "c"]
    labels = rows.selectExpr("account", "int((coalesce(a, 0) > 0.8) <> (account % 9 = 0)) as label")  # some are wrong
    parts = rows.selectExpr("account", "case when account % 10 < 7 then 'train' when account % 10 = 7 then 'validation' else 'test' end as part")
    model = ml.fraud_model(rows, columns, labels, parts, rounds=60)
    assert 1 < len(model.trees) < 60  # the validation part has stopped it
    got = {r.account: r for r in ml.contributions(rows, model).collect()}
    assert all(abs(model.base + sum(r.parts) - r.raw) < 1e-9 for r in got.values()) and len(got) == 403
    # the same rounds by Spark: their loss on the validation part is the least, and its raw scores are those of the trees
    ready = rows.join(labels, "account").join(parts, "account").where("part <> 'test'").fillna(0.0)
    ready = VectorAssembler(inputCols=columns, outputCol="v").transform(ready).withColumn("w", F.when(F.col("label") == 1, 15.0).otherwise(1.0))
    gbt = lambda n: GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", maxIter=n, maxDepth=ml.DEPTH, stepSize=ml.STEP, seed=ml.SEED).fit(ready.where("part = 'train'"))
    losses = gbt(60).evaluateEachIteration(ready.where("part = 'validation'"))
    assert min(losses) == losses[len(model.trees) - 1]
    want = {r.account: float(r.rawPrediction[1]) for r in gbt(len(model.trees)).transform(ready).collect()}
    assert all(abs(got[a].raw - x) < 1e-9 for a, x in want.items())
    # what is far above the bound is driven by its own feature
    named = scoring.explained(ml.by_feature(ml.contributions(rows, model), model), 2).collect()
    assert next(r.drivers.split(",")[0] for r in named if r.account == 402) == "a"


def test_confidence_and_priority_ladders(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(80.0, "Very Strong", 2e7, 6), (80.0, "Strong", 0.0, 1), (30.0, "Moderate", 2e6, 1), (0.0, "None", 0.0, 1), (None, None, None, None)], "r double, c string, a double, n int")
    assert [r[0] for r in rows.select(scoring.priority(F.col("r"), F.col("c"), F.col("a"), F.col("n"))).collect()] == ["P1", "P2", "P3", "P4", "P4"]
