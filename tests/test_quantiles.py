import random

import numpy as np
import pytest

from tracewell.operators.quantiles import exact_quantiles

SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_equal_numpy(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([rng.gauss(0, 5), 3.0, 3.0, None])) for _ in range(700)] + [("c", 1, 8.0), ("d", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.g, r.h): [r[k] for k in SHARES] for r in exact_quantiles(frame, "v", SHARES, ("g", "h")).collect()}
        one = exact_quantiles(frame, "v", SHARES).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert np.allclose(got[key], np.quantile(values, list(SHARES.values())))
    assert np.allclose([one[0][k] for k in SHARES], np.quantile([v for *_, v in rows if v is not None], list(SHARES.values())))


def test_nothing(spark):
    frame = spark.createDataFrame([("a", None)], "g string, v double")
    assert exact_quantiles(frame, "v", SHARES, ("g",)).collect() == []
    assert [tuple(r) for r in exact_quantiles(frame, "v", SHARES).collect()] == [(None,) * 5]
