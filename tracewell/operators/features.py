"""Per-account features, pattern scores, alerts with repeatable ids, and neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut
from tracewell.sources.ledgers import sides_in_one_scan

#: Weight of each kind of finding in the pattern score.
PATTERN_WEIGHTS = {"layering": 25, "round_trip": 30, "structuring": 20, "dormancy": 20, "profile_mismatch": 15, "fan_out": 22, "fan_in": 22}


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def account_features(txn: DataFrame, accounts: DataFrame, near_low: float, near_high: float, round_to: float) -> DataFrame:
    """The 28 features of each account.

    Rows go to their account first, narrow as they are: few accounts recur within a task, and partial sums of each would be several times as
    wide. Then one grouping by account, and one by account and counterparty or day (which gives partners, mutual ones, the
    degree product and the busiest day) follow where the rows lie. A busy account streams through one task and is a row a counterparty and day there; sets hold
    channels and banks only. Totals over the ledger come from the accounts' rows.
    """
    sides = sides_in_one_scan(txn).withColumn("out", F.col("direction") == "out")
    out, inn = F.col("out"), ~F.col("out")
    amount, t = F.col("amount"), F.unix_seconds(F.col("ts").cast("timestamp"))
    one = sides.select("account", "out", "amount", "ts", "channel", "from_bank", "to_bank").repartition("account").groupBy("account").agg(
        F.sum(inn.cast("int")).alias("in_degree"), F.sum(out.cast("int")).alias("out_degree"),
        F.sum(F.when(inn, amount).otherwise(0.0)).alias("total_in_flow"), F.sum(F.when(out, amount).otherwise(0.0)).alias("total_out_flow"),
        F.avg("amount").alias("avg_txn_amount"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_txn_amount"), F.max("amount").alias("max_txn_amount"),
        F.count("*").alias("txn_count"), F.size(F.collect_set("channel")).alias("unique_channels"),
        (F.size(F.collect_set(F.when(out, F.col("to_bank")))) + F.size(F.collect_set(F.when(inn, F.col("from_bank"))))).alias("banks"),
        F.avg(F.when(out, (F.col("from_bank") != F.col("to_bank")).cast("int"))).alias("cross_bank"),
        F.sum((out & (amount >= near_low) & (amount < near_high)).cast("int")).alias("near_threshold_count"),
        (F.max(t) - F.min(t)).alias("span_s"), F.avg((F.weekday("ts") >= 5).cast("int")).alias("is_weekend_heavy"),
        F.avg(F.hour("ts").isin(23, 0, 1, 2, 3, 4).cast("int")).alias("night_txn_ratio"),
        F.avg(F.when(out, (amount % round_to == 0).cast("int"))).alias("round_number_ratio"),
    )
    dealt = sides.select("account", "other", "out", F.to_date("ts").alias("day")).repartition("account")
    either = F.explode(F.array(F.struct(F.lit(True).alias("pair"), "other", F.lit(None).cast("date").alias("day")), F.struct(F.lit(False).alias("pair"), F.lit(None).cast(dict(sides.dtypes)["other"]).alias("other"), "day")))
    counts = dealt.select("account", "out", either.alias("k")).groupBy("account", "k.pair", "k.other", "k.day")
    counts = counts.agg(F.count("*").alias("n"), F.max(out.cast("int")).alias("o"), F.max(inn.cast("int")).alias("i")).groupBy("account")
    met = lambda c: F.sum(F.when(F.col("pair"), c))
    counts = counts.agg(F.max(F.when(~F.col("pair"), F.col("n"))).alias("max_daily_txn_count"), met(F.col("o")).alias("out_partners"), met(F.col("i")).alias("in_partners"), met(F.col("o") * F.col("i")).alias("mutual"))
    f = cut(one.join(counts, "account"))
    sums = f.agg(F.sum("total_in_flow").alias("all_flow"), F.max(F.col("out_partners") * F.col("in_partners")).alias("most"))
    f = f.join(F.broadcast(sums)).join(accounts.select("account", "declared_income"), "account", "left")
    volume = F.col("total_in_flow") + F.col("total_out_flow")
    columns = {
        "in_degree": F.col("in_degree"), "out_degree": F.col("out_degree"), "total_in_flow": F.col("total_in_flow"), "total_out_flow": F.col("total_out_flow"),
        "net_flow": F.col("total_in_flow") - F.col("total_out_flow"), "pagerank": ratio(F.col("total_in_flow"), F.col("all_flow")), "betweenness": ratio(F.col("out_partners") * F.col("in_partners"), F.col("most")), "clustering_coeff": F.lit(0.0),
        "avg_txn_amount": F.col("avg_txn_amount"), "std_txn_amount": F.col("std_txn_amount"), "max_txn_amount": F.col("max_txn_amount"), "txn_count": F.col("txn_count"),
        "unique_channels": F.col("unique_channels"), "channel_entropy": ratio(F.col("unique_channels"), F.log2(F.col("txn_count") + 1)),
        "velocity_1hour": F.col("max_daily_txn_count"), "near_threshold_count": F.col("near_threshold_count"), "dormancy_days": F.floor(F.col("span_s") / 86400),
        "income_volume_ratio": ratio(F.coalesce("declared_income", F.lit(0.0)) / 12, F.when(volume == 0, F.lit(1.0)).otherwise(volume)),
        "is_weekend_heavy": F.col("is_weekend_heavy"), "night_txn_ratio": F.col("night_txn_ratio"),
        "reciprocity_ratio": ratio(F.coalesce("mutual", F.lit(0)), F.col("out_partners") + F.col("in_partners")),
        "max_daily_txn_count": F.col("max_daily_txn_count"), "round_number_ratio": F.col("round_number_ratio"),
        "temporal_regularity": ratio(F.col("span_s"), F.col("txn_count")), "new_counterparty_ratio": ratio(F.col("out_partners") + F.col("in_partners"), F.col("txn_count")),
        "geographic_dispersion": F.least(F.col("banks"), F.lit(50)) / 50, "cross_bank_ratio": F.coalesce("cross_bank", F.lit(0.5)),
        "amount_concentration": F.least(ratio(F.col("std_txn_amount"), F.col("avg_txn_amount")), F.lit(10.0)),
    }
    return f.select("account", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in columns.items()))


def risk_bucket(score: Column) -> Column:
    return F.when(score >= 76, "CRITICAL").when(score >= 51, "HIGH").when(score >= 26, "MEDIUM").otherwise("LOW")


def pattern_scores(findings: DataFrame) -> DataFrame:
    """account, kinds, pattern_score, bucket from (account, kind): distinct kinds weighted, 100 at most."""
    weight = F.create_map(*(F.lit(x) for p in PATTERN_WEIGHTS.items() for x in p))
    kinds = findings.select("account", "kind").distinct().withColumn("w", F.coalesce(weight[F.col("kind")], F.lit(10)))
    rows = kinds.groupBy("account").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.least(F.sum("w"), F.lit(100)).alias("total"))
    score = F.round(F.col("total") * 0.55, 2)
    return rows.select("account", "kinds", score.alias("pattern_score"), risk_bucket(score).alias("bucket"))


def alerts(findings: DataFrame) -> DataFrame:
    """alert_id, account, kind, day, score: one per account, kind and day; ids repeat on every run."""
    rows = findings.groupBy("account", "kind", "day").agg(F.max("score").alias("score"))
    key = F.concat_ws("-", F.col("account").cast("string"), "kind", F.col("day").cast("string"))
    return rows.select(F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))).alias("alert_id"), "account", "kind", "day", F.round("score", 6).alias("score"))


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """Rows (ids, sizes, vectors) of up to `size` vectors each, ids and vectors packed one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = [np.array([np.nan if x is None else x for x in v], np.float64) for v in part.column("v").to_pylist()]
                packed = part.column("id").to_numpy(zero_copy_only=False).tobytes(), np.array([len(r) for r in rows], np.int64).tobytes(), np.concatenate(rows).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["ids", "sizes", "vectors"])

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(vector_col).cast("array<double>"), F.expr("array(cast(null as double))")).alias("v"))
    return rows.mapInArrow(pack, "ids binary, sizes binary, vectors binary")


def _unpacked(ids: bytes, sizes: bytes, vectors: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a block for each length of vector in it."""
    ids, sizes, flat = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(vectors, np.float64)
    begin = np.cumsum(sizes) - sizes
    return {int(n): (ids[sizes == n], flat[begin[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded cosines of all rows of x and y; 0 where a norm is 0 or a number is missing."""
    with np.errstate(all="ignore"):
        c = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)))
    c[~np.isfinite(c)] = 0.0
    return np.sign(c) * np.floor(np.abs(c) * 1e4 + 0.5) / 1e4 + 0.0


def similar_to_each(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10, block: int = 4096) -> DataFrame:
    """For each row of queries the `top` rows of vectors most alike by cosine: query_id, vec_id, cosine.

    Cosine is 0 where a norm is 0, a vector is missing or lengths differ; ties by id; rows of the query's own id and
    rows without an id are left out. Blocks of queries meet blocks of vectors, so no pair is a row but the best of two
    blocks, cut to `top` a query before and after the shuffle. Work grows with queries times vectors.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                here, there = _unpacked(row["q_ids"], row["q_sizes"], row["q_vectors"]), _unpacked(row["ids"], row["sizes"], row["vectors"])
                ids = np.concatenate([i for i, _ in there.values()])
                order = np.argsort(ids, kind="stable")
                for n, (of, x) in here.items():
                    for a in range(0, len(of), 256):
                        part = x[a : a + 256]
                        c = np.concatenate([_cosines(part, y) if m == n else np.zeros((len(part), len(y))) for m, (_, y) in there.items()], axis=1)[:, order]
                        c[of[a : a + 256, None] == ids[order]] = -np.inf
                        place = np.argsort(-c, axis=1, kind="stable")[:, :top]
                        score = np.take_along_axis(c, place, 1)
                        keep = np.isfinite(score)
                        arrays = np.repeat(of[a : a + 256], keep.sum(1)), ids[order][place][keep], score[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["query_id", "id", "cosine"])

    left = _blocks(queries, id_col, vector_col, 1024).select(F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("vectors").alias("q_vectors"))
    pairs = left.crossJoin(_blocks(vectors, id_col, vector_col, block)).mapInArrow(best, "query_id long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return pairs.withColumn("place", place).where(F.col("place") <= top).select("query_id", F.col("id").alias(id_col), "cosine")


def similar_rows(vectors: DataFrame, query_id: int, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10) -> DataFrame:
    """The rows most alike to one by cosine; 0 where a norm is 0, ties by id."""
    one = F.broadcast(vectors.where(F.col(id_col) == query_id).select(F.col(vector_col).alias("q")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = ratio(dot(vector_col, "q"), F.sqrt(dot(vector_col, vector_col)) * F.sqrt(dot("q", "q")))
    rows = vectors.where(F.col(id_col) != query_id).join(one).select(id_col, F.round(cosine, 4).alias("cosine"))
    return rows.orderBy(F.desc("cosine"), id_col).limit(top)
