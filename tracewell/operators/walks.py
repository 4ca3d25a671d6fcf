"""Graph operators that go round by round: chains, longer cycles, components, walks with restart.

Each round is a few joins and aggregations; its rows are checkpointed where a later round reads them more than once,
so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import halves_up
from tracewell.llm.common import Scratch
from tracewell.operators.asof import next_departures, transfer_chains, walked
from tracewell.operators.parts import cycle_nodes
from tracewell.session import cut, few


def greedy_chains(txn: DataFrame, window_s: int, min_hops: int = 3, max_hops: int = 20) -> DataFrame:
    """start_id, path, hops, span_s, kept_ratio (last over first amount, infinite or NaN where the first is 0) of the chains of grown_chains."""
    hops = (F.size("nodes") - 1).cast("long")
    path = F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">")
    kept = F.when(F.col("first") == 0, F.col("last") * float("inf")).otherwise(F.try_divide("last", "first"))
    return grown_chains(txn, window_s, min_hops, max_hops).select(
        "start_id", path.alias("path"), hops.alias("hops"), (F.col("span_us") / 1_000_000).cast("long").alias("span_s"), halves_up(kept, 6).alias("kept_ratio")
    )


def grown_chains(txn: DataFrame, window_s: int, min_hops: int = 3, max_hops: int = 20) -> DataFrame:
    """Chains of transfers, each followed by the earliest one that leaves its target, ties by txn_id.

    A chain begins with a transfer that is nobody's next hop, lies within window_s of it, and comes to no account
    twice. Returns start_id, nodes, span_us, first, last, total, n_less (hops that pass on less) of chains of min_hops at least.
    Self-transfers and nulls in src, dst, ts or amount are left out.
    """
    followers = next_departures(txn.where("src <> dst"), window_s).select(F.col("next.id").alias("txn_id")).distinct()
    starts = txn.select("txn_id").join(followers, "txn_id", "left_anti")
    out = walked(txn, starts, window_s, max_hops, cut).where(F.size("nodes") > min_hops)
    return out.select("start_id", "nodes", (F.element_at("times", -1) - F.col("times")[0]).alias("span_us"), "first", "last", "total", "n_less")


def used_once(txn: DataFrame, window_s: int, min_hops: int = 3, max_hops: int = 21) -> DataFrame:
    """start_id, path, hops, span_s, total of the chains of asof.transfer_chains, in which a transfer that is used begins no other chain."""
    span = F.element_at("times", -1) - F.col("times")[0]
    path = F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">")
    return transfer_chains(txn, window_s, cut, min_hops, max_hops).select(
        "start_id", path.alias("path"), (F.size("nodes") - 1).cast("long").alias("hops"), (span / 1_000_000).cast("long").alias("span_s"), F.round("total", 2).alias("total")
    )


def long_cycles(txn: DataFrame, max_length: int = 5, min_total: float | None = 0.0) -> DataFrame:
    """length, cycle (accounts joined by >) of what cycle_nodes finds in parts of any size."""
    one = cycle_nodes(txn, max_length, min_total, None)
    return one.select(F.size("nodes").cast("long").alias("length"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("cycle"))


def components(txn: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Weak components: account and the least account of its component.

    A round hooks each account to its least neighbour and follows hooks to their end, so that every tree has its least account as its
    label. Then trees are drawn together: edges within one leave the graph, and the next round has only those between trees. An account
    that none of its neighbours hooks to finds a lesser tree beside it in the next round, so two rounds halve the number of trees at least.
    """
    scratch = Scratch()
    e = scratch(txn.select("src", "dst").dropna(), "component-edges")
    labels = None
    for _ in range(max_rounds):
        ends = F.explode(F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"))))
        near = e.select(ends.alias("s")).select("s.*").groupBy("account").agg(F.min("other").alias("near"))
        hooks = _followed(near.select("account", F.least("account", "near").alias("component")))
        if labels is None:
            labels = hooks
        else:
            above = hooks.select(F.col("account").alias("component"), F.col("component").alias("top"))
            labels = cut(labels.join(above, "component", "left").select("account", F.coalesce("top", "component").alias("component")))
        known = few(hooks)
        of = lambda end: known.select(F.col("account").alias(end), F.col("component").alias(f"{end}_tree"))  # noqa: B023, E731
        between = e.join(of("src"), "src").join(of("dst"), "dst").where("src_tree <> dst_tree").select(F.col("src_tree").alias("src"), F.col("dst_tree").alias("dst"))
        e = scratch(between.distinct(), "component-edges")
        if e.isEmpty():
            scratch.drop()
            return labels
    raise RuntimeError("components did not settle")


def _followed(hooks: DataFrame) -> DataFrame:
    """account, component: the account at the end of the way along hooks (account, component), which lead to lesser accounts or itself."""
    hooks = cut(hooks)
    while True:
        above = hooks.select(F.col("account").alias("component"), F.col("component").alias("top"))
        after = cut(hooks.join(above, "component").select("account", "component", "top"))
        hooks = after.select("account", F.col("top").alias("component"))
        if after.where("component <> top").isEmpty():
            return hooks


def walk_with_restart(txn: DataFrame, start, restart: float = 0.15, rounds: int = 20) -> DataFrame:
    """Share of visits of an endless walk over the undirected multigraph that returns to `start` with chance restart.

    Power iteration in place of drawn steps: the shares are the walk's own, up to (1 - restart) ** rounds.
    Accounts beyond `rounds` hops have no row. An account unknown to the ledger keeps all restarts and nothing else.
    """
    kind = dict(txn.dtypes)["src"]
    e = txn.select("src", "dst").dropna().where("src <> dst")
    both = e.unionAll(e.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    degree = both.groupBy("src").agg(F.sum("n").alias("degree"))
    share = cut(both.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree") * (1 - restart)).alias("w")))
    home = txn.sparkSession.range(1).select(F.lit(start).cast(kind).alias("account"), F.lit(float(restart)).alias("score"))
    scores = home.withColumn("score", F.lit(1.0))
    for k in range(1, rounds + 1):
        moved = scores.join(share, F.col("account") == F.col("src")).select(F.col("dst").alias("account"), (F.col("score") * F.col("w")).alias("score"))
        scores = moved.unionAll(home).groupBy("account").agg(F.sum("score").alias("score"))
        scores = cut(scores) if k % 5 == 0 else scores
    return scores.select("account", F.round("score", 6).alias("score"))
