"""Operators on the transfer graph: the edge table is the graph, and each step is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import halves_up
from tracewell.operators.asof import next_departures
from tracewell.operators.quantiles import exact_quantiles
from tracewell.operators.sharing import pairs_sharing
from tracewell.session import cut
from tracewell.sources.ledgers import sides_in_one_scan


def collapsed(txn: DataFrame) -> DataFrame:
    """One edge per ordered pair: n, total."""
    return txn.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def centrality(txn: DataFrame) -> DataFrame:
    """Share of all inflow, and product of distinct degrees over its maximum, for each account."""
    pairs = txn.select("src", "dst").distinct()
    flow = txn.groupBy(F.col("dst").alias("account")).agg(F.sum("amount").alias("inflow"))
    total = F.broadcast(txn.agg(F.sum("amount").alias("all")))
    degree = pairs.select(F.col("src").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select("dst", F.lit(0), F.lit(1)))
    degree = degree.groupBy("account").agg(F.sum("o").alias("out_partners"), F.sum("i").alias("in_partners"))
    degree = degree.withColumn("product", F.col("out_partners") * F.col("in_partners"))
    most = F.broadcast(degree.agg(F.max("product").alias("most")))
    rows = degree.join(flow, "account", "left").join(total).join(most)
    return rows.select("account", "out_partners", "in_partners", F.round(F.coalesce(F.try_divide("inflow", "all"), F.lit(0.0)), 9).alias("pagerank"), F.round(F.coalesce(F.try_divide("product", "most"), F.lit(0.0)), 9).alias("betweenness"))


def roles(txn: DataFrame) -> DataFrame:
    """SOURCE, SINK, MULE or NORMAL with a confidence, by the shares of in- and outflow against their third quartiles.

    The quartiles of all shares, rounded to five digits, are exact and found by ranges; accounts without any flow are NORMAL.
    """
    money = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0))
    flows = sides_in_one_scan(txn).groupBy("account").agg(
        F.round(money("in"), 2).alias("inflow"), F.round(money("out"), 2).alias("outflow"),
        F.sum((F.col("direction") == "in").cast("int")).alias("n_in"), F.sum((F.col("direction") == "out").cast("int")).alias("n_out"),
    )
    total = F.col("inflow") + F.col("outflow")
    share = lambda c: F.round(F.coalesce(F.try_divide(c, total), F.lit(0.0)), 5)
    flows = cut(flows.withColumns({"in_share": share("inflow"), "out_share": share("outflow")}))
    bounds = F.broadcast(exact_quantiles(flows, "in_share", {"p_in": 0.75}).join(exact_quantiles(flows, "out_share", {"p_out": 0.75})))
    source = (F.col("out_share") > F.col("p_out")) & (F.col("in_share") < 0.3)
    sink = (F.col("in_share") > F.col("p_in")) & (F.col("out_share") < 0.3)
    mule = F.col("in_share").between(0.3, 0.7) & (F.col("n_in") >= 2) & (F.col("n_out") >= 2)
    role = F.when(total == 0, "NORMAL").when(source, "SOURCE").when(sink, "SINK").when(mule, "MULE").otherwise("NORMAL")
    sure = F.when(total == 0, 0.5).when(source, F.least(F.col("out_share") * 1.2, F.lit(1.0))).when(sink, F.least(F.col("in_share") * 1.2, F.lit(1.0)))
    sure = sure.when(mule, 1 - F.abs(F.col("in_share") - 0.5)).otherwise(0.6)
    return flows.join(bounds).select("account", "inflow", "outflow", "n_in", "n_out", role.alias("role"), F.round(sure, 3).alias("confidence"))


def short_cycles(txn: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Cycles of two and three accounts, each once, starting at its least account; return_ratio = last over first leg.

    First and last leg meet at that account, where their ratio is known, so only pairs that reach min_ratio go on to the leg between.
    """
    e = collapsed(txn).where("src <> dst")
    a, b, c = (e.select(F.col("src").alias(f"s{i}"), F.col("dst").alias(f"d{i}"), F.col("total").alias(f"t{i}")) for i in (1, 2, 3))
    two = a.where("s1 < d1").join(b, (F.col("d1") == F.col("s2")) & (F.col("d2") == F.col("s1")))
    two = two.select(F.lit(2).alias("length"), F.col("s1").alias("n1"), F.col("d1").alias("n2"), F.lit(None).cast(dict(txn.dtypes)["src"]).alias("n3"), F.col("t1").alias("first"), F.col("t2").alias("last"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(0.0)), 6)
    ends = a.where("s1 < d1").join(c.where("d3 < s3"), F.col("s1") == F.col("d3")).where("d1 <> s3").withColumn("return_ratio", ratio("t1", "t3"))
    ends = ends.where(F.col("return_ratio") >= min_ratio).select("s1", "d1", "s3", "return_ratio")
    three = ends.join(b.select("s2", "d2"), (F.col("d1") == F.col("s2")) & (F.col("s3") == F.col("d2")))
    three = three.select(F.lit(3).alias("length"), F.col("s1").alias("n1"), F.col("d1").alias("n2"), F.col("s3").alias("n3"), "return_ratio")
    two = two.withColumn("return_ratio", ratio("first", "last")).where(F.col("return_ratio") >= min_ratio).drop("first", "last")
    return two.unionByName(three)


def hop_distances(txn: DataFrame, starts: list, radius: int = 2) -> DataFrame:
    """Accounts within `radius` undirected hops of the given ones, with the least number of hops."""
    spark = txn.sparkSession
    kind = dict(txn.dtypes)["src"]
    steps = txn.select("src", "dst").unionAll(txn.select("dst", "src")).distinct()
    steps = cut(steps) if radius > 1 else steps
    seen = spark.createDataFrame([(x,) for x in starts], f"account {kind}").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, radius + 1):
        edge = seen.where(F.col("hops") == hop - 1).join(steps, F.col("account") == F.col("src")).select(F.col("dst").alias("account")).distinct()
        new = edge.join(seen, "account", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(cut(new) if hop < radius else new)
    return seen


def ego_edges(txn: DataFrame, starts: list, radius: int = 2) -> DataFrame:
    """Transfers between accounts of the ego network."""
    near = hop_distances(txn, starts, radius).select("account")
    return txn.join(near.withColumnRenamed("account", "src"), "src", "left_semi").join(near.withColumnRenamed("account", "dst"), "dst", "left_semi")


def temporal_paths(txn: DataFrame, start, depth: int = 5, window_s: int = 6 * 3600, forward: bool = True) -> DataFrame:
    """Fund trail: paths of transfers from (or, backward, to) an account, all prefixes, each transfer used once a path.

    Forward, a leg leaves where the last arrived, at the same time or later; backward, it arrives where the last left, at
    the same time or earlier; a leg lies within window_s of the one before. Self-transfers are left out.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    width = window_s * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = txn.where("src <> dst").select(F.col(here).alias("here"), F.col(there).alias("there"), F.col("txn_id").cast("string").alias("id"), (t if forward else -t).alias("t"))
    legs = e.withColumn("bin", F.floor(F.col("t") / width))
    paths = e.where(F.col("here") == start).select(F.array("id").alias("trail"), F.col("there").alias("at"), "t", F.lit(1).alias("depth"))
    found = paths
    for d in range(2, depth + 1):
        bins = F.explode(F.array(F.floor(F.col("t0") / width), F.floor(F.col("t0") / width) + 1)).alias("bin")
        step = paths.select("at", F.col("t").alias("t0"), "trail").select("*", bins).join(legs.withColumnRenamed("here", "at"), ["at", "bin"])
        step = step.where((F.col("t") >= F.col("t0")) & (F.col("t") - F.col("t0") <= width) & ~F.array_contains("trail", F.col("id")))
        paths = cut(step.select(F.array_append("trail", F.col("id")).alias("trail"), F.col("there").alias("at"), "t", F.lit(d).alias("depth")))
        found = found.unionByName(paths)
    return found.select("depth", F.array_join("trail", ">").alias("trail"), F.col("at").alias("reached"))


def next_hops(txn: DataFrame, window_s: int) -> DataFrame:
    """For each transfer the earliest one that leaves its target within the window: a forward as-of merge."""
    rows = next_departures(txn, window_s).join(txn.select(F.col("txn_id").alias("of"), "amount"), "of")
    return rows.select(F.col("of").alias("txn_id"), F.col("next.id").alias("next_id"), halves_up(F.try_divide("next.amount", "amount"), 6).alias("kept_ratio"))


def shared_senders(txn: DataFrame, min_shared: int) -> DataFrame:
    """Pairs of targets that several senders have in common; a sender of very many targets isn't paired out, see sharing.pairs_sharing."""
    edges = txn.where("src <> dst").select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct()
    return pairs_sharing(edges, min_shared).select(F.col("d1").alias("dst"), F.col("d2").alias("dst2"), F.size("shared").cast("long").alias("shared"))


def graph_summary(txn: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degree of the multigraph."""
    nodes = txn.select("src").unionAll(txn.select("dst")).agg(F.countDistinct("src").alias("nodes"))
    edges = txn.agg(F.count("*").alias("edges"))
    n, m = F.col("nodes"), F.col("edges")
    return nodes.join(edges).select("nodes", "edges", F.round(F.try_divide(m.cast("double"), n * (n - 1)), 9).alias("density"), F.round(F.try_divide(2.0 * m, n), 6).alias("mean_degree"))


def top_neighbours(txn: DataFrame, k: int = 5) -> DataFrame:
    """The k largest targets of each account, ties by account."""
    order = Window.partitionBy("src").orderBy(F.desc("total"), "dst")
    return collapsed(txn).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
