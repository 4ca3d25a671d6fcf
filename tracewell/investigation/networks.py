"""Networks around accounts: filtered and annotated ego graphs, network risk, subgraphs to draw, path rank, relationships between customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import keyed_hash
from tracewell.operators.graph import collapsed, ego_edges, hop_distances, roles
from tracewell.operators.names import similar_names
from tracewell.operators.quantiles import exact_quantiles
from tracewell.operators.sets import touching
from tracewell.session import cut
from tracewell.sources.ledgers import sides_in_one_scan

#: Pairs of customers of one tax number that a task makes, about.
PAIRS = 3_000_000


def filtered_ego(txn: DataFrame, centre, radius: int = 2, edge: Column | None = None, node: Column | None = None, nodes: DataFrame | None = None, direction: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an ego network: edge filters first, then nodes without an edge leave (the centre stays), then node filters
    over `nodes` (account, ..), then edges that lost an end.

    direction (in, out) holds for edges at the centre only; a self-transfer passes both. radius is four at most.
    """
    edges = ego_edges(txn, [centre], min(radius, 4))
    edges = edges.where(edge) if edge is not None else edges
    if direction:
        away, home = ("src", "dst") if direction == "out" else ("dst", "src")
        edges = edges.where((F.col(away) == centre) | (F.col(home) != centre))
    edges = cut(edges)
    kept = edges.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    if node is not None and nodes is not None:
        kept = kept.join(nodes.where(node).select("account"), "account", "left_semi")
    kind = dict(txn.dtypes)["src"]
    kept = cut(kept.unionByName(txn.sparkSession.range(1).select(F.lit(centre).cast(kind).alias("account"))).distinct())
    ends = lambda side: kept.withColumnRenamed("account", side)
    return kept, edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")


def annotated(edges: DataFrame, centre, radius: int, scores: DataFrame, reported: DataFrame) -> DataFrame:
    """account, role within the edges, risk, prior_report, hop of each node; scores (account, risk), reported (account)."""
    role = roles(edges).select("account", "role")
    hop = hop_distances(edges, [centre], radius)
    rows = role.join(scores, "account", "left").join(reported.select("account").distinct().withColumn("prior_report", F.lit(True)), "account", "left").join(hop, "account", "left")
    return rows.select("account", "role", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("prior_report", F.lit(False)).alias("prior_report"), "hops")


def network_risk(members: DataFrame, txn: DataFrame, cycles: DataFrame, reports: DataFrame, flags: DataFrame) -> DataFrame:
    """case_id, mules, reports, sanctioned, exposed, cycles, central, risk of cases (members: case_id, account).

    Roles and centrality are those within all the cases' transfers; reports (case_id, n), flags (account, sanctioned, exposed),
    cycles (case_id, n). Central: above the 75th percentile of inflow share or degree product. Parts are capped, the whole is 100 at most.
    """
    scope = members.select("account").distinct()
    inner = cut(touching(txn, scope))
    role = roles(inner).select("account", (F.col("role") == "MULE").cast("int").alias("mule"))
    flow = sides_in_one_scan(inner).groupBy("account").agg(F.sum(F.when(F.col("direction") == "in", F.col("amount")).otherwise(0.0)).alias("x"), F.sum((F.col("direction") == "in").cast("int")).alias("i"), F.sum((F.col("direction") == "out").cast("int")).alias("o"))
    flow = flow.withColumns({"x": F.round("x", 2), "d": F.col("i") * F.col("o")})
    flow = cut(flow)
    bounds = F.broadcast(exact_quantiles(flow, "x", {"px": 0.75}).join(exact_quantiles(flow, "d", {"pd": 0.75})))
    central = flow.join(bounds).select("account", ((F.col("x") > F.col("px")) | (F.col("d") > F.col("pd"))).cast("int").alias("central"))
    per = members.distinct().join(role, "account", "left").join(central, "account", "left").join(flags, "account", "left")
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c)
    rows = per.groupBy("case_id").agg(n("mule"), n("central"), n("sanctioned"), n("exposed"))
    rows = rows.join(reports.withColumnRenamed("n", "reports"), "case_id", "left").join(cycles.withColumnRenamed("n", "cycles"), "case_id", "left").fillna(0, ["reports", "cycles"])
    cap = lambda c, top: F.least(c, F.lit(top))
    risk = cap(F.col("mule") * 6, 40) + cap(F.col("reports") * 12, 30) + cap(F.col("sanctioned") * 10 + F.col("exposed") * 4, 20) + cap(F.col("cycles") * 8 + F.col("central") * 3, 20)
    return rows.select("case_id", F.col("mule").alias("mules"), "reports", "sanctioned", "exposed", "cycles", "central", cap(risk, 100).cast("double").alias("risk"))


def validation_subgraph(txn: DataFrame, centre, evidence: DataFrame, neighbours: int = 20, ceiling: int = 40) -> DataFrame:
    """account, why of the accounts that show a finding: the centre, evidence (account), and its largest direct neighbours, `ceiling` at most."""
    near = sides_in_one_scan(txn.where((F.col("src") == centre) | (F.col("dst") == centre))).where((F.col("account") == centre) & (F.col("other") != centre))
    near = near.groupBy(F.col("other").alias("account")).agg(F.max("amount").alias("x")).orderBy(F.desc("x"), "account").limit(neighbours)
    kind = dict(txn.dtypes)["src"]
    rows = txn.sparkSession.range(1).select(F.lit(centre).cast(kind).alias("account"), F.lit(0).alias("o"), F.lit(0.0).alias("x"))
    rows = rows.unionByName(evidence.select("account").distinct().select("account", F.lit(1).alias("o"), F.lit(0.0).alias("x"))).unionByName(near.select("account", F.lit(2).alias("o"), (-F.col("x")).alias("x")))
    best = rows.groupBy("account").agg(F.min(F.struct("o", "x")).alias("b"))
    names = F.array(F.lit("centre"), F.lit("evidence"), F.lit("neighbour"))
    return best.select("account", "b.o", "b.x").orderBy("o", "x", "account").limit(ceiling).select("account", F.get(names, F.col("o")).alias("why"))


def drawn_subgraph(txn: DataFrame, scores: DataFrame, top: int, each: int = 5) -> DataFrame:
    """src, dst, total of the edges to draw: from the riskiest `top` accounts to `each` of their largest targets and from as many sources."""
    first = scores.orderBy(F.desc("risk"), "account").limit(top).select("account")
    edges = cut(collapsed(txn).where("src <> dst"))
    out = edges.join(first.withColumnRenamed("account", "src"), "src", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("total"), "dst")))
    inn = edges.join(first.withColumnRenamed("account", "dst"), "dst", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("total"), "src")))
    pick = lambda d: d.where(F.col("k") <= each).select("src", "dst", "total")
    return pick(out).unionByName(pick(inn)).distinct()


def filtered_graph(txn: DataFrame, accounts: DataFrame, edge: Column | None = None, limit: int = 300) -> DataFrame:
    """txn_id, src, dst, amount of transfers between the given accounts (account), the largest `limit`."""
    rows = txn.where(edge) if edge is not None else txn
    keep = accounts.select("account").distinct()
    rows = rows.join(keep.withColumnRenamed("account", "src"), "src", "left_semi").join(keep.withColumnRenamed("account", "dst"), "dst", "left_semi")
    return rows.orderBy(F.desc("amount"), "txn_id").limit(limit).select("txn_id", "src", "dst", "amount")


def path_ranks(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """path, mean_risk, max_risk, rank of chains (nodes array) by the risk of their accounts (account, risk) and their length."""
    rows = chains.select("nodes", F.posexplode("nodes").alias("k", "account")).join(scores, "account", "left")
    rows = rows.groupBy("nodes").agg(F.avg(F.coalesce("risk", F.lit(0.0))).alias("m"), F.max(F.coalesce("risk", F.lit(0.0))).alias("x"))
    rank = F.col("m") * 0.4 + F.col("x") * 0.4 + F.least((F.size("nodes") - 1) / 10, F.lit(1.0)) * 20
    return rows.select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path"), F.round("m", 4).alias("mean_risk"), F.round("x", 4).alias("max_risk"), F.round(rank, 4).alias("rank"))


def related_customers(customers: DataFrame, key: bytes, min_ratio: float = 0.85, blocks: list[str] | None = None) -> DataFrame:
    """entity_a, entity_b, attribute, confidence, value_hash of customers (customer_id, name, tax_id) that look related.

    The same tax number: an equal join, 0.95, with the number's keyed hash; a number's customers meet in as many tasks as their pairs need. Similar names: names.similar_names, which loses none;
    blocks are columns that two related customers share, such as a city. Each pair once, the lesser first.
    """
    tax = customers.where("tax_id IS NOT NULL AND trim(tax_id) <> ''").select("customer_id", F.upper(F.trim("tax_id")).alias("t"))
    sizes = tax.groupBy("t").agg((F.count("*") * F.count("*")).alias("n"))
    tasks = min((sizes.agg(F.sum("n")).first()[0] or 0) // PAIRS + 1, 20_000)
    dealt = tax.join(sizes, "t").withColumn("parts", F.ceil(F.col("n") / PAIRS))
    a = dealt.select(F.col("customer_id").alias("entity_a"), "t", F.pmod(F.xxhash64("customer_id"), F.col("parts")).alias("part"))
    b = dealt.select(F.col("customer_id").alias("entity_b"), "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # few bytes make many pairs: the number of tasks follows pairs, and neither side is sent whole
    same = a.repartition(tasks, "t", "part").join(b.repartition(tasks, "t", "part").hint("merge"), ["t", "part"]).where("entity_a < entity_b")
    same = same.select("entity_a", "entity_b", F.lit("tax_id").alias("attribute"), F.lit(0.95).alias("confidence"), keyed_hash(F.col("t"), key).alias("value_hash"))
    pairs = similar_names(customers.select(F.col("customer_id").alias("id"), "name", *(blocks or [])), min_ratio, tuple(blocks or ()))
    like = pairs.select(F.col("id_a").alias("entity_a"), F.col("id_b").alias("entity_b"), F.lit("name").alias("attribute"), F.round("ratio", 4).alias("confidence"), F.lit(None).cast("string").alias("value_hash"))
    return same.unionByName(like)


def relationships_touching(relations: DataFrame, scope: DataFrame) -> DataFrame:
    """Relations with either end in a scope (customer_id), each once."""
    a = relations.join(scope.select(F.col("customer_id").alias("entity_a")), "entity_a", "left_semi")
    rest = relations.join(scope.select(F.col("customer_id").alias("entity_a")), "entity_a", "left_anti")
    return a.unionByName(rest.join(scope.select(F.col("customer_id").alias("entity_b")), "entity_b", "left_semi"))


def path_facts(txn: DataFrame, centre, reported: DataFrame) -> DataFrame:
    """other, direction, total, share, prior_report: what passes between an account and each neighbour, as per cent of its side."""
    near = sides_in_one_scan(txn.where(((F.col("src") == centre) | (F.col("dst") == centre)) & (F.col("src") != F.col("dst")))).where(F.col("account") == centre)
    rows = near.groupBy("other", "direction").agg(F.round(F.sum("amount"), 2).alias("total"))
    whole = F.broadcast(rows.groupBy("direction").agg(F.sum("total").alias("w")))
    rows = rows.join(whole, "direction").join(reported.select(F.col("account").alias("other")).distinct().withColumn("r", F.lit(True)), "other", "left")
    return rows.select("other", "direction", "total", F.round(F.try_divide(100 * F.col("total"), F.col("w")), 2).alias("share"), F.coalesce("r", F.lit(False)).alias("prior_report"))
