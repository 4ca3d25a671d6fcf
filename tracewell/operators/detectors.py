"""Pattern detectors over a ledger. Each returns one row per finding with its score; all thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sharing import pairs_sharing
from tracewell.session import cut
from tracewell.sources.ledgers import sides_in_one_scan


def _clip(score):
    return F.least(F.lit(1.0), score)


def amount_band_count(txn: DataFrame, lower: float, upper: float, min_count: int = 3, days: int = 30) -> DataFrame:
    """Structuring: several amounts just under a limit in one bin of days, bins counted from the earliest such day."""
    band = txn.where((F.col("amount") >= lower) & (F.col("amount") < upper))
    origin = F.broadcast(band.agg(F.min(F.to_date("ts")).alias("origin")))
    bin_ = F.floor(F.datediff(F.to_date("ts"), "origin") / days)
    hits = band.join(origin).groupBy("src", bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    score = _clip(F.col("n") / 10 * 0.5 + F.col("total") / (5 * upper) * 0.5)
    severity = F.when(F.col("n") >= 5, "CRITICAL").otherwise("HIGH")
    return hits.where(F.col("n") >= min_count).select("src", "bin", "n", F.round("total", 2).alias("total"), F.round(score, 6).alias("score"), severity.alias("severity"))


def split_sum(txn: DataFrame, lower: float, upper: float, min_count: int = 2) -> DataFrame:
    """Structuring: a day's transfers of one account that add up to just under a limit."""
    days = txn.groupBy("src", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
    hits = days.where((F.col("n") >= min_count) & (F.col("total") >= lower) & (F.col("total") < upper))
    score = F.round(_clip(0.3 + F.col("n") / 10 * 0.4 + F.col("total") / upper * 0.3), 6)
    return hits.withColumns({"score": score, "severity": F.lit("HIGH")})


def structuring(txn: DataFrame, lower: float, upper: float, min_count: int = 3, days: int = 30, split_count: int = 2) -> DataFrame:
    """Both forms of structuring, the best finding of each account: account, form, n, total, score, severity; ties by form and total."""
    band = amount_band_count(txn, lower, upper, min_count, days).select(F.col("src").alias("account"), F.lit("band").alias("form"), "n", "total", "score", "severity")
    split = split_sum(txn, lower, upper, split_count).select(F.col("src").alias("account"), F.lit("split").alias("form"), "n", "total", "score", "severity")
    best = band.unionByName(split).groupBy("account").agg(F.max(F.struct("score", (F.col("form") == "band").alias("first"), "total", "n", "form", "severity")).alias("b"))
    return best.select("account", "b.form", "b.n", "b.total", "b.score", "b.severity")


def inactivity_then_burst(txn: DataFrame, min_gap_s: int, min_after: int = 5, min_ratio: float = 10.0, unit: float = 5_000_000.0) -> DataFrame:
    """Dormancy: the longest pause of an account, and how the mean amount after it compares with that before.

    Accounts of over min_after transfers; a mean of 0 before the pause counts as a ratio of min_ratio + 1, unless it is
    that of a single transfer. unit: the amount after the pause that gives its whole part of the score.
    """
    order = Window.partitionBy("account").orderBy("ts", "txn_id", "direction")
    rows = sides_in_one_scan(txn).withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(order), F.lit(0))).withColumn("nth", F.row_number().over(order))
    gaps = rows.groupBy("account").agg(F.count("*").alias("rows"), F.max(F.struct("gap", (-F.col("nth")).alias("k"))).alias("g"))
    gaps = gaps.where((F.col("rows") > min_after) & (F.col("g.gap") >= min_gap_s)).select("account", F.col("g.gap").alias("gap_s"), (-F.col("g.k")).alias("at"))
    after = F.col("nth") >= F.col("at")
    stats = rows.join(gaps, "account").groupBy("account", "gap_s").agg(
        F.sum(after.cast("int")).alias("n_after"), F.sum((~after).cast("int")).alias("n_before"), F.sum(F.when(after, F.col("amount")).otherwise(0.0)).alias("total"),
        F.avg(F.when(after, F.col("amount"))).alias("mean_after"), F.coalesce(F.avg(F.when(~after, F.col("amount"))), F.lit(0.0)).alias("mean_before"),
    )
    days = F.col("gap_s") / 86400
    ratio = F.when(F.col("mean_before") > 0, F.try_divide("mean_after", "mean_before")).otherwise(min_ratio + 1)
    score = _clip(F.least(days / 365, F.lit(0.3)) + F.least(ratio / 50, F.lit(0.4)) + F.least(F.col("total") / unit, F.lit(0.3)))
    severity = F.when((days > 365) & (ratio > 20), "CRITICAL").when(days > 180, "HIGH").otherwise("MEDIUM")
    hits = stats.where((F.col("n_after") >= min_after) & ((F.col("mean_before") != 0) | (F.col("n_before") >= 2)) & (ratio >= min_ratio))
    return hits.select("account", "gap_s", "n_after", F.round(ratio, 6).alias("ratio"), F.round(score, 6).alias("score"), severity.alias("severity"))


def best_windows(txn: DataFrame, days: float, min_others: int, side: str = "out") -> DataFrame:
    """account, others, t: the earliest window of days that starts at one of an account's transfers and has most counterparties.

    A transfer counts for the windows that start after the one before it to the same counterparty, up to itself: an
    interval of starts. How many intervals cover a start is a running sum of their ends, so no set is gathered.
    """
    me, other = ("src", "dst") if side == "out" else ("dst", "src")
    rows = txn.select(F.col(me).alias("account"), F.col(other).alias("other"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).dropna()
    able = rows.select("account", "other").distinct().groupBy("account").agg(F.count("*").alias("k")).where(F.col("k") >= min_others).select("account")
    rows = rows.join(able, "account", "left_semi")
    before = F.lag("t").over(Window.partitionBy("account", "other").orderBy("t"))
    spans = rows.withColumn("low", F.greatest(before + 1, F.col("t") - int(days * 86_400_000_000))).where("low <= t")
    moves = F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("d"), F.lit(False).alias("start")), F.struct((F.col("t") + 1).alias("at"), F.lit(-1).alias("d"), F.lit(False).alias("start")), F.struct(F.col("t").alias("at"), F.lit(0).alias("d"), F.lit(True).alias("start"))))
    sums = spans.select("account", moves.alias("m")).select("account", "m.*")
    upto = Window.partitionBy("account").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("others", F.sum("d").over(upto)).where("start")
    best = sums.groupBy("account").agg(F.max(F.struct("others", (-F.col("at")).alias("k"))).alias("b")).where(F.col("b.others") >= min_others)
    return best.select("account", F.col("b.others").alias("others"), (-F.col("b.k")).alias("t"))


def fan_degree(txn: DataFrame, days: float, min_others: int, side: str = "out", unit: float = 10_000_000.0, keep: int = 30) -> DataFrame:
    """Most distinct counterparties of an account in any window of days that starts at one of its transfers.

    Returns account, others, starts, span_days, total, members (the first `keep` counterparties in time order), score and
    severity. Rows without a time or a side are left out.
    """
    me, other = ("src", "dst") if side == "out" else ("dst", "src")
    inside = _window_rows(txn, best_windows(txn, days, min_others, side), days, me, other)
    first = inside.groupBy("account", "other").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("amount").alias("total"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("account").orderBy("first", "other")))
    members = F.array_sort(F.collect_list(F.when(F.col("place") <= keep, F.struct("place", "other"))))
    hubs = first.groupBy("account").agg(F.count("*").alias("others"), F.min("first").alias("starts"), F.max("last").alias("last"), F.sum("total").alias("total"), members.alias("m"))
    span = (F.col("last") - F.col("starts")) / 86_400_000_000
    score = F.least((F.col("others") - min_others) / 12, F.lit(1.0)) * 0.4 + F.least(F.col("total") / unit, F.lit(1.0)) * 0.3 + F.greatest(F.lit(0.0), 1 - span / days) * 0.3
    severity = F.when(F.col("others") >= 10, "CRITICAL").when(F.col("others") >= 6, "HIGH").otherwise("MEDIUM")
    names = F.array_join(F.transform("m", lambda x: x["other"].cast("string")), ",")
    return hubs.select(
        "account", "others", F.timestamp_micros("starts").alias("starts"), F.round(span, 6).alias("span_days"), F.round("total", 2).alias("total"),
        names.alias("members"), F.round(_clip(score), 6).alias("score"), severity.alias("severity"),
    )


def _window_rows(txn: DataFrame, windows: DataFrame, days: float, me: str, other: str) -> DataFrame:
    """account, other, t, amount of the transfers in each account's window."""
    rows = txn.select(F.col(me).alias("account"), F.col(other).alias("other"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "amount").where("other IS NOT NULL")
    inside = (F.col("t") >= F.col("from_t")) & (F.col("t") <= F.col("from_t") + int(days * 86_400_000_000))
    return rows.join(windows.select("account", F.col("t").alias("from_t")), "account").where(inside).drop("from_t")


def bipartite(txn: DataFrame, days: float, min_side: int = 3, unit: float = 5_000_000.0) -> DataFrame:
    """Scatter-gather: pairs of receivers that share min_side senders in their best windows, with all that share two of these.

    One row for each set of shared senders and the two receivers: left, right (accounts joined by commas), their numbers,
    total, score, severity. Senders of a single receiver leave before receivers are paired.
    """
    windows = cut(best_windows(txn, days, min_side, "in"))
    sends = _window_rows(txn, windows, days, "dst", "src").select(F.col("account").alias("d"), F.col("other").alias("s")).distinct()
    several = sends.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    sends = cut(sends.join(several, "s", "left_semi"))
    pairs = pairs_sharing(sends, min_side)
    pairs = pairs.withColumn("key", F.array_sort(F.array_distinct(F.concat("shared", F.array("d1", "d2")))))
    groups = pairs.groupBy("key").agg(F.min(F.struct("d1", "d2", "shared")).alias("p")).select(F.monotonically_increasing_id().alias("g"), F.col("p.shared").alias("shared"))
    groups = cut(groups)
    lefts = groups.select("g", F.explode("shared").alias("s"))
    rights = lefts.join(sends, "s").groupBy("g", "d").agg(F.count("*").alias("k")).where("k >= 2")
    money = txn.groupBy(F.col("src").alias("s"), F.col("dst").alias("d")).agg(F.sum("amount").alias("amount"))
    totals = lefts.join(rights.select("g", "d"), "g").join(money, ["s", "d"], "left").groupBy("g").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    right = rights.groupBy("g").agg(F.array_sort(F.collect_list("d")).alias("right")).where(F.size("right") >= 2)
    left_n, right_n = F.size("shared"), F.size("right")
    score = F.least(left_n / 8, F.lit(0.4)) + F.least(right_n / 8, F.lit(0.3)) + F.least(F.col("total") / unit, F.lit(0.3))
    severity = F.when((left_n >= 5) & (right_n >= 5), "CRITICAL").when((left_n >= 3) & (right_n >= 3), "HIGH").otherwise("MEDIUM")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return groups.join(right, "g").join(totals, "g").select(
        joined("shared").alias("left"), joined("right").alias("right"), left_n.cast("long").alias("n_left"), right_n.cast("long").alias("n_right"),
        F.round("total", 2).alias("total"), F.round(_clip(score), 6).alias("score"), severity.alias("severity"),
    )


def income_mismatch(txn: DataFrame, accounts: DataFrame, min_ratio: float = 10.0) -> DataFrame:
    """Accounts whose volume is many times their declared income."""
    volume = sides_in_one_scan(txn).groupBy("account").agg(F.round(F.sum("amount"), 2).alias("volume"))
    rows = volume.join(accounts.where("declared_income > 0"), "account")
    ratio = F.col("volume") / F.greatest("declared_income", F.lit(1.0))
    score = _clip(F.least(ratio / 100, F.lit(0.5)) + 0.3 + F.least(F.col("volume") / 1e7, F.lit(0.2)))
    severity = F.when(ratio > 50, "CRITICAL").when(ratio > 20, "HIGH").otherwise("MEDIUM")
    return rows.where(ratio > min_ratio).select("account", "volume", F.round(ratio, 6).alias("ratio"), F.round(score, 6).alias("score"), severity.alias("severity"))


def peer_zscore(txn: DataFrame, accounts: DataFrame, min_z: float = 3.0, min_peers: int = 5) -> DataFrame:
    """Accounts whose volume stands out among those of the same occupation and income bracket.

    An account without transfers counts with volume 0; null peers never match.
    """
    volume = sides_in_one_scan(txn).groupBy("account").agg(F.sum("amount").alias("volume"))
    rows = accounts.where("occupation IS NOT NULL AND income_bracket IS NOT NULL").select("account", "occupation", "income_bracket")
    rows = rows.join(volume, "account", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    peers = rows.groupBy("occupation", "income_bracket").agg(F.avg("volume").alias("mean"), F.stddev_samp("volume").alias("sd"), F.count("*").alias("n"))
    peers = F.broadcast(peers.where((F.col("n") >= min_peers) & F.col("sd").isNotNull()))  # a row for each pair of labels
    z = (F.col("volume") - F.col("mean")) / F.greatest("sd", F.lit(1.0))
    rows = rows.join(peers, ["occupation", "income_bracket"]).withColumn("z", z).where(F.abs("z") > min_z)
    score = _clip(F.abs("z") / 10 * 0.6 + 0.2)
    severity = F.when(F.abs("z") > 5, "CRITICAL").when(F.abs("z") > 3, "HIGH").otherwise("MEDIUM")
    return rows.select("account", "occupation", "income_bracket", F.round("z", 6).alias("z"), F.round(score, 6).alias("score"), severity.alias("severity"))


def behavioural_shift(txn: DataFrame, accounts: DataFrame, min_z: float = 3.0, min_txns: int = 15, rows: int = 20, min_rows: int = 5) -> DataFrame:
    """The transfer of each account, of either side, that lies furthest above the mean of its last `rows` transfers.

    Only accounts with a declared income and min_txns transfers; order and ties by (ts, txn_id, direction).
    """
    order = Window.partitionBy("account").orderBy("ts", "txn_id", "direction")
    last = order.rowsBetween(1 - rows, 0)
    seen = sides_in_one_scan(txn).join(accounts.where("declared_income > 0").select("account"), "account", "left_semi")
    seen = seen.select(
        "account", "txn_id", "direction", "amount", F.avg("amount").over(last).alias("mean"), F.stddev_samp("amount").over(last).alias("sd"),
        F.count("*").over(last).alias("n"), F.count("*").over(Window.partitionBy("account")).alias("all"), F.row_number().over(order).alias("nth"),
    )
    seen = seen.where((F.col("all") >= min_txns) & (F.col("n") >= min_rows) & F.col("sd").isNotNull()).withColumn("z", (F.col("amount") - F.col("mean")) / F.greatest("sd", F.lit(1.0)))
    best = seen.where(F.col("z") > min_z).groupBy("account").agg(F.max(F.struct("z", (-F.col("nth")).alias("k"), "txn_id", "amount")).alias("b"))
    score = _clip(F.col("b.z") / 10 * 0.5 + 0.2)
    severity = F.when(F.col("b.z") > 5, "HIGH").otherwise("MEDIUM")
    return best.select("account", F.round("b.z", 6).alias("z"), "b.txn_id", F.round("b.amount", 2).alias("amount"), F.round(score, 6).alias("score"), severity.alias("severity"))


#: Comparisons that a group's value can be held to.
COMPARISONS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__"}


def group_aggregate(txn: DataFrame, by: str, function: str, field: str, days: int, value: float, comparison: str = ">=") -> DataFrame:
    """SUM, COUNT, AVG, MAX or MIN of a field per group over the trailing days, held to a value; rows without a time are left out."""
    ends = F.broadcast(txn.agg(F.max("ts").alias("last")))
    recent = txn.join(ends).where(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS"))
    of = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MAX": F.max, "MIN": F.min}[function](field)
    rows = recent.groupBy(by).agg(F.round(of.cast("double"), 4).alias("value"))
    rows = rows.where(getattr(F.col("value"), COMPARISONS[comparison])(value))
    score = _clip(0.5 + F.least(F.abs(F.col("value") - value) / max(abs(value), 1.0), F.lit(0.5)))
    return rows.select(F.col(by).alias("account"), "value", F.round(score, 6).alias("score"), F.lit("MEDIUM").alias("severity"))


def gap_then_burst(txn: DataFrame, min_gap_s: int, within: str, min_burst: int = 3) -> DataFrame:
    """Every pause of an account that is followed by several transfers in a short time."""
    rows = sides_in_one_scan(txn).withColumn("t", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("account").orderBy("t", "txn_id", "direction")
    rows = rows.withColumn("gap_s", F.unix_seconds("t") - F.unix_seconds(F.lag("t").over(order)))
    burst = F.expr(f"count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL {within} FOLLOWING)")
    rows = rows.withColumn("burst", burst)
    return rows.where((F.col("gap_s") >= min_gap_s) & (F.col("burst") >= min_burst)).select("account", "txn_id", "gap_s", "burst")


def first_outlier(txn: DataFrame, min_z: float = 2.5, min_rows: int = 3, flagged: DataFrame | None = None) -> DataFrame:
    """The earliest transfer of each account whose z over all its transfers passes the bound.

    For accounts in `flagged` (account) without one it is their first transfer.
    """
    everything = Window.partitionBy("account")
    rows = sides_in_one_scan(txn).select(
        "account", "txn_id", "ts", "amount", F.avg("amount").over(everything).alias("mean"), F.stddev_pop("amount").over(everything).alias("sd"), F.count("*").over(everything).alias("n")
    )
    odd = rows.where((F.col("n") >= min_rows) & (F.col("sd") > 0) & (F.abs((F.col("amount") - F.col("mean")) / F.col("sd")) > min_z))
    first = lambda r: r.groupBy("account").agg(F.min(F.struct("ts", "txn_id", "amount")).alias("f"))
    found = first(odd)
    if flagged is not None:
        rest = rows.join(flagged.select("account").distinct(), "account", "left_semi").join(found.select("account"), "account", "left_anti")
        found = found.unionByName(first(rest))
    return found.select("account", "f.txn_id", "f.ts", F.round("f.amount", 2).alias("amount"))


def round_trips(txn: DataFrame, cycles: DataFrame, min_return: float = 0.85, unit: float = 5_000_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Transfers on the edges of each cycle (an array column `nodes`, in order): n_txns, total, span_hours, return_ratio, score, severity.

    by: columns of both that slice the ledger; a cycle's transfers are those of its slice. return_ratio is what comes back to the first account over what it sends within the cycle, 0 if it sends nothing.
    """
    return trips_of(flows(txn, by), cycles, min_return, unit, by)


def flows(txn: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, n, amount, first, last (microseconds) of the transfers of each pair in each slice."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return txn.groupBy(*by, "src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min(t).alias("first"), F.max(t).alias("last"))


def trips_of(moved: DataFrame, cycles: DataFrame, min_return: float = 0.85, unit: float = 5_000_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of round_trips from flows."""
    c = cycles.select(*by, F.xxhash64(*by, "nodes").alias("c"), "nodes")
    ends = F.posexplode(F.arrays_zip(F.col("nodes").alias("src"), F.concat(F.slice("nodes", F.lit(2), F.size("nodes")), F.slice("nodes", 1, 1)).alias("dst")))
    legs = c.select(*by, "c", F.size("nodes").alias("length"), ends.alias("leg", "e")).select(*by, "c", "length", "leg", "e.src", "e.dst")
    sums = legs.join(moved, [*by, "src", "dst"]).groupBy("c", "length").agg(
        F.sum("n").alias("n_txns"), F.sum("amount").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.when(F.col("leg") == 0, F.col("amount"))).alias("sent"), F.sum(F.when(F.col("leg") == F.col("length") - 1, F.col("amount"))).alias("back"),
    )
    ratio = F.coalesce(F.try_divide("back", "sent"), F.lit(0.0))
    tight = ratio >= min_return
    score = _clip(F.when(tight, 0.4).otherwise(0.1) + F.least(F.col("length") / 10, F.lit(0.3)) + F.least(F.col("total") / unit, F.lit(0.3)))
    severity = F.when(tight & (F.col("length") >= 3), "CRITICAL").when(tight, "HIGH").otherwise("MEDIUM")
    rows = sums.join(c, "c")
    return rows.select(
        *by, F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("cycle"), F.col("length").cast("long").alias("length"), "n_txns", F.round("total", 2).alias("total"),
        F.round((F.col("last") - F.col("first")) / 3_600_000_000, 4).alias("span_hours"), F.round(ratio, 6).alias("return_ratio"), F.round(score, 6).alias("score"), severity.alias("severity"),
    )


def layering(tight: DataFrame, extended: DataFrame, tight_s: int, extended_s: int, min_extended: int = 4, min_decay: float = 0.5) -> DataFrame:
    """Chains of walks.grown_chains as layering findings: those of the tight pass, and those of the extended pass along other paths.

    decay: share of hops that pass on less; preserved: last over first amount. A chain counts if it is tight and decays, or is
    long enough within the extended window. Returns path, hops, span_s, mode, decay, preserved, total, score, severity.
    """
    rest = extended.join(tight.select("nodes").distinct(), "nodes", "left_anti").dropDuplicates(["nodes"])
    chains = tight.unionByName(rest).withColumn("hops", F.size("nodes") - 1).where("hops >= 2")
    decay = F.col("n_less") / (F.col("hops") - 1)
    kept = F.when(F.col("first") > 0, F.col("last") / F.col("first")).otherwise(0.0)
    lost = F.when(F.col("first") > 0, 1 - F.col("last") / F.col("first")).otherwise(0.0)
    span = F.col("span_us") / 1_000_000
    is_tight = (span <= tight_s) & (decay >= min_decay)
    is_long = (span <= extended_s) & (F.col("hops") >= min_extended)
    score = F.greatest(F.lit(0.0), _clip(decay * 0.4 + F.least(F.col("hops") / 10, F.lit(0.3)) + (1 - kept) * 0.3))
    severity = F.when((F.col("hops") >= 5) & (lost >= 0.15), "CRITICAL").when(F.col("hops") >= 4, "HIGH").otherwise("MEDIUM")
    return chains.where(is_tight | is_long).select(
        F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), F.col("hops").cast("long").alias("hops"), span.cast("long").alias("span_s"),
        F.when(is_tight, "tight").otherwise("extended").alias("mode"), F.round(decay, 6).alias("decay"), F.round(kept, 6).alias("preserved"),
        F.round("total", 2).alias("total"), F.round(score, 6).alias("score"), severity.alias("severity"),
    )


def speed_category(minutes_a_hop):
    """How fast money moved: ABNORMAL under two minutes a hop, VERY_FAST under five, else FAST."""
    return F.when(minutes_a_hop < 2, "ABNORMAL").when(minutes_a_hop < 5, "VERY_FAST").otherwise("FAST")
