"""Shared helpers: durable intermediate tables, vocabulary paths, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master gets one set here where it is unset."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tracewell.shared.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("tracewell.shared.dir", set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate or output table in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tracewell/{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of tables that were written and not deleted yet.
_written: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [w for w in _written if os.path.basename(w) != os.path.basename(folder)]


def drop_table(df: DataFrame) -> None:
    """Delete the files under a table that `materialise` wrote, once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def drop_all_but(docs: DataFrame) -> None:
    """Delete every table written so far in this process that docs doesn't read."""
    if _written:
        read = {os.path.basename(os.path.dirname(f)) for f in docs.inputFiles()}
        for folder in [w for w in _written if os.path.basename(w) not in read]:
            _delete(docs.sparkSession, folder)


class Scratch:
    """Tables written for one computation, deleted together once nothing reads them any more."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return self.note(materialise(df, name))

    def note(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def drop(self) -> None:
        for table in self.tables:
            drop_table(table)
        self.tables = []


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; `folder` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for broadcast only if it is counted at `rows` rows at most; beyond that Spark plans a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star rounds.

    Returns (node, component), component the least node reachable. Each round is two aggregations and
    two joins; its edges are written to the shared folder, so no lineage builds up. Nodes without an
    edge to another node are left out. An empty list gives an empty table.
    """
    u, v = F.least(a, b), F.greatest(a, b)
    current = materialise(edges.select(u.alias("u"), v.alias("v")).where("u < v").distinct(), "edges")
    for _ in range(max_rounds):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v")
        # small star: a node's lower neighbours and itself are hung on the lowest of them
        large = large.distinct()
        lower = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        pairs = large.join(lower, F.col("v") == F.col("n"))
        small = (
            pairs.select(F.col("m").alias("u"), F.col("u").alias("v"))
            .unionByName(pairs.select(F.col("m").alias("u"), "v"))
            .where("u < v")
            .distinct()
        )
        after = materialise(small, "edges")
        # a star forest: no node is both a centre and a leaf, and each leaf hangs on one centre
        leaves = after.groupBy("v").agg(F.count("*").alias("k"))
        open_leaf = leaves.where("k > 1").select("v").unionByName(
            after.select(F.col("u").alias("v")).distinct().join(leaves.select("v"), "v", "left_semi")
        )
        done = open_leaf.limit(1).count() == 0
        drop_table(current)
        current = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
