"""End-of-day loads of ledger files: each content once, published whole, safe to repeat after a failure at any step.

A load stages its transfers and its new accounts in a folder of their own, checks them there, publishes the folder by one rename and
marks it in the manifest. Readers see published folders only. What is there decides where a repeated load goes on: a
mark means skip, a published folder without a mark is only marked, a staged one is written anew. The rename has to be atomic in the
store, as it is in HDFS and local file systems; there is one writer at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.ingest import IngestError, ledger_checks, minted_accounts, violations

LEDGER = "txn_id string, src string, dst string, amount double, ts timestamp, channel string"
MANIFEST = "content string, path string, day date, transfers long, new_accounts long, known_accounts long, status string, why string, at timestamp"
#: Greatest share of rows that breaks a check of the level error.
MOST_BAD = 0.005
STEPS = ("staged", "checked", "published", "marked")


def content_of(spark: SparkSession, path: str) -> str:
    """A fingerprint of a file's lines whatever their order: their number, and the sum and exclusive or of two hashes of each."""
    lines = spark.read.text(path).select(F.xxhash64("value").alias("h"), F.xxhash64(F.lit(1), "value").alias("g"))
    one = lines.agg(F.count("*"), F.sum(F.col("h").cast("decimal(30,0)")), F.expr("bit_xor(g)"))
    return one.select(F.sha2(F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in one.columns)), 256)).first()[0]


def read_normal(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with the columns of LEDGER by name, what can't be read as null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.expr(f"try_cast(`{c.split()[0]}` AS {c.split()[1]})").alias(c.split()[0]) for c in LEDGER.split(", ")))


class DailyStore:
    """A folder that holds published loads, staged ones and the manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _rename(self, old: str, new: str) -> None:
        p, fs = self._fs(old)
        q, _ = self._fs(new)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise IngestError(f"can't publish {new}")

    def _published(self, table: str, schema: str) -> DataFrame:
        folders = f"{self.root}/loads/day=*/content=*/{table}"  # Spark takes day and content from the path
        p, fs = self._fs(folders)
        if not fs.globStatus(p):
            return self.spark.createDataFrame([], f"{schema}, day date, content string")
        return self.spark.read.schema(f"{schema}, day date, content string").option("basePath", f"{self.root}/loads").parquet(folders)

    def ledger(self) -> DataFrame:
        """All published transfers, with the day and content of their load."""
        return self._published("transfers", LEDGER)

    def accounts(self) -> DataFrame:
        """Each account with the load that it came in with."""
        return self._published("accounts", "account string")

    def manifest(self) -> DataFrame:
        if not self.exists(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.root}/manifest")

    def _mark(self, row: tuple, name: str) -> None:
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{name}")

    def load(
        self, path: str, day: dt.date, read: Callable[[SparkSession, str], DataFrame] = read_normal, force: bool = False, after: Callable[[str], None] = lambda step: None
    ) -> str:
        """Load a file as of a day: SUCCESS, SKIPPED if its content is there already, FAILED if too many of its rows break a check.

        force loads a content that is there again, in place of what it had. after is called with each of STEPS once it is done.
        """
        content = content_of(self.spark, path)
        staged, mark = f"{self.root}/staging/{content}", f"SUCCESS-{content}"
        there = [r.day for r in self.ledger().where(F.col("content") == content).select("day").distinct().collect()]
        if there and force:
            self.delete(f"{self.root}/manifest/{mark}")
            for d in there:
                self.delete(f"{self.root}/loads/day={d}/content={content}")
            there = []
        if self.exists(f"{self.root}/manifest/{mark}/_SUCCESS"):
            return "SKIPPED"
        if not there:
            rows = read(self.spark, path)
            rows.write.mode("overwrite").parquet(f"{staged}/transfers")
            rows = self.spark.read.schema(LEDGER).parquet(f"{staged}/transfers")
            minted_accounts(rows, self.accounts()).write.mode("overwrite").parquet(f"{staged}/accounts")
            after("staged")
            bad = violations(rows, ledger_checks()).where(f"level = 'error' AND share > {MOST_BAD}").select("check").orderBy("check").collect()
            if bad or rows.isEmpty():
                why = ", ".join(r.check for r in bad) or "no rows"
                self._mark((content, path, day, rows.count(), None, None, "FAILED", why, dt.datetime.now(dt.UTC)), f"FAILED-{content}")
                self.delete(staged)
                return "FAILED"
            after("checked")
            self._rename(staged, f"{self.root}/loads/day={day}/content={content}")
            after("published")
            there = [day]
        own = self.ledger().where(F.col("content") == content)
        new = self.accounts().where(F.col("content") == content).count()
        every = own.select(F.explode(F.array("src", "dst")).alias("a")).where("a IS NOT NULL").distinct().count()
        self._mark((content, path, there[0], own.count(), new, every - new, "SUCCESS", "", dt.datetime.now(dt.UTC)), mark)
        after("marked")
        return "SUCCESS"
