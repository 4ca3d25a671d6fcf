"""Topics: a handler for each stream of events, a dead-letter sink for what it can't take, and counts of each topic by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Counts:
    """What a topic has taken in: rows and batches, the last batch, and why the topic ended, if it failed."""

    rows: int = 0
    batches: int = 0
    last: int = -1
    error: str | None = None


class TopicCounts(StreamingQueryListener):
    """Counts of each named query, from its progress; a batch that runs again after a restart counts once, as totals stay with the listener.

    Add it to spark.streams before the topics start.
    """

    def __init__(self) -> None:
        self.topics: dict[str, Counts] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        if event.name:
            self._names[str(event.id)] = event.name
            self.topics.setdefault(event.name, Counts())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name and progress.batchId > self.topics.setdefault(progress.name, Counts()).last and progress.numInputRows:
            own = self.topics[progress.name]
            own.rows, own.batches, own.last = own.rows + progress.numInputRows, own.batches + 1, progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and (name := self._names.get(str(event.id))):
            self.topics[name].error = event.exception


def run_topic(name: str, stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Give each batch of a topic to its handler and write what it makes; a batch whose handling fails goes to the dead letters with the reason.

    Both are written under the topic's and the batch's name, so a batch that runs again overwrites itself; a failing handler doesn't stop its topic.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.count()  # read by a job that succeeds, as rows that only a failing one has read count nowhere
        place = f"topic={name}/batch={number}"
        try:
            handle(kept).write.mode("overwrite").parquet(f"{out}/{place}")
        except Exception as e:  # a handler may fail in any way; its rows must not be lost
            lines = str(e).strip().splitlines()
            reason = f"{type(e).__name__}: {lines[0] if lines else ''}"[:500]
            kept.withColumn("reason", F.lit(reason)).write.mode("overwrite").parquet(f"{dead}/{place}")
        finally:
            kept.unpersist()

    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
