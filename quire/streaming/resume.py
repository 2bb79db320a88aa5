"""Results of parsing as they arrive: what is done is skipped, files are reserved once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "book long, seq long, day string, batch_idx long, action string, pages long, files long"


class Resume(StatefulProcessor):
    """For each book: the batches that are done, and whether its file is reserved.  State is
    in the state store, by key, however many batches a book has; nothing is kept in memory
    from one call to the next but what the handle gives."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "batch_idx long", "seq long", ttlDurationMs=self.ttl)
        self.reserved = handle.getValueState("reserved", "day string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seq):
            if self.done.containsKey((r.batch_idx,)):
                action, pages, files = "skipped", 0, 0
            else:
                files = 0 if self.reserved.exists() else 1
                if files:
                    self.reserved.update((r.day,))
                action, pages = ("failed", 0) if r.error is not None else ("parsed", r.pages)
                if r.error is None:
                    self.done.updateValue((r.batch_idx,), (r.seq,))
            yield Row(book=key[0], seq=r.seq, day=r.day, batch_idx=r.batch_idx, action=action, pages=pages, files=files)

    def close(self) -> None:
        pass


def resumed(results: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of results (book, seq, day, batch_idx, pages, error) with what each means:
    skipped (its batch is done), failed (an error that isn't null; the batch may come again)
    or parsed; pages that it used, and 1 file where it is the first of its book that isn't
    skipped.  A book's results come in the order of seq, in whatever micro-batches.  With
    ``ttl_ms`` a batch or a book that wasn't heard of for so long is forgotten."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return results.groupBy("book").transformWithState(Resume(ttl_ms), OUT, "Append", mode)


def run(spark: SparkSession, inbox: str, schema: str, out: str, checkpoint: str, files_at_once: int = 1000, ttl_ms: int | None = None) -> None:
    """Takes all Parquet files of results in ``inbox`` that weren't taken before, oldest first,
    and appends what they mean to ``out``.  Run again it goes on where it ended."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(inbox)
    resumed(stream, ttl_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def usage(actions: DataFrame) -> DataFrame:
    """(day, pages_used, files_used) of what ``resumed`` says."""
    return actions.groupBy("day").agg(F.sum("pages").cast("long").alias("pages_used"), F.sum("files").cast("long").alias("files_used"))
