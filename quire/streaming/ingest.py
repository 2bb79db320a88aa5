"""Batches that arrive as files: trees of the books they belong to are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import structure
from quire.sources.files import book_bucket, write_nodes

SCHEMA = "book_id long, batch_idx int, page_start int, page_end int, text string"


def ingest(spark: SparkSession, inbox: str, batches: str, trees: str, checkpoint: str):
    """Appends new Parquet files of batches to a table and rebuilds the trees of their books
    (all of a book's batches are needed for one).  The table is dealt to folders by books, of
    which only those of the new batches' books are read.  Files that were taken before a
    restart aren't taken again; a micro-batch that is run again replaces its own part."""

    def take(new: DataFrame, epoch: int) -> None:
        bucket = book_bucket(F.col("book_id"))
        new.withColumn("epoch", F.lit(epoch)).withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(batches)
        touched = [r[0] for r in new.select(bucket.alias("bucket")).distinct().collect()]  # at most BOOK_BUCKETS
        every = spark.read.schema(f"{SCHEMA}, epoch long, bucket int").parquet(batches).where(F.col("bucket").isin(touched))
        books = every.join(new.select("book_id").distinct(), "book_id", "left_semi").drop("epoch", "bucket")
        write_nodes(structure.nodes(structure.marked_lines(books)), trees)

    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
