"""Results that are kept up to date: by key, only what changed is computed again.

A store has generations: results of the keys that a refresh computed, and beside them, written
last, the versions that these results are of.  A key's rows are those of its last generation;
a key that is gone has a version that is null.  So a refresh only adds files, a crash before
its versions leaves all as it was, and one after them has lost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import BOOK_BUCKETS, _exists, _path, book_bucket, staged

VERSIONS = "book_id long, version long, generation long"


def write_inputs(batches: DataFrame, path: str) -> None:
    """What results are computed from, dealt to folders by book; the books of ``batches``
    are replaced where the folder is one of theirs, so give whole folders or a new path."""
    batches.withColumn("bucket", book_bucket(F.col("book_id"))).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def inputs_of(spark: SparkSession, path: str, books: DataFrame) -> DataFrame:
    """The inputs of some books (book_id): only their folders are read.  The driver has the
    numbers of folders, at most BOOK_BUCKETS."""
    folders = [r[0] for r in books.select(book_bucket(F.col("book_id"))).distinct().collect()]
    every = spark.read.parquet(path)
    some = every if len(folders) == BOOK_BUCKETS else every.where(F.col("bucket").isin(folders))
    return some.join(books.select("book_id").distinct(), "book_id", "left_semi").drop("bucket")


def versions(spark: SparkSession, store: str) -> DataFrame:
    """(book_id, version, generation): the last generation of each key that isn't gone."""
    if not _exists(spark, f"{store}/versions"):
        return spark.createDataFrame([], VERSIONS)
    log = spark.read.schema(VERSIONS).parquet(f"{store}/versions")
    last = log.groupBy("book_id").agg(F.max_by(F.struct("version", "generation"), "generation").alias("v"))
    return last.select("book_id", "v.version", "v.generation").where("version is not null")


def outdated(now: DataFrame, kept: DataFrame) -> DataFrame:
    """(book_id, version, was): keys whose version isn't the kept one, new ones (was is null),
    and those that are gone (version is null)."""
    both = now.select("book_id", "version").join(kept.select("book_id", F.col("version").alias("was")), "book_id", "full")
    return both.where(~F.col("version").eqNullSafe(F.col("was")))


def refresh(now: DataFrame, compute: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """Brings ``store`` to the versions of ``now`` (book_id, version, each book once, no null).
    ``compute`` gives the rows (book_id, ...) of the books (book_id) that it is handed, and is
    called for those that changed only.  Gives these: (book_id, version, was)."""
    spark = now.sparkSession
    kept = versions(spark, store)
    changed = staged(outdated(now, kept))
    if changed.isEmpty():
        return changed
    at, fs = _path(spark, f"{store}/results")
    done = [int(p.getPath().getName().partition("=")[2]) for p in fs.listStatus(at)] if fs.exists(at) else []
    generation = max(done, default=0) + 1
    compute(changed.where("version is not null").select("book_id")).write.parquet(f"{store}/results/generation={generation}")
    changed.select("book_id", "version", F.lit(generation).cast("long").alias("generation")).write.mode("append").parquet(f"{store}/versions")
    return changed


def current(spark: SparkSession, store: str) -> DataFrame:
    """All keys' rows, kept and fresh, with the generation that they were computed in."""
    rows = spark.read.parquet(f"{store}/results").withColumn("generation", F.col("generation").cast("long"))
    return rows.join(versions(spark, store).select("book_id", "generation"), ["book_id", "generation"])


def compact(spark: SparkSession, store: str, to: str) -> None:
    """The rows and versions of a store as one generation of a new one."""
    rows = current(spark, store).drop("generation")
    rows.write.parquet(f"{to}/results/generation=1")
    versions(spark, store).withColumn("generation", F.lit(1).cast("long")).write.parquet(f"{to}/versions")
