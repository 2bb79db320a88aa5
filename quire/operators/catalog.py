"""The catalogue of books as an event log: states, progress and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import fixed
from quire.functions import text as T


def latest(log: DataFrame, key: str, ts: str) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("event_id").desc())
    return log.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def recover_stale(books: DataFrame) -> DataFrame:
    """Books that were being parsed when the process ended are pending again."""
    return books.withColumn("parse_status", F.when(F.col("parse_status") == "parsing", "pending").otherwise(F.col("parse_status")))


def progress_percent(c: Column) -> Column:
    """'done/total' to a rounded percentage; 0 if it can't be read or total is 0."""
    done, total = F.regexp_extract(c, r"^(\d+)/(\d+)$", 1), F.regexp_extract(c, r"^(\d+)/(\d+)$", 2)
    return F.coalesce(F.floor(F.try_divide(done.try_cast("double") * 100, total.try_cast("double")) + 0.5), F.lit(0)).cast("long")


def without_books(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table without the rows of deleted books (book_id)."""
    return df.join(deleted.select("book_id").distinct(), "book_id", "left_anti")


def validate(status: str) -> str:
    if status not in fixed.STATES:
        raise ValueError(f"unknown parse status: {status}")
    return status


def replay(log: DataFrame, key: str, seq: str, op: str, columns: list[str]) -> DataFrame:
    """The table that a log of inserts, updates and deletes leaves: for each key the last
    value that isn't null of each column since its last delete.  A column that only later
    events have is null for keys without one of these.  Keys whose last event is a delete,
    and updates of keys that weren't inserted since, leave nothing."""
    order = Window.partitionBy(key).orderBy(seq)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = F.max(F.when(F.col(op) == "delete", F.col(seq))).over(every)
    rows = log.withColumn("__ended", ended).where(F.col("__ended").isNull() | (F.col(seq) > F.col("__ended")))
    begun = F.min(F.when(F.col(op) == "insert", F.col(seq)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    rows = rows.withColumn("__begun", begun.over(every)).where(F.col(seq) >= F.col("__begun"))
    return rows.groupBy(key).agg(*last)


def guards(requests: DataFrame, books: DataFrame, modes: list[str], ready: list[str]) -> DataFrame:
    """``requests`` (book_id, mode) with code: 404 if there is no such book, 400 if there is
    no such mode, 409 if the book isn't ready, else 200."""
    b = books.select(F.col("id").alias("__id"), F.col("parse_status").alias("__s"))
    code = F.when(F.col("__id").isNull(), 404).when(~F.coalesce(F.col("mode").isin(modes), F.lit(False)), 400).when(~F.coalesce(F.col("__s").isin(ready), F.lit(False)), 409).otherwise(200)
    return requests.join(b, F.col("book_id") == F.col("__id"), "left").withColumn("code", code).drop("__id", "__s")


def operations(books: DataFrame, build: str, export: str, vault: str) -> DataFrame:
    """(id, step, command, target): what rebuilding, exporting and importing books would do,
    without doing it: an import rebuilds first, and replaces the book's vault folder."""
    name = T.sanitize_filename(F.col("title"))
    built = F.concat(F.lit(f"{build}/"), T.dir_name(F.col("id"), F.col("title")))
    step = lambda n, command, target: F.struct(F.lit(n).alias("step"), F.lit(command).alias("command"), target.alias("target"))
    steps = F.array(step(1, "rebuild", built), step(2, "export", F.concat(F.lit(f"{export}/"), name, F.lit(".md"))), step(3, "import", F.concat(F.lit(f"{vault}/"), name)))
    return books.select("id", F.explode(steps).alias("s")).select("id", "s.step", "s.command", "s.target")
