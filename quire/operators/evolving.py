"""Tables whose older files lack columns that were added later, and changes by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import _path


def write_generation(rows: DataFrame, path: str, generation: int) -> None:
    """Rows with the columns that the table has at that time."""
    rows.write.mode("errorifexists").parquet(f"{path}/generation={generation}")


def read_generations(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The rows of all generations with ``columns`` (name: type and default).  A column that a
    generation's files don't have holds its default there, as when it is added to a table; a
    null that was written stays null.  Columns that aren't named are left out.  There are as
    many generations as changes of columns, so each is one branch of a union."""
    at, fs = _path(spark, path)
    names = sorted((p.getPath().getName() for p in fs.listStatus(at) if p.getPath().getName().startswith("generation=")), key=lambda n: int(n.partition("=")[2]))
    out = None
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        had = {c.lower(): c for c in rows.columns}
        values = [(F.col(f"`{had[c.lower()]}`").cast(kind) if c.lower() in had else F.lit(default).cast(kind)).alias(c) for c, (kind, default) in columns.items()]
        rows = rows.select(*values)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, (kind, _) in columns.items()))


def merged(rows: DataFrame, changes: DataFrame, key: str, seq: str = "seq", op: str = "op", sets: str = "sets") -> DataFrame:
    """``rows`` (one a key) after ``changes``: (key, seq, op, sets and the columns of rows).

    op is insert, update or delete, in the order of seq; sets names the columns that a change
    sets, also to null, and others keep their value.  An insert begins a row anew: what it
    doesn't set is null; an update of a key that isn't there does nothing.  Rows and changes
    meet in one aggregate by key: the last setting of each column since the row began."""
    columns = [c for c in rows.columns if c != key]
    base = rows.select(key, F.lit(None).cast(changes.schema[seq].dataType).alias(seq), F.lit("insert").alias(op), F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias(sets), *columns)
    at = F.struct(F.col(seq).isNotNull().alias("later"), F.col(seq).alias("n"))
    every = base.unionByName(changes.select(key, seq, op, sets, *columns)).withColumn("__at", at)

    def last(c: str) -> Column:
        given = F.array_contains(sets, c)
        value = F.struct(F.when(given, F.col(c)).alias("v"))  # a struct, as max_by passes over nulls
        return F.max_by(value, F.when((F.col(op) == "insert") | (F.col(op) == "update") & given, F.col("__at"))).alias(c)

    # an insert sets all columns, so what was set last was set since the last insert
    begun = F.max_by(op, F.when(F.col(op).isin("insert", "delete"), F.col("__at"))).alias("__begun")
    out = every.groupBy(key).agg(begun, *[last(c) for c in columns]).where("__begun = 'insert'")
    return out.select(key, *[F.col(f"{c}.v").alias(c) for c in columns])
