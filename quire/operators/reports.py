"""Roll-ups over trees, tables, images and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import fixed
from quire.functions import text as T


def graded_tables(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with gate, is_math and max_cell of the tables in a column."""
    h = F.col(html)
    return df.withColumn("gate", T.table_gate(h)).withColumn("is_math", T.is_math_table(h)).withColumn("max_cell", T.max_cell_len(h))


def table_counts(html: str = "html") -> list[Column]:
    """Aggregates over graded tables: converted, kept, and the same of math tables."""
    ok, math = F.col("gate") == "ok", F.col("is_math")
    merged = T.has(F.col(html), "colspan|rowspan", "i")
    return [
        F.count_if(ok).alias("converted"),
        F.count_if(~ok).alias("kept"),
        F.count_if(math).alias("math_total"),
        F.count_if(math & ok).alias("math_converted"),
        F.count_if(math & ~ok).alias("math_kept"),
        F.count_if(math & ~ok & merged).alias("math_kept_merged"),
        F.count_if(math & ~ok & (F.col("max_cell") > fixed.TABLE_CELL_CHARS)).alias("math_kept_cell_too_long"),
    ]


def reasons(graded: DataFrame, *by: str) -> DataFrame:
    """A map of reasons to counts of the tables kept, by some columns."""
    each = graded.where("gate <> 'ok'").groupBy(*by, "gate").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("reasons"))


def audit_tables(graded: DataFrame, html: str = "html") -> DataFrame:
    """One row: counts and their ratios, to four places; 0 of nothing."""
    t = graded.agg(F.count("*").alias("total"), *table_counts(html))
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4), F.lit(0.0))
    return t.withColumn("converted_ratio", ratio("converted", "total")).withColumn("math_ratio", ratio("math_total", "total")).withColumn("math_converted_ratio", ratio("math_converted", "math_total"))


def line_refs(lines: DataFrame, *keep: str) -> DataFrame:
    """One row for each image that a line refers to."""
    return lines.select(*keep, F.explode(T.image_refs(F.col("line"))).alias("rel"))


def image_stats(refs: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """References with repeats, and distinct ones without a file, by book (and more)."""
    have = files.select(F.col("book_id").alias("__b"), F.col("rel").alias("__r")).distinct()
    seen = refs.join(have, (F.col("book_id") == F.col("__b")) & (F.col("rel") == F.col("__r")), "left")
    return seen.groupBy(*by).agg(F.count("*").alias("referenced"), F.count_distinct(F.when(F.col("__r").isNull(), F.col("rel"))).alias("missing"))


def chapter_report(marked: DataFrame) -> DataFrame:
    """Characters, images and tables of each chapter, each book and all (grouping sets), from
    one aggregate of the marked lines."""
    lines = marked.where(F.col("role").isin("chapter", "board", "sub", "content"))
    content = F.col("role") == "content"
    table = content & F.startswith("line", F.lit("<table"))
    lines = lines.withColumn("gate", F.when(table, T.table_gate(F.col("line")))).withColumn("is_math", table & T.is_math_table(F.col("line")))
    both = lines.groupBy("book_id", "chapter_no").agg(
        F.sum(F.length(F.when(content, F.col("line")).otherwise(F.col("title")))).cast("long").alias("chars"),
        F.count_if(content & T.has(F.col("line"), fixed.IMAGE_MD)).alias("images"),
        F.count_if(F.col("gate") == "ok").alias("converted"),
        F.count_if(F.col("gate") != "ok").alias("kept"),
        F.count_if("is_math").alias("math_total"),
    )
    sums = [F.sum(c).alias(c) for c in ("chars", "images", "converted", "kept", "math_total")]
    return both.rollup("book_id", "chapter_no").agg(F.grouping_id().alias("depth"), *sums)


def outside_boards(tree: DataFrame) -> DataFrame:
    """Nodes that are neither boards nor below one.  A board stays on the path to its
    chapter's end, so these are the nodes before a chapter's first board."""
    w = Window.partitionBy("book_id", "chapter_no").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return tree.withColumn("__b", F.max(F.col("board").cast("int")).over(w)).where("__b = 0").drop("__b")


def outline_totals(tree: DataFrame) -> DataFrame:
    """Sums over a book's nodes without its boards and what is below them."""
    return outside_boards(tree).groupBy("book_id").agg(F.sum("char_count").alias("chars"), F.sum("image_count").alias("images"), F.sum("table_count").alias("tables"))


def quota_usage(events: DataFrame, page_limit: int = fixed.DAILY_PAGES, file_limit: int = fixed.DAILY_FILES) -> DataFrame:
    """(day, book, pages) to a row a day: pages used, files (each book once, on its first
    day) and what remains of the limits."""
    pages = events.groupBy("day").agg(F.sum("pages").alias("pages_used"))
    files = events.groupBy("book").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("files_used"))
    out = pages.join(files, "day", "left").withColumn("files_used", F.coalesce("files_used", F.lit(0)))
    left = lambda limit, c: F.greatest(F.lit(limit) - F.col(c), F.lit(0))
    return out.withColumn("pages_left", left(page_limit, "pages_used")).withColumn("files_left", left(file_limit, "files_used"))


def admitted(events: DataFrame, file_limit: int) -> DataFrame:
    """The books that a day's file limit lets in, in the order of their first event."""
    first = events.groupBy("book").agg(F.min(F.struct("day", "ts")).alias("f")).select("book", "f.day", "f.ts")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "book"))).where(F.col("n") <= file_limit)


def plan_batches(books: DataFrame, size: Column) -> DataFrame:
    """(id, batch_idx, page_start, page_end): page ranges of at most ``size`` pages."""
    b = books.where("page_count > 0").select("id", "page_count", size.alias("size"))
    b = b.select("id", "page_count", "size", F.posexplode(F.expr("sequence(1, page_count, size)")).alias("i", "page_start"))
    return b.select("id", (F.col("i") + 1).alias("batch_idx"), "page_start", F.least(F.col("page_start") + F.col("size") - 1, F.col("page_count")).alias("page_end"))


def error_summary(errors: DataFrame) -> DataFrame:
    """(book_id, seq, error) to the first errors of a book, joined, and their number."""
    g = errors.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "error"))).alias("e"))
    text = F.array_join(F.slice(F.col("e.error"), 1, fixed.ERRORS_SHOWN), "；")
    return g.select("book_id", F.when(F.size("e") > fixed.ERRORS_SHOWN, F.concat(text, F.lit("；共 "), F.size("e").cast("string"), F.lit(" 个"))).otherwise(text).alias("summary"), F.size("e").alias("n"))


def quota_on(ledger: DataFrame, days: DataFrame) -> DataFrame:
    """(day, pages_used, files_used) for each of ``days`` (day), by the rows of a ledger (date,
    used, priority_pages_used, files_used) of that day: none count nothing; rows of the old
    form have their pages in ``used``."""
    used = lambda *c: F.coalesce(F.sum(F.coalesce(*c, F.lit(0))), F.lit(0)).cast("long")
    own = days.select("day").distinct().join(ledger, F.col("day") == F.col("date"), "left")
    return own.groupBy("day").agg(used("priority_pages_used", "used").alias("pages_used"), used("files_used").alias("files_used"))


def quota_today(ledger: DataFrame, today: Column) -> DataFrame:
    """The row of one day."""
    return quota_on(ledger, ledger.sparkSession.range(1).select(today.alias("day")))


def quota_status(usage: DataFrame, has_key: bool, page_limit: int = fixed.DAILY_PAGES, file_limit: int = fixed.DAILY_FILES) -> DataFrame:
    """A status row for each (day, pages_used, files_used), with the names of before too."""
    left = lambda limit, c: F.greatest(F.lit(limit) - F.col(c), F.lit(0)).cast("long")
    pages, remaining = F.col("pages_used").cast("long"), left(page_limit, "pages_used")
    return usage.select(
        F.lit(page_limit).cast("long").alias("daily_priority_pages"),
        pages.alias("priority_used"),
        remaining.alias("priority_remaining"),
        (remaining <= 0).alias("priority_exhausted"),
        F.lit(file_limit).cast("long").alias("daily_file_limit"),
        F.col("files_used").cast("long").alias("files_used"),
        left(file_limit, "files_used").alias("files_remaining"),
        F.col("day").alias("date"),
        F.lit(has_key).alias("has_api_key"),
        F.lit(page_limit).cast("long").alias("daily_limit"),
        pages.alias("used"),
        remaining.alias("remaining"),
    )


def first_seen(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in an order."""
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
