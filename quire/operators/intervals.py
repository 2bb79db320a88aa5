"""Joins of page ranges, dealt to bins so that work follows the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import fixed


def _bin(at: Column, width: int) -> Column:
    return F.floor(at / width)


def overlapping(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = fixed.BATCH_PAGES) -> DataFrame:
    """Pairs of rows with equal ``on`` whose spans meet: right begins at or before left's end
    and ends at or after left's begin.  Columns of both, whose names differ but for ``on``.

    Spans are dealt to bins of ``width`` numbers and joined on (on, bin), so a book with many
    batches is many keys; a pair meets in each bin that both have and is reported by that of
    the first number that both can have.  A span of w bins costs w rows: choose ``width`` near
    the length of the shorter spans.  A span whose end is before its begin stands for both
    numbers, as the condition says.  Spans with a null meet nothing."""
    (lo, hi), (start, end) = left_span, right_span
    dealt = lambda df, a, b: df.withColumn("__bin", F.explode(F.sequence(_bin(F.least(a, b), width), _bin(F.greatest(a, b), width))))
    a = dealt(left.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()), lo, hi)
    b = dealt(right.where(F.col(start).isNotNull() & F.col(end).isNotNull()), start, end)
    first = F.greatest(F.least(lo, hi), F.least(start, end))
    pairs = a.join(b, [on, "__bin"]).where((F.col(start) <= F.col(hi)) & (F.col(end) >= F.col(lo)) & (F.col("__bin") == _bin(first, width)))
    return pairs.drop("__bin")


def until_next(chapters: DataFrame, batches: DataFrame, on: str, order: str, lo: str, span: tuple[str, str], width: int = fixed.BATCH_PAGES) -> DataFrame:
    """Pairs of a chapter and the batches that end at or after its first page and begin before
    the next chapter's; the last chapter of a book goes on to the book's end."""
    start, _ = span
    last = batches.groupBy(on).agg(F.max(start).alias("__last"))
    following = F.lead(lo).over(Window.partitionBy(on).orderBy(order)) - 1
    ranged = chapters.withColumn("__hi", following).join(last, on).withColumn("__hi", F.coalesce("__hi", F.greatest("__last", lo))).drop("__last")
    return overlapping(ranged, batches, on, (lo, "__hi"), span, width).drop("__hi")


def chapter_pages(tree: DataFrame) -> DataFrame:
    """(book_id, chapter_no, lo, hi) of chapters by page ranges of the form p<a>-<b>; other
    page ranges (a single page of the contents, say) give nulls."""
    number = lambda n: F.regexp_extract("page_range", r"^p(\d+)-(\d+)", n).try_cast("int")
    return tree.where("level = 1 and not board").select("book_id", "chapter_no", number(1).alias("lo"), number(2).alias("hi"))


def joined_text(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, text): the batches of each chapter in page order, a line feed between two."""
    g = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_start", "batch_idx", "text"))).alias("b"))
    return g.select(*keys, F.size("b").cast("long").alias("n"), F.array_join("b.text", "\n").alias("text"))
