"""Book-like inputs made from the benchmark tables by deterministic rules (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, html): one HTML table for each order, some broken in known ways."""
    li = load(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("r"))
    k = F.col("k")

    def row(r, i):
        rn = i + 1
        first = F.when((k % 11 == 0) & (rn == 1), F.lit('<td colspan="2">')).otherwise(F.lit("<td>"))
        second = F.when((k % 7 == 0) & (rn == 1), F.concat(F.lit("$q_"), rn.cast("string"), F.lit("$"))).when((k % 29 == 0) & (rn == 1), F.lit("x" * 301)).otherwise(F.concat(F.lit("s"), r["l_suppkey"].cast("string")))
        more = F.when((k % 13 == 0) & (rn == 2), F.lit("<td>z</td>")).otherwise(F.lit(""))
        wide = F.when(k % 17 == 0, F.lit("<td>w</td>" * 7)).otherwise(F.lit(""))
        return F.concat(F.lit("<tr>"), first, F.lit("p"), r["l_partkey"].cast("string"), F.lit("</td><td>"), second, F.lit("</td>"), more, wide, F.lit("</tr>"))

    stray = F.when(k % 19 == 0, F.lit("stray")).otherwise(F.lit(""))
    end = F.when(k % 23 == 0, F.lit("")).otherwise(F.lit("</table>"))
    body = F.when(k % 31 == 0, F.lit("")).otherwise(F.array_join(F.transform("r", row), ""))
    long = F.when(k % 37 == 0, F.lit("<tr><td>a</td><td>b</td></tr>" * 21)).otherwise(F.lit(""))
    return rows.select("k", F.concat(F.lit("<table>"), body, long, stray, end).alias("html"))


def fx_lines(spark: SparkSession, sf_dir: str, toc: bool = True) -> DataFrame:
    """(book_id, batch_idx, ln, line): lines of books with headings, contents, images and
    tables at fixed places.  Of 8 books one has chapters without numbers, and of 16 one has
    no chapters.  With ``toc``, every second book begins with its contents: of 8 one with
    page numbers and in a batch of its own, and that without chapter numbers."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("ln", (F.col("i") + 1).cast("long"))
    d, ln = F.col("doc_id"), F.col("ln")
    ch, k = F.floor((ln - 1) / 12) + 1, (ln - 1) % 12
    s = lambda c: c.cast("string")
    table = d % 4 == 1
    line = (
        F.when((k == 0) & (d % 16 == 9), F.col("raw"))
        .when((k == 0) & (d % 8 == 2), F.concat(F.lit("# T"), s(ch), F.lit("x")))
        .when(k == 0, F.concat(F.lit("# 第"), s(ch), F.lit("章 T"), s(ch), F.lit("x")))
        .when(k == 2, F.concat(F.lit("# 第"), F.when((d % 5 == 0) & (ch % 2 == 0), "3").otherwise("1"), F.lit("节 A")))
        .when(k == 7, F.lit("# 第2节 D"))
        .when(k == 3, F.when(d % 2 == 0, F.lit("## 一、B")).otherwise(F.lit("一、B")))
        .when(k == 4, F.lit("### （一）C"))
        .when((k == 9) & (d % 3 == 0), F.lit("习题"))
        .when(k == 9, F.concat("raw", F.lit(" ![](images/"), s(d), F.lit("_"), s(ln), F.lit(".jpg)")))
        .when(k == 10, F.concat(s(ln), F.lit("."), s(k), F.lit(" e "), s(ln)))
        .when((k == 5) & table, F.concat(F.lit("<table><tr><td>p"), s(ln), F.lit("</td><td>2</td></tr>")))
        .when((k == 6) & table, F.lit("<tr><td>1</td><td>$x$</td></tr></table>"))
        .otherwise(F.col("raw"))
    )
    body = raw.select(d.alias("book_id"), (F.floor((ln - 1) / 25) + 1).cast("int").alias("batch_idx"), "ln", line.alias("line"))
    if not toc:
        return body
    last = docs.where("doc_id % 2 = 0").select("doc_id", (F.floor((F.size(F.split("text", "\n")) - 1) / 12) + 1).cast("int").alias("n"))
    entries = last.select("doc_id", F.explode(F.sequence(F.lit(0), "n")).alias("i")).where("i = 0 or i % 4 <> 0")
    i = F.col("i")
    named = F.concat(F.lit("第"), s(i), F.lit("章 T"), s(i), F.lit("x"))
    paged = F.concat(F.lit(" …… "), s(i * 3))
    text = F.when(i == 0, F.lit("## 目录")).when(d % 8 == 0, F.concat(named, paged)).when(d % 8 == 2, F.concat(s(i), F.lit(" T"), s(i), F.lit("x"), paged)).otherwise(named)
    head = entries.select(d.alias("book_id"), F.when(d % 8 == 0, 0).otherwise(1).alias("batch_idx"), (i - 1000).cast("long").alias("ln"), text.alias("line"))
    return body.unionByName(head)


def fx_batches(spark: SparkSession, sf_dir: str, toc: bool = True) -> DataFrame:
    """(book_id, batch_idx, page_start, page_end, text)"""
    lines = fx_lines(spark, sf_dir, toc).groupBy("book_id", "batch_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return lines.select("book_id", "batch_idx", F.greatest((F.col("batch_idx") - 1) * 25 + 1, F.lit(0)).alias("page_start"), (F.col("batch_idx") * 25).alias("page_end"), "text")


def fx_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, md): Markdown documents with faults of every lint rule."""
    lines = fx_lines(spark, sf_dir, toc=False)
    d, ln = F.col("book_id"), F.col("ln")
    k = (ln - 1) % 12
    line = F.when((k == 5) & (d % 4 == 0), F.lit("| a | b |")).when((k == 6) & (d % 4 == 0), F.lit("| c |")).when((k == 7) & (d % 8 == 0), F.lit("| e | f |")).when((k == 11) & (d % 6 == 0), F.lit("<del>x</del>")).when((k == 8) & (d % 9 == 0), F.lit('<IMG src="u.png">')).otherwise(F.col("line"))
    line = F.concat(line, F.when(ln % 10 == 8, F.lit("$")).otherwise(F.lit("")), F.when(ln % 15 == 14, F.lit("\n\n\n")).otherwise(F.lit("")))
    return lines.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", line.alias("line")))), lambda x: x["line"]), "\n").alias("md"))


def fx_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, rel, bytes): files of most images referred to, and some of none."""
    lines = fx_lines(spark, sf_dir, toc=False).select("book_id", F.expr("regexp_extract(line, 'images/[0-9_]+[.]jpg', 0)").alias("rel"), "ln").where("rel <> '' and (book_id + ln) % 5 <> 0")
    extra = load(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("book_id"), F.expr("concat('images/orphan_', doc_id, '.jpg')").alias("rel"))
    return lines.select("book_id", "rel").unionByName(extra).withColumn("bytes", F.length("rel").cast("long") * 1000)


def fx_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: id, title, page_count, parse_status, parse_progress, parse_error, quota_files."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(x) for x in ("pending", "parsing", "parsed", "structure_ok", "failed")])
    return o.select(
        k.alias("id"),
        F.concat(F.lit("T"), k.cast("string")).alias("title"),
        (1 + k % 120).cast("int").alias("page_count"),
        F.element_at(states, (k % 5 + 1).cast("int")).alias("parse_status"),
        F.when(k % 3 == 0, F.concat((k % 10).cast("string"), F.lit("/"), (k % 10 + k % 4).cast("string"))).alias("parse_progress"),
        F.when(k % 5 == 4, F.concat(F.lit("e"), (k % 13).cast("string"))).alias("parse_error"),
        (k % 2).cast("int").alias("quota_files"),
    )
