"""Lint of exported Markdown: all rules from one pass over a document's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

SEVERITY = {"html_table_ragged": "warning"}
RULES = ["blank_run", "table_touch", "unexpected_img_tag", "unexpected_del_tag", "math_unclosed", "missing_image", "md_table_ragged", "html_table_ragged"]


def _lines(docs: DataFrame) -> DataFrame:
    """Lines (i from 1) with in_table: lines of an HTML table, from one that begins with
    <table to one with </table>."""
    lines = docs.select("book_id", F.posexplode(F.split("md", "\n")).alias("i", "raw"))
    lines = lines.select("book_id", (F.col("i") + 1).alias("i"), T.strip(F.col("raw")).alias("s"))
    begins, ends = F.startswith("s", F.lit("<table")), F.contains("s", F.lit("</table>"))
    w = Window.partitionBy("book_id").orderBy("i")
    before = F.coalesce(F.last(F.when(ends, 0).when(begins, 1), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("begins", begins).withColumn("ends", ends).withColumn("in_table", (before == 1) | begins)


def scan(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(book_id, rule, severity, line) of documents (book_id, md).  files: (book_id, rel) of
    the images that exist; without it that rule is off.

    All rules are read off windows over a document's lines, so lines are moved once; blocks
    and tables report at their first line."""
    w = Window.partitionBy("book_id").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s, i, free = F.col("s"), F.col("i"), ~F.col("in_table")
    lines = _lines(docs)
    lines = lines.withColumn("table_no", F.sum(F.col("begins").cast("int")).over(upto))
    lines = lines.withColumn("prev", F.last(F.when(free | F.col("ends"), s), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("run", F.sum(((free & (s != "")) | F.col("begins")).cast("int")).over(upto))
    blank = free & (s == "")
    pipe = free & F.startswith("s", F.lit("|"))
    lines = lines.withColumn("block", F.sum((free & ~pipe).cast("int")).over(upto)).withColumn("pipe", pipe)
    lines = lines.withColumn("row", F.col("in_table") & F.contains("s", F.lit("<tr")))
    lines = lines.withColumn("blanks", F.sum(blank.cast("int")).over(Window.partitionBy("book_id", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))

    def ragged(group: str, member: str, columns: Column) -> tuple[Column, Column, Column]:
        """Of a line's group: the first member, how many there are, and of how many widths."""
        g = Window.partitionBy("book_id", group)
        m = F.col(member)
        return F.min(F.when(m, i)).over(g), F.count_if(m).over(g), F.size(F.collect_set(F.when(m, columns)).over(g))

    first, n, widths = ragged("block", "pipe", T.md_columns(s))
    lines = lines.withColumn("md_ragged", F.col("pipe") & (i == first) & (n >= 3) & (widths > 1))
    first, n, widths = ragged("table_no", "row", F.regexp_count(s, F.lit(r"<td\b")))
    closed = F.bool_or(F.col("in_table") & F.col("ends")).over(Window.partitionBy("book_id", "table_no"))
    lines = lines.withColumn("html_ragged", F.col("row") & (i == first) & (widths > 1) & closed)
    hit: list[tuple[str, Column]] = [
        ("blank_run", blank & (F.col("blanks") == 3)),
        ("table_touch", free & F.coalesce(F.startswith("prev", F.lit("</table")), F.lit(False)) & (s != "")),
        ("unexpected_img_tag", free & T.has(s, r"<img\b", "i")),
        ("unexpected_del_tag", free & T.has(s, r"</?del\b", "i")),
        ("math_unclosed", free & (T.dollars(s) % 2 == 1)),
        ("md_table_ragged", F.col("md_ragged")),
        ("html_table_ragged", F.col("html_ragged")),
    ]
    issue = lambda rule, rel: F.struct(F.lit(rule).alias("rule"), rel.cast("string").alias("rel"))
    issues = F.array_compact(F.array(*[F.when(c, issue(rule, F.lit(None))) for rule, c in hit]))
    if files is not None:
        refs = F.when(free, T.image_refs(s)).otherwise(F.array().cast("array<string>"))
        issues = F.concat(issues, F.transform(refs, lambda r: issue("missing_image", r)))
    out = lines.select("book_id", i.cast("long").alias("line"), F.explode(issues).alias("x")).select("book_id", "line", "x.rule", "x.rel")
    if files is not None:
        out = out.join(files.select("book_id", "rel").distinct(), ["book_id", "rel"], "left_anti")
    return out.select("book_id", "rule", F.when(F.col("rule").isin(list(SEVERITY)), "warning").otherwise("error").alias("severity"), "line")


def vault_health(docs: DataFrame) -> DataFrame:
    """Counters of one vault file each: images that aren't remote, tags, entities, bare
    brackets and runs of blank lines; md is null-safe."""
    md = F.coalesce("md", F.lit(""))
    n = lambda pattern: F.regexp_count(md, F.lit(pattern)).cast("long")
    return docs.select(
        "book_id",
        n(r"!\[[^\]]*\]\((?!https?://)[^)]+\)").alias("image_non_remote"),
        n(r"(?i)</?(table|div|span|p|br|img|tr|td|th)[^>]*>").alias("html_tag"),
        n(r"&[a-z]+;|&#\d+;").alias("html_entity"),
        n(r"\\\(|\\\)").alias("bad_math"),
        n(r"\n{3,}").alias("blank_run"),
    )


COUNTERS = ["image_non_remote", "html_tag", "html_entity", "bad_math", "blank_run"]


def vault_reports(files: DataFrame) -> DataFrame:
    """One row for each folder (book_id) of vault files (book_id, path, content): the sums of
    its files' counters, whether its last overview has links, and how many files are named
    neither like a chapter nor like an overview."""
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    overview = F.startswith(name, F.lit("00_")) | F.contains(stem, F.lit("总览"))
    orphan = ~F.startswith(name, F.lit("00_")) & (stem != "总览") & ~F.startswith(stem, F.lit("第"))
    counted = vault_health(files.select(F.struct("book_id", "path", orphan.alias("orphan"), F.when(overview, F.struct("path", F.contains("content", F.lit("[[")).alias("ok"))).alias("moc")).alias("book_id"), F.col("content").alias("md")))
    g = counted.groupBy(F.col("book_id.book_id").alias("book_id")).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("book_id.moc").alias("moc"), F.count_if(F.col("book_id.orphan")).alias("orphan_md"))
    return g.select("book_id", *COUNTERS, "orphan_md", F.coalesce("moc.ok", F.lit(False)).alias("moc_ok"))


def vault_summary(reports: DataFrame) -> DataFrame:
    """One row: folders, issues of all of them, and whether there are none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in (*COUNTERS, "orphan_md")])
    return reports.agg(F.count("*").alias("books"), total.cast("long").alias("issues")).withColumn("healthy", F.col("issues") == 0)
