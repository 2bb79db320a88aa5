"""Trees to Markdown, outlines and vault files.  A parent's own lines precede its children's,
so a book in the order of its lines is its tree in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.functions.entities import ALL
from quire.operators.reports import outside_boards
from quire.operators.structure import continuity


def _clean(line: Column, decoding) -> Column:
    return T.clean_markdown(T.normalize_math(T.html_images(line)), decoding.text)


def _table(line: Column, tables: str, decoding) -> Column:
    lines = F.transform(T.split_lines(T.break_table(line)), T.normalize_math)
    html = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(T.table_gate(line) == "ok", T.table_md(line, decoding)).otherwise(html) if tables == "md" else html


def rendered_lines(marked: DataFrame, tables: str = "html", decoding=ALL) -> DataFrame:
    """Marked lines of the tree with md, what each becomes.  tables: html keeps all tables
    as they are, md turns those that pass the gates to Markdown.  decoding: of
    character references; all of HTML's unless text.BASIC is given."""
    if tables not in ("html", "md"):
        raise ValueError("tables must be html or md")
    head = F.concat(F.lit("\n"), T.heading_md(F.col("level"), F.col("title"), F.col("role") == "board"), F.lit("\n"))
    body = F.when(F.startswith("line", F.lit("<table")), _table(F.col("line"), tables, decoding)).otherwise(_clean(F.col("line"), decoding))
    return marked.where("role in ('chapter', 'sub', 'board', 'content')").withColumn("md", F.when(F.col("role") == "content", body).otherwise(head))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def _joined(c: str = "md") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]), "\n")


def chapters_md(lines: DataFrame) -> DataFrame:
    """(book_id, chapter_no, title, md)"""
    g = lines.groupBy("book_id", "chapter_no").agg(_joined().alias("md"), F.max(F.when(F.col("role") == "chapter", F.col("title"))).alias("title"))
    return g.select("book_id", "chapter_no", "title", squeeze(F.col("md")).alias("md"))


def books_md(lines: DataFrame, structures: DataFrame, label: str = "structure export") -> DataFrame:
    """(book_id, md): whole books under a header of title and pages."""
    g = lines.groupBy("book_id").agg(_joined().alias("body"))
    s = structures.select("book_id", "pages_covered")
    head = F.concat(F.lit("# 《B"), F.col("book_id").cast("string"), F.lit(f"》\n\n> {label} ("), "pages_covered", F.lit(")\n"))
    return s.join(g, "book_id", "left").select("book_id", squeeze(F.concat_ws("\n", head, "body")).alias("md"))


def raw_md(batches: DataFrame) -> DataFrame:
    """(book_id, md): batches in page order behind comments with their pages."""
    part = F.concat(F.lit("\n<!-- batch "), F.col("batch_idx").cast("string"), F.lit(": p"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" -->\n\n"), F.col("text"))
    g = batches.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "batch_idx", part.alias("md")))).alias("p"))
    return g.select("book_id", F.array_join(F.col("p.md"), "\n").alias("md"))


def with_fallback(chapters: DataFrame, batches: DataFrame) -> DataFrame:
    """Chapters of all books; a book without any has one chapter with its whole raw text."""
    none = raw_md(batches).join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    return chapters.select("book_id", "chapter_no", "title", "md").unionByName(none.select("book_id", F.lit(1).cast("long").alias("chapter_no"), F.lit("全文").alias("title"), "md"))


def vault_files(chapters: DataFrame) -> DataFrame:
    """(book_id, path, content): a file for each chapter and an overview with links."""
    folder = F.concat(F.lit("B"), F.col("book_id").cast("string"))
    name = T.sanitize_filename(F.col("title"))
    numbered = F.concat(F.format_string("%02d", "chapter_no"), F.lit("_"), name)
    files = chapters.select("book_id", F.concat(folder, F.lit("/"), numbered, F.lit("/"), name, F.lit(".md")).alias("path"), F.col("md").alias("content"))
    link = F.concat(F.lit("- [["), numbered, F.lit("/"), name, F.lit("]]"))
    overview = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", link.alias("l")))).alias("l"))
    overview = overview.select("book_id", F.concat(folder, F.lit("/00_总览.md")).alias("path"), F.array_join(F.col("l.l"), "\n").alias("content"))
    return files.unionByName(overview)


def outlines(tree: DataFrame) -> DataFrame:
    """(book_id, outline): a list entry for each node in order, indented by level, without
    boards and what is below them."""
    n = F.col("node_id")
    top = F.concat(F.lit("- **"), "title", F.lit("**（"), "page_range", F.lit("，"), F.col("char_count").cast("string"), F.lit("字，图"), F.col("image_count").cast("string"), F.lit(" 表"), F.col("table_count").cast("string"), F.lit("）"))
    below = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "title", F.lit("（"), "page_range", F.lit("，"), F.col("char_count").cast("string"), F.lit("字）"))
    lines = outside_boards(tree).select("book_id", n.alias("o"), F.when(F.col("level") == 1, top).otherwise(below).alias("md"))
    return lines.groupBy("book_id").agg(_joined().alias("outline"))


def outline_reports(structures: DataFrame, tree: DataFrame) -> DataFrame:
    """(book_id, report): a book's facts, its outline, totals, warnings, boards and the
    first titles without a chapter.  structures: as structure.structures gives them, with
    ``orphans`` (titles that no chapter takes)."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    listed = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: F.concat(F.lit("- "), x[c]))
    totals = outside_boards(tree).groupBy("book_id").agg(F.sum("char_count").alias("chars"), F.sum("image_count").alias("images"), F.sum("table_count").alias("tables"))
    boards = tree.where("board").groupBy("book_id").agg(listed("title", "node_id").alias("boards"))
    gaps = continuity(tree).groupBy("book_id").agg(listed("warning", "chapter_no").alias("gaps"))
    df = structures.join(outlines(tree), "book_id", "left").join(totals, "book_id", "left").join(boards, "book_id", "left").join(gaps, "book_id", "left")
    none = F.array().cast("array<string>")
    jumps = F.transform("warnings", lambda w: F.concat(F.lit("- "), w))
    warnings = F.concat(jumps, F.coalesce("gaps", none))
    orphans = F.transform(F.slice("orphans", 1, fixed.OUTLINE_ORPHANS), lambda t: F.concat(F.lit("- "), t))
    part = lambda head, items, blank=True: F.when(F.size(items) > 0, F.concat(F.array(*[F.lit(x) for x in (["", head, ""] if blank else ["", head])]), items)).otherwise(none)
    head = F.array(
        F.concat(F.lit("# 《B"), F.col("book_id").cast("string"), F.lit("》结构大纲（P0-2 真树化重建）")),
        F.lit(""),
        F.concat(F.lit("- 覆盖页数："), "pages_covered"),
        F.concat(F.lit("- 章节数："), number("chapter_count")),
        F.concat(F.lit("- 前置部分字符（已丢弃）："), number("pre_matter_chars")),
        F.concat(F.lit("- 孤儿标题（无法归入章节）："), F.size("orphans").cast("string")),
        F.lit(""),
        F.lit("## 章节树"),
        F.lit(""),
    )
    sums = F.array(F.lit(""), F.lit("## 统计"), F.lit(""), F.concat(F.lit("- 正文字符总数："), number("chars")), F.concat(F.lit("- 图片总数："), number("images")), F.concat(F.lit("- 表格总数："), number("tables")))
    tree_lines = F.when(F.col("outline").isNotNull(), F.array("outline")).otherwise(none)
    lines = F.concat(head, tree_lines, sums, part("## ⚠ 质检警告", warnings), part("## 特殊板块（不入大纲，保留文本）", F.coalesce("boards", none), blank=False), part("## ⚠ 孤儿标题（待检查）", orphans))
    return df.select("book_id", F.array_join(lines, "\n").alias("report"))
