"""Books from page batches to chapter trees, with window functions over a book's lines.

All windows are partitioned by book (or by parts of one), so lines are moved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import fixed
from quire.functions import text as T


def fold_lines(batches: DataFrame) -> DataFrame:
    """(book_id, batch_idx, page_start, page_end, pos, line): logical lines.  From a line
    with <table to the next with </table> all is one line; what is open at the end of a
    batch is flushed."""
    raw = batches.select("book_id", "batch_idx", "page_start", "page_end", F.posexplode(T.split_lines(F.col("text"))).alias("i", "raw"))
    w = Window.partitionBy("book_id", "batch_idx").orderBy("i")
    event = F.when(F.contains("raw", F.lit("</table>")), 0).when(F.contains("raw", F.lit("<table")), 1)
    raw = raw.withColumn("open", F.coalesce(F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    raw = raw.withColumn("pos", F.sum(F.when(F.col("open") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = raw.groupBy("book_id", "batch_idx", "page_start", "page_end", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "raw"))).alias("parts"))
    return folded.select("book_id", "batch_idx", "page_start", "page_end", "pos", F.array_join(F.col("parts.raw"), "\n").alias("line"))


def _book() -> Window:
    return Window.partitionBy("book_id")


def _order() -> Window:
    return Window.partitionBy("book_id").orderBy("page_start", "batch_idx", "pos")


def is_anchor(line: Column) -> Column:
    return line.isin(fixed.TOC_ANCHORS) | (T.strip(F.regexp_replace(line, "^#+", "")) == "目录")


def classified(batches: DataFrame) -> DataFrame:
    """Non-empty lines with o (their place in the book), toc and strict (lines of contents),
    ratio (the batch's share of them) and bare."""
    lines = fold_lines(batches).withColumn("line", T.strip(F.col("line")))
    lines = lines.withColumn("toc", T.is_toc_line(F.col("line"))).withColumn("strict", T.has(F.col("line"), fixed.TOC_STRICT))
    lines = lines.withColumn("ratio", F.avg(F.col("toc").cast("double")).over(Window.partitionBy("book_id", "batch_idx")))
    lines = lines.withColumn("o", F.row_number().over(_order()).cast("long"))
    return lines.where("line <> ''").withColumn("bare", T.bare(F.col("line")))


def toc_ratios(batches: DataFrame) -> DataFrame:
    """Share of contents lines of each batch; 0 if it has no lines."""
    lines = fold_lines(batches).groupBy("book_id", "batch_idx").agg(F.avg(T.is_toc_line(F.col("line")).cast("double")).alias("r"))
    return batches.select("book_id", "batch_idx").join(lines, ["book_id", "batch_idx"], "left").select("book_id", "batch_idx", F.coalesce("r", F.lit(0.0)).alias("ratio"))


def _numbered(c: str = "bare") -> Column:
    return ~F.col("strict") & (F.col(c) != "") & T.has(F.col(c), fixed.CHAPTER)


def _hashed() -> Column:
    return ~F.col("strict") & (F.col("bare") != "") & ~T.has(F.col("bare"), fixed.CHAPTER) & T.starts_hash(F.col("line")) & ~T.has(F.col("bare"), fixed.BOARD)


def _style(numbered: Column, hashed: Column) -> Column:
    return F.when(numbered > 0, "numbered").when(hashed >= fixed.HASH_STYLE_LEAST, "hash").otherwise("numbered")


def chapter_styles(batches: DataFrame) -> DataFrame:
    """(book_id, numbered, hashed, style)"""
    g = classified(batches).groupBy("book_id").agg(F.count_if(_numbered()).alias("numbered"), F.count_if(_hashed()).alias("hashed"))
    return g.withColumn("style", _style(F.col("numbered"), F.col("hashed")))


def toc_title_sets(batches: DataFrame) -> DataFrame:
    """(book_id, title): distinct normalised titles of all contents lines."""
    lines = fold_lines(batches).withColumn("line", T.strip(F.col("line"))).where(T.is_toc_line(F.col("line")))
    return lines.select("book_id", T.norm_title(T.toc_title(F.col("line"))).alias("title")).where("title is not null and title <> ''").distinct()


def _with_entries(lines: DataFrame) -> DataFrame:
    """Adds entry: struct(no, title, page) on the lines that are entries of the contents."""
    line = F.col("line")
    anchor = F.min(F.when(is_anchor(line), F.col("o"))).over(_book())
    lines = lines.withColumn("anchor", anchor)
    stop = F.min(F.when((F.col("o") > F.col("anchor")) & T.has(line, fixed.BODY_CHAPTER), F.col("o"))).over(_book())
    within = (F.col("o") > F.col("anchor")) & (F.col("o") < F.coalesce(stop, F.lit(1 << 62)))

    return lines.withColumn("entry", F.when(within, _entry(line)))


def _entry(line: Column) -> Column:
    """struct(no, title, page) of a line that has the form of an entry of the contents."""

    def parsed(rest):
        page = F.when(T.has(rest, fixed.ENTRY_PAGE), F.coalesce(T.group(rest, fixed.ENTRY_PAGE, 1).try_cast("int"), T.group(rest, fixed.ENTRY_PAGE, 2).try_cast("int")))
        title = T.strip(T.sub(T.strip(T.sub(rest, fixed.ENTRY_PAGE, "")), r"[….·\-—\s]+$", ""))
        return F.struct(T.cn_to_int(T.group(line, fixed.ENTRY)).alias("no"), title.alias("title"), page.alias("page"))

    entry = F.when(T.has(line, fixed.ENTRY), T.let(T.strip(T.group(line, fixed.ENTRY, 2)), parsed))
    return T.let(entry, lambda e: F.when(e["title"] != "", e))


def toc_entries(batches: DataFrame) -> DataFrame:
    """(book_id, pos, no, title, page): entries of the contents in order; page may be null."""
    e = _with_entries(classified(batches)).where("entry is not null")
    pos = F.row_number().over(Window.partitionBy("book_id").orderBy("o"))
    return e.select("book_id", pos.alias("pos"), "entry.no", "entry.title", "entry.page")


def _accepted(chapters: Column, entries: Column) -> Column:
    """(o, page) of the chapters (o, no, body) that the contents confirm: each must match an
    entry after the last one matched.  A fold over a book's chapters, of which there are few."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<o:bigint,page:int>>").alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        fits = F.filter(entries, lambda e: (e["k"] > acc["at"]) & (e["no"] == c["no"]) & (c["body"] != "") & (e["title"] == c["body"]))
        hit = F.element_at(fits, 1)
        return F.when(F.size(fits) > 0, F.struct(hit["k"].alias("at"), F.concat(acc["ok"], F.array(F.struct(c["o"].alias("o"), hit["page"].alias("page")))).alias("ok"))).otherwise(acc)

    return F.aggregate(F.array_sort(chapters), start, step)["ok"]


def _last(value: Column, w) -> Column:
    return F.last(value, True).over(w)


def _leaves_contents() -> Column:
    return T.starts_hash(F.col("line")) & (T.has(F.col("bare"), fixed.CHAPTER) | T.has(F.col("bare"), fixed.CHAPTER_BARE))


def _hash_title() -> Column:
    """Of a line that is a chapter in books whose chapters have no numbers."""
    return T.strip(F.regexp_replace("bare", "^#+", ""))


def _with_hash_chapters(known: Column) -> Column:
    """What a line is, or a chapter without a number; ``known``: its text is in the contents."""
    bare = F.col("bare")
    hash_chapter = (F.col("style") == "hash") & T.starts_hash(F.col("line")) & (bare != "") & ~T.has(bare, fixed.BOARD) & ~T.has(bare, fixed.CHAPTER_BARE) & ~T.has(bare, fixed.SECTION) & known
    return F.coalesce("found", F.when(hash_chapter, F.struct(F.lit(1).alias("level"), _hash_title().alias("title"), F.lit(False).alias("board"), F.lit("hash").alias("kind"))))


def _undotted(title: Column) -> Column:
    return T.strip(T.sub(title, "^[·•]+", ""))


def _is_weak() -> Column:
    """Headings of a form that texts have too."""
    kind, level = F.col("h.kind"), F.col("h.level")
    return F.coalesce((kind == "cn") | ((kind == "") & (level == 3) & T.has(F.col("h.title"), fixed.BRACKETED)), F.lit(False))


def _base_event() -> Column:
    kind = F.col("h.kind")
    return F.when(F.col("opens"), F.struct(F.col("o"), F.lit("").alias("kind"))).when(F.col("sub") & kind.isin("jie", "dot"), F.struct(F.col("o"), kind.alias("kind")))


def _level_below(base: str, cn: str) -> Column:
    """A line's level, given the last section or chapter before and the last listed heading."""
    level, kind, board = F.col("h.level"), F.col("h.kind"), F.coalesce(F.col("h.board"), F.lit(False))
    under = F.coalesce(F.col(f"{base}.kind") == "jie", F.lit(False))
    deep = under & F.coalesce(F.col(cn) > F.col(f"{base}.o"), F.lit(False))
    return F.when(board, 0).when(F.col("sub") & (kind == "cn"), F.when(under, 3).otherwise(2)).when(F.col("sub") & (kind == "") & (level == 3), F.when(deep, 4).otherwise(3)).otherwise(level)


def _role(first: Column, board: Column) -> Column:
    return (
        F.when(F.col("opens"), "chapter")
        .when(board & F.col("in_book"), "board")
        .when(board, "dropped")
        .when(F.col("in_board"), "content")
        .when(first, F.when(F.col("in_book"), "content").otherwise("dropped"))
        .when(F.col("sub"), F.when(F.col("in_book"), "sub").otherwise("dropped"))
        .when(F.col("in_book"), "content")
        .otherwise("front")
    )


def _page_range() -> Column:
    pages = F.concat(F.lit("p"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    return F.when(F.col("opens") & (F.coalesce("toc_page", F.lit(0)) != 0), F.concat(F.lit("p"), F.col("toc_page").cast("string"))).otherwise(pages)


def marked_lines(batches: DataFrame, version: int = 2) -> DataFrame:
    """Lines with what they are in the tree: role (chapter, sub, board, content, front or
    dropped), level, title, chapter_no, node_id, parent_level, parent_id, page_range."""
    line, o = F.col("line"), F.col("o")
    lines = classified(batches)
    lines = lines.withColumn("numbered", F.count_if(_numbered()).over(_book())).withColumn("hashed", F.count_if(_hashed()).over(_book()))
    lines = lines.withColumn("style", _style(F.col("numbered"), F.col("hashed")))
    own_title = F.when(F.col("toc"), T.norm_title(T.toc_title(line)))
    # what a book's contents have is kept on the lines that may be headings, not on all
    lines = lines.withColumn("found", T.heading(line, F.col("bare")))
    maybe = F.col("found").isNotNull() | T.starts_hash(line)
    lines = lines.withColumn("titles", F.collect_set(F.when(own_title != "", own_title)).over(_book())).withColumn("titles", F.when(maybe, F.col("titles")))
    if version == 2:
        lines = _with_entries(lines)
        w = Window.partitionBy("book_id").orderBy("o")
        k = F.when(F.col("entry").isNotNull(), F.count("entry").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        numbered_entry = F.when(F.col("entry").isNotNull(), F.struct(k.cast("int").alias("k"), F.col("entry.no").alias("no"), T.norm_title(F.col("entry.title")).alias("title"), F.col("entry.page").alias("page")))
        lines = lines.withColumn("__e", numbered_entry)
        lines = lines.withColumn("driven", (F.col("style") == "numbered") & (F.count("__e").over(_book()) >= fixed.TOC_LEAST_ENTRIES))
        lines = lines.withColumn("entries", F.collect_list("__e").over(_book())).withColumn("entries", F.when(maybe, F.array_sort("entries"))).drop("__e")
        lines = lines.where((F.col("ratio") <= fixed.TOC_PAGE_SHARE) & ~F.col("toc"))
        enter, leave = is_anchor(line), _leaves_contents()
        before = F.coalesce(_last(F.when(enter, 1).when(leave, 0), w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lines = lines.withColumn("__in", before).where(~F.col("driven") | F.when(F.col("__in") == 1, leave).otherwise(~enter)).drop("__in")
    else:
        lines = lines.where((F.col("ratio") <= fixed.TOC_PAGE_SHARE) & ~F.col("strict"))
        lines = lines.withColumn("driven", F.lit(False))
    w = Window.partitionBy("book_id").orderBy("o")
    prev, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.col("bare")
    known = lambda t: F.array_contains("titles", T.norm_title(t))
    lines = lines.withColumn("h", _with_hash_chapters(known(bare)))
    stranger = (F.col("style") == "hash") & (F.col("h.level") == 1) & (F.size("titles") > 0) & ~known(_undotted(F.col("h.title")))
    lines = lines.withColumn("h", F.when(~F.coalesce(stranger, F.lit(False)), F.col("h")))
    level, kind = F.col("h.level"), F.col("h.kind")
    board = F.coalesce(F.col("h.board"), F.lit(False))
    first = F.coalesce((level == 1) & ~board, F.lit(False))
    if version == 2:
        candidate = first & F.col("driven")
        chapter_no = T.cn_to_int(T.group(F.col("h.title"), fixed.CHAPTER_TITLE))
        body = T.norm_title(T.strip(T.group(F.col("h.title"), fixed.CHAPTER_TITLE, 2)))
        lines = lines.withColumn("__c", F.when(candidate, F.struct(o.alias("o"), chapter_no.alias("no"), body.alias("body"))))
        # the fold runs once, on a book's first candidate
        lines = lines.withColumn("__all", F.collect_list("__c").over(_book())).withColumn("__least", F.min(F.col("__c.o")).over(_book()))
        lines = lines.withColumn("__ok", F.when(o == F.col("__least"), _accepted(F.col("__all"), F.col("entries")))).drop("__all")
        lines = lines.withColumn("__ok", F.first("__ok", True).over(_book()))
        lines = lines.withColumn("__ok", F.when(candidate, F.get(F.filter("__ok", lambda x: x["o"] == o), F.lit(0))))
        lines = lines.withColumn("toc_page", F.col("__ok.page")).withColumn("confirmed", F.col("__ok").isNotNull()).drop("__c", "__least", "__ok", "entries", "entry")
        lines = lines.withColumn("opens", first & (~F.col("driven") | F.coalesce("confirmed", F.lit(False))))
    else:
        lines = lines.withColumn("opens", first).withColumn("toc_page", F.lit(None).cast("int"))
    lines = lines.withColumn("chapter_no", F.sum(F.col("opens").cast("int")).over(upto))
    lines = lines.withColumn("in_book", F.coalesce(F.sum(F.col("opens").cast("int")).over(prev), F.lit(0)) > 0)
    region = F.coalesce(_last(F.when(board & F.col("in_book"), 1).when(first, 0), prev), F.lit(0))
    lines = lines.withColumn("in_board", (region == 1) & ~first)
    if version == 2:
        vouched = T.starts_hash(line) | known(F.col("h.title")) | known(T.unnumbered(F.col("h.title")))
        take = F.col("h").isNotNull() & (~_is_weak() | vouched)
    else:
        take = F.col("h").isNotNull()
    lines = lines.withColumn("sub", take & ~board & ~first & ~F.col("in_board"))
    lines = lines.withColumn("__base", _last(_base_event(), prev)).withColumn("__cn", _last(F.when(F.col("sub") & (kind == "cn"), o), prev))
    lines = lines.withColumn("level", _level_below("__base", "__cn"))
    lines = lines.withColumn("role", _role(first, board))
    node = F.col("role").isin("chapter", "board", "sub")
    lines = lines.withColumn("node_id", _last(F.when(node, o), upto))
    inside = Window.partitionBy("book_id", "chapter_no").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct(o.alias("o"), F.col("level").alias("level"))
    if version == 2:
        for n in (2, 3, 4):
            lines = lines.withColumn(f"__p{n}", _last(F.when(node & (F.col("level") < n), mine), inside))
        parent = F.when(F.col("role") == "sub", F.coalesce(*[F.when(F.col("level") == n, F.col(f"__p{n}")) for n in (2, 3, 4)]))
    else:
        parent = F.lit(None).cast("struct<o:bigint,level:int>")
    chapter = _last(F.when(F.col("opens"), mine), inside)
    lines = lines.withColumn("__parent", F.when(F.col("role").isin("sub", "board"), F.coalesce(parent, chapter)))
    lines = lines.withColumn("parent_id", F.col("__parent.o")).withColumn("parent_level", F.col("__parent.level"))
    title = F.when(node, F.col("h.title"))
    return lines.select("book_id", "batch_idx", "o", "line", "role", F.when(node, F.col("level")).alias("level"), F.when(node, kind).alias("kind"), title.alias("title"), "chapter_no", "node_id", "parent_id", "parent_level", F.when(node, _page_range()).alias("page_range"))


def nodes(marked: DataFrame) -> DataFrame:
    """The tree as an adjacency list with each node's own counts."""
    in_tree = marked.where(F.col("role").isin("chapter", "board", "sub", "content"))
    content = F.col("role") == "content"
    head = F.max(F.when(~content, F.struct("level", "kind", "title", "page_range", "parent_id", "parent_level", "role")))
    g = in_tree.groupBy("book_id", "chapter_no", "node_id").agg(
        head.alias("n"),
        F.sum(F.length(F.when(content, F.col("line")).otherwise(F.col("title")))).cast("long").alias("char_count"),
        F.count_if(content & T.has(F.col("line"), fixed.IMAGE_MD)).alias("image_count"),
        F.count_if(content & F.contains("line", F.lit("<table"))).alias("table_count"),
    )
    return g.select("book_id", "chapter_no", "node_id", F.col("n.parent_id").alias("parent_id"), F.col("n.level").alias("level"), (F.col("n.role") == "board").alias("board"), F.col("n.title").alias("title"), F.col("n.page_range").alias("page_range"), "char_count", "image_count", "table_count", F.col("n.parent_level").alias("parent_level"))


def level_jumps(tree: DataFrame) -> DataFrame:
    """(book_id, node_id, warning) where a heading lies more than a level below its parent."""
    text = F.concat("title", F.lit(": 层级跳变（"), F.col("parent_level").cast("string"), F.lit(" -> "), F.col("level").cast("string"), F.lit("）"))
    return tree.where("not board and level - parent_level > 1").select("book_id", "node_id", text.alias("warning"))


def continuity(tree: DataFrame) -> DataFrame:
    """(book_id, chapter_no, numbers, warning) of chapters whose direct sections' numbers
    aren't consecutive, in the order of the document."""
    chapters = tree.where("level = 1 and not board").select("book_id", F.col("node_id").alias("__c"), "chapter_no", F.col("title").alias("__t"))
    sections = tree.where(~F.col("board") & T.has(F.col("title"), fixed.SECTION_NO)).select("book_id", F.col("parent_id").alias("__c"), "node_id", T.cn_to_int(T.group(F.col("title"), fixed.SECTION_NO)).alias("no"))
    g = sections.groupBy("book_id", "__c").agg(F.array_sort(F.collect_list(F.struct("node_id", "no"))).alias("s")).withColumn("numbers", F.col("s.no"))
    bad = g.where(F.size("numbers") > 1).where(F.col("numbers") != F.sequence(F.array_min("numbers"), F.array_max("numbers")))
    shown = F.concat(F.lit("["), F.array_join(F.col("numbers").cast("array<string>"), ", "), F.lit("]"))
    return bad.join(chapters, ["book_id", "__c"]).select("book_id", "chapter_no", "numbers", F.concat("__t", F.lit(": 节编号不连续 "), shown, F.lit("（可能漏识别标题）")).alias("warning"))


def pages_covered(batches: DataFrame) -> DataFrame:
    last = F.max_by("page_end", F.struct("page_start", "batch_idx"))
    return batches.groupBy("book_id").agg(F.concat(F.lit("p"), F.min("page_start").cast("string"), F.lit("-"), last.cast("string")).alias("pages_covered"))


def structures(batches: DataFrame, marked: DataFrame, tree: DataFrame) -> DataFrame:
    """One row a book: pages_covered, chapter_count, pre_matter_chars, warnings (level jumps
    in order) and orphans: titles after the front matter that no chapter takes.  There are
    none, as the first chapter ends the front matter and one is open from then on."""
    front = marked.groupBy("book_id").agg(F.coalesce(F.sum(F.when(F.col("role") == "front", F.length("line"))), F.lit(0)).cast("long").alias("pre_matter_chars"), F.count_if(F.col("role") == "chapter").alias("chapter_count"))
    jumps = level_jumps(tree).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "warning"))).alias("w"))
    out = pages_covered(batches).join(front, "book_id", "left").join(jumps, "book_id", "left")
    return out.select("book_id", "pages_covered", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"), F.coalesce("pre_matter_chars", F.lit(0)).alias("pre_matter_chars"), F.coalesce(F.col("w.warning"), F.array().cast("array<string>")).alias("warnings"), F.array().cast("array<string>").alias("orphans"))
