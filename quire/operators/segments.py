"""Trees of books that are too long for one task: scans over segments of a book's lines.

A book's lines are dealt to segments of pages.  What a line needs from the lines before it is
the last event of a kind, or a count.  Each segment folds its lines to what it hands on: its
last events and its counts.  A prefix scan over a book's segments, of which there are few,
gives what comes in at each segment's begin, and windows inside segments do the rest; where a
segment has no event of its own, what came in holds.  Nearest higher headings are last events
too, one for each level.  So no window is over a whole book's lines, and what is moved by
book has a row a segment, an entry of the contents, or a chapter.

Between scans lines are narrow: texts stay in one written table, and only lines that may be
headings carry theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import fixed
from quire.functions import text as T
from quire.operators import structure as S
from quire.sources.files import staged

#: Pages of a segment.
SPAN = 1000
KEYS = ["book_id", "segment"]


def carried(lines: DataFrame, order: str, before: dict[str, Column] | None = None, upto: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``lines`` (book_id, segment, order, ...) with new columns: the last value that isn't
    null of the rows before (``before``) or also of the row itself (``upto``), and running
    sums with the row itself (``sums``)."""
    before, upto, sums = before or {}, upto or {}, sums or {}
    lasts = {**before, **upto}
    own = lines.groupBy(*KEYS).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"__{n}") for n, v in lasts.items()], *[F.sum(v).alias(f"__{n}") for n, v in sums.items()])
    earlier = Window.partitionBy("book_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    brought = own.select(*KEYS, *[F.last(f"__{n}", True).over(earlier).alias(f"__{n}") for n in lasts], *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*KEYS).orderBy(order)
    past, now = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    # all windows first: they and the join share one exchange of the lines
    local = {**{n: F.last(v, True).over(past) for n, v in before.items()}, **{n: F.last(v, True).over(now) for n, v in upto.items()}, **{n: F.sum(v).over(now) for n, v in sums.items()}}
    out = lines.withColumns(local).join(brought, KEYS)
    joined = {n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in lasts} | {n: F.col(n) + F.col(f"__{n}") for n in sums}
    return out.withColumns(joined).drop(*[f"__{n}" for n in joined])


def of_book(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``facts`` (book_id, ...), one row a book, by way of a row
    for each segment, so that a book's lines needn't meet in one place."""
    return lines.join(lines.select(*KEYS).distinct().join(facts, "book_id"), KEYS)


def _lines(batches: DataFrame, span: int) -> DataFrame:
    """Non-empty lines with their place and all that one line's text tells."""
    line = F.col("line")
    lines = S.fold_lines(batches).withColumn("line", T.strip(line)).withColumn("segment", F.floor(F.col("page_start") / span))
    lines = lines.withColumn("toc", T.is_toc_line(line)).withColumn("strict", T.has(line, fixed.TOC_STRICT))
    lines = lines.withColumn("ratio", F.avg(F.col("toc").cast("double")).over(Window.partitionBy("book_id", "batch_idx")))
    lines = carried(lines.withColumn("at", F.struct("page_start", "batch_idx", "pos")), "at", sums={"o": F.lit(1).cast("long")}).drop("at", "pos")
    lines = lines.where("line <> ''").withColumn("bare", T.bare(line))
    title = F.when(F.col("toc"), T.norm_title(T.toc_title(line)))
    return lines.withColumns({"found": T.heading(line, F.col("bare")), "enters": S.is_anchor(line), "leaves": S._leaves_contents(), "opens_body": T.has(line, fixed.BODY_CHAPTER), "numbered": S._numbered(), "hashed": S._hashed(), "entry": S._entry(line), "own_title": F.when(title != "", title)})


def _narrow(lines: DataFrame) -> DataFrame:
    """Without texts but those of lines that may be headings."""
    maybe = F.col("found").isNotNull() | T.starts_hash(F.col("line"))
    return lines.withColumn("maybe", maybe).withColumns({"line": F.when(F.col("maybe"), F.col("line")).otherwise(""), "bare": F.when(F.col("maybe"), F.col("bare")).otherwise("")})


def _contents(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of books, entries of their contents, and the titles in all contents lines."""
    counts = lines.groupBy("book_id").agg(F.count_if("numbered").alias("n_numbered"), F.count_if("hashed").alias("n_hashed"), F.min(F.when(F.col("enters"), F.col("o"))).alias("anchor"))
    marks = lines.where("opens_body or entry is not null").select("book_id", "o", "opens_body", "entry").join(counts.where("anchor is not null").select("book_id", "anchor"), "book_id").where("o > anchor")
    stops = marks.where("opens_body").groupBy("book_id").agg(F.min("o").alias("stop"))
    entries = marks.where("entry is not null").join(stops, "book_id", "left").where("stop is null or o < stop")
    k = F.row_number().over(Window.partitionBy("book_id").orderBy("o"))
    entries = entries.select("book_id", k.alias("k"), F.col("entry.no").alias("no"), T.norm_title(F.col("entry.title")).alias("title"), F.col("entry.page").alias("page"))
    titles = lines.where("own_title is not null").select("book_id", F.col("own_title").alias("title")).distinct()
    facts = counts.select("book_id", S._style(F.col("n_numbered"), F.col("n_hashed")).alias("style"))
    facts = facts.join(entries.groupBy("book_id").agg(F.count("*").alias("n_entries")), "book_id", "left").join(titles.groupBy("book_id").agg(F.lit(True).alias("has_titles")), "book_id", "left")
    driven = (F.col("style") == "numbered") & (F.coalesce("n_entries", F.lit(0)) >= fixed.TOC_LEAST_ENTRIES)
    return facts.select("book_id", "style", driven.alias("driven"), F.coalesce("has_titles", F.lit(False)).alias("has_titles")), entries, titles


#: Forms of a line's text that are looked up among the contents' titles.
BARE, UNDOTTED, TITLE, UNNUMBERED = range(4)


def _with_known(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds known: which forms of the text of a line that may be a heading are in its book's
    contents, by one join of equal titles."""
    title = F.coalesce(F.col("found.title"), S._hash_title())
    forms = F.array(*[F.struct(F.lit(i).alias("i"), T.norm_title(c).alias("title")) for i, c in enumerate((F.col("bare"), S._undotted(title), title, T.unnumbered(title)))])
    at = [*KEYS, "o"]
    asked = lines.where("maybe").select(*at, F.explode(forms).alias("f")).select(*at, "f.i", "f.title")
    known = asked.join(titles, ["book_id", "title"], "left_semi").groupBy(*at).agg(F.collect_set("i").alias("known"))
    return lines.join(known, at, "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))


def _confirmed(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, segment, o, toc_page) of the chapters that the contents confirm: a fold over
    the chapters of a book that has contents, of which there are few."""
    title = F.col("h.title")
    no, body = T.cn_to_int(T.group(title, fixed.CHAPTER_TITLE)), T.norm_title(T.strip(T.group(title, fixed.CHAPTER_TITLE, 2)))
    asked = lines.where("first and driven").select(*KEYS, "o", no.alias("no"), body.alias("body"))
    chapters = asked.groupBy("book_id").agg(F.collect_list(F.struct("o", "no", "body")).alias("c"))
    listed = entries.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("k", "no", "title", "page"))).alias("e"))
    ok = chapters.join(listed, "book_id").select("book_id", F.explode(S._accepted(F.col("c"), F.col("e"))).alias("x")).select("book_id", "x.o", F.col("x.page").alias("toc_page"))
    return asked.select(*KEYS, "o").join(ok, ["book_id", "o"]).withColumn("confirmed", F.lit(True))


def marked_lines(batches: DataFrame, span: int = SPAN, keep: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """As structure.marked_lines, for books of any length.  ``span``: pages of a segment;
    ``keep`` writes what is read several times and reads it again."""
    o, known = F.col("o"), lambda i: F.array_contains("known", i)
    texts = keep(_lines(batches, span))
    narrow = _narrow(texts)
    facts, entries, titles = _contents(narrow)
    facts, entries = keep(facts), keep(entries)
    shown = (F.col("ratio") <= fixed.TOC_PAGE_SHARE) & ~F.col("toc")
    lines = _with_known(of_book(narrow.where(shown), facts), titles)
    lines = keep(lines.select(*KEYS, "batch_idx", "page_start", "page_end", "o", "line", "bare", "found", "enters", "leaves", "style", "driven", "has_titles", "known"))
    lines = carried(lines, "o", before={"region": F.when(F.col("enters"), 1).when(F.col("leaves"), 0)})
    lines = lines.where(~F.col("driven") | F.when(F.coalesce("region", F.lit(0)) == 1, F.col("leaves")).otherwise(~F.col("enters")))
    lines = lines.withColumn("h", S._with_hash_chapters(known(BARE)))
    stranger = (F.col("style") == "hash") & (F.col("h.level") == 1) & F.col("has_titles") & ~known(UNDOTTED)
    lines = lines.withColumn("h", F.when(~F.coalesce(stranger, F.lit(False)), F.col("h")))
    board = F.coalesce(F.col("h.board"), F.lit(False))
    first = F.coalesce((F.col("h.level") == 1) & ~board, F.lit(False))
    vouched = T.starts_hash(F.col("line")) | known(TITLE) | known(UNNUMBERED)
    lines = lines.withColumns({"board": board, "first": first, "take": F.col("h").isNotNull() & (~S._is_weak() | vouched)})
    lines = keep(lines.select(*KEYS, "batch_idx", "page_start", "page_end", "o", "h", "board", "first", "take", "driven"))
    first, board = F.col("first"), F.col("board")
    lines = lines.join(_confirmed(lines, entries), [*KEYS, "o"], "left")
    lines = keep(lines.withColumn("opens", first & (~F.col("driven") | F.coalesce("confirmed", F.lit(False)))).drop("confirmed", "driven"))
    opened = F.col("opens").cast("int")
    lines = carried(lines, "o", sums={"chapter_no": opened})
    lines = keep(lines.withColumn("in_book", F.col("chapter_no") - opened > 0))
    lines = carried(lines, "o", before={"shut": F.when(board & F.col("in_book"), 1).when(first, 0)})
    lines = lines.withColumn("in_board", (F.coalesce("shut", F.lit(0)) == 1) & ~first)
    lines = keep(lines.withColumn("sub", F.col("take") & ~board & ~first & ~F.col("in_board")).drop("take", "shut"))
    lines = carried(lines, "o", before={"base": S._base_event(), "cn": F.when(F.col("sub") & (F.col("h.kind") == "cn"), o)})
    lines = lines.withColumn("level", S._level_below("base", "cn")).withColumn("role", S._role(first, board))
    lines = keep(lines.withColumn("node", F.col("role").isin("chapter", "board", "sub")).drop("base", "cn", "sub", "in_board", "in_book", "first", "board"))
    mine, node = F.struct("o", "level"), F.col("node")
    higher = {f"p{n}": F.when(node & (F.col("level") < n), mine) for n in (2, 3, 4)}
    lines = carried(lines, "o", before={**higher, "chapter": F.when(F.col("opens"), mine)}, upto={"node_id": F.when(node, o)})
    parent = F.when(F.col("role") == "sub", F.coalesce(*[F.when(F.col("level") == n, F.col(f"p{n}")) for n in (2, 3, 4)]))
    lines = lines.withColumn("parent", F.when(F.col("role").isin("sub", "board"), F.coalesce(parent, "chapter")))
    title = lambda c: F.when(node, F.col(f"h.{c}"))
    marks = lines.select(*KEYS, "o", "role", F.when(node, F.col("level")).alias("level"), title("kind").alias("kind"), title("title").alias("title"), "chapter_no", "node_id", F.col("parent.o").alias("parent_id"), F.col("parent.level").alias("parent_level"), F.when(node, S._page_range()).alias("page_range"))
    return texts.select(*KEYS, "batch_idx", "o", "line").join(marks, [*KEYS, "o"]).select("book_id", "batch_idx", "o", "line", "role", "level", "kind", "title", "chapter_no", "node_id", "parent_id", "parent_level", "page_range")
