"""Trees as nested documents, documents as trees, and walks through both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels that a walk follows; trees of chapters have five.
DEEPEST = 1000


def _recursive(spark: SparkSession) -> None:
    """Recursion without a bound on rows, as trees grow with the corpus."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(DEEPEST))


def walk(nodes: DataFrame, parent: str = "parent_id", along: str | None = None) -> DataFrame:
    """``nodes`` (book_id, node_id, parent, ...) in whatever order, with path (the ids from the
    root on), depth (0 for roots) and pre, the node's number in depth-first order; siblings go
    by node_id.  along: a column of which path_<along> has the values on the path.  Nodes that
    no root leads to aren't in it: ``unreached`` has them."""
    spark = nodes.sparkSession
    _recursive(spark)
    more = f", path_{along}" if along else ""
    first, then = (f", array({along})", f", concat(w.path_{along}, array(n.{along}))") if along else ("", "")
    found = spark.sql(
        f"""
        with recursive w(book_id, node_id, path{more}) as (
          select book_id, node_id, array(node_id){first} from {{n}} where {parent} is null
          union all
          select n.book_id, n.node_id, concat(w.path, array(n.node_id)){then} from w join {{n}} n on n.book_id = w.book_id and n.{parent} = w.node_id)
        select book_id, node_id, path{more} from w""",
        n=nodes.select("book_id", "node_id", parent, *([along] if along else [])),
    )
    order = Window.partitionBy("book_id").orderBy("path")
    placed = found.withColumn("depth", F.size("path") - 1).withColumn("pre", F.row_number().over(order).cast("long"))
    return nodes.join(placed, ["book_id", "node_id"])


def unreached(nodes: DataFrame, walked: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(book_id, node_id, reason) of the nodes that aren't in a walk: an ancestor that isn't
    there (no parent), or none but itself and its like (cycle)."""
    left = nodes.join(walked.select("book_id", "node_id"), ["book_id", "node_id"], "left_anti").select("book_id", "node_id", F.col(parent).alias("__p"))
    spark = nodes.sparkSession
    _recursive(spark)
    lost = spark.sql(
        """
        with recursive w(book_id, node_id) as (
          select l.book_id, l.node_id from {l} l left anti join {l} p on p.book_id = l.book_id and p.node_id = l.__p
          union all
          select l.book_id, l.node_id from w join {l} l on l.book_id = w.book_id and l.__p = w.node_id)
        select book_id, node_id, true as lost from w""",
        l=left,
    )
    return left.join(lost, ["book_id", "node_id"], "left").select("book_id", "node_id", F.when(F.col("lost"), "no parent").otherwise("cycle").alias("reason"))


NODE = ["title", "level", "page_range", "lines", "char_count", "image_count", "table_count"]


def node_lines(marked: DataFrame) -> DataFrame:
    """(book_id, node_id, lines): a node's title and its own lines in order."""
    content = marked.where("role in ('chapter', 'board', 'sub', 'content')")
    text = F.when(F.col("role") == "content", F.col("line")).otherwise(F.col("title"))
    g = content.groupBy("book_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("o", text.alias("x")))).alias("l"))
    return g.select("book_id", "node_id", F.col("l.x").alias("lines"))


def documents(structures: DataFrame, tree: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, document): a book's structure as one JSON text, nodes nested below their
    parents to any depth.

    Walked nodes go down and up again: each begins with its own fields, and ends as many
    lists as the next one is higher.  So one ordered aggregate by book nests all levels."""
    walked = walk(tree, along="board").join(lines, ["book_id", "node_id"], "left")
    own = F.to_json(F.struct(*NODE), {"ignoreNullFields": "false"})
    opened = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['))
    after = F.coalesce(F.lead("depth").over(Window.partitionBy("book_id").orderBy("pre")), F.lit(-1))
    ended = walked.withColumn("__next", after)
    # what closes a node needs its board, and so do those of the ancestors that end with it
    upto = F.greatest("__next", F.lit(0))
    ending = F.reverse(F.slice("path_board", upto + 1, F.col("depth") - upto + 1))
    closed = F.array_join(F.transform(ending, lambda b: F.concat(F.lit('],"board":'), b.cast("string"), F.lit("}"))), "")
    text = ended.select("book_id", "pre", F.concat(opened, closed, F.when(F.col("__next") < 0, "").when(F.col("__next") <= F.col("depth"), ",").otherwise("")).alias("x"))
    chapters = text.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pre", "x"))).alias("t")).select("book_id", F.array_join("t.x", "").alias("chapters"))
    s = structures.select("book_id", F.concat(F.lit("B"), F.col("book_id").cast("string")).alias("book"), "pages_covered", "pre_matter_chars", F.col("orphans").alias("skipped_orphans"), "warnings").join(chapters, "book_id", "left")
    head, tail = F.to_json(F.struct("book", "pages_covered")), F.to_json(F.struct("pre_matter_chars", "skipped_orphans", "warnings"))
    whole = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"chapters":['), F.coalesce("chapters", F.lit("")), F.lit("],"), F.substr(tail, F.lit(2)))
    return s.select("book_id", whole.alias("document"))


def nodes_of(documents: DataFrame) -> DataFrame:
    """(book_id, path, depth, pre, node_id, parent_id, chapter_no and the fields of NODE, board)
    of documents (book_id, document): the tree read back from nested texts of any depth.
    Places in lists are the path, ids are numbers in depth-first order.  A text that isn't JSON,
    or has no chapters, has no nodes."""
    spark = documents.sparkSession
    _recursive(spark)
    every = spark.sql(
        """
        with recursive t(book_id, path, v) as (
          select book_id, array(e.pos), e.value from {d}, lateral variant_explode(variant_get(try_parse_json(document), '$.chapters', 'variant')) e
          union all
          select t.book_id, concat(t.path, array(e.pos)), e.value from t, lateral variant_explode(variant_get(t.v, '$.children', 'variant')) e)
        select book_id, path, variant_get(v, '$.title', 'string') as title, variant_get(v, '$.level', 'int') as level, variant_get(v, '$.page_range', 'string') as page_range,
          variant_get(v, '$.lines', 'array<string>') as lines, variant_get(v, '$.char_count', 'long') as char_count, variant_get(v, '$.image_count', 'long') as image_count,
          variant_get(v, '$.table_count', 'long') as table_count, variant_get(v, '$.board', 'boolean') as board from t""",
        d=documents.select("book_id", "document"),
    )
    numbered = every.withColumn("node_id", F.row_number().over(Window.partitionBy("book_id").orderBy("path")).cast("long"))
    # each node stands under its own path, and under its parent's to take the parent's id
    up = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1))
    twice = numbered.withColumn("__at", F.explode(F.array(F.struct(F.col("path").alias("p"), F.col("node_id").alias("id")), F.struct(up.alias("p"), F.lit(None).cast("long").alias("id")))))
    out = twice.withColumn("parent_id", F.max("__at.id").over(Window.partitionBy("book_id", "__at.p"))).where("__at.id is null")
    return out.select("book_id", "node_id", "parent_id", (F.get("path", F.lit(0)) + 1).cast("long").alias("chapter_no"), (F.size("path") - 1).alias("depth"), *NODE, "board")
