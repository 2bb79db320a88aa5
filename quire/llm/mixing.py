"""Mixing sources to target weights with a low-discrepancy schedule.  DataFrame functions only.

Slot i of the schedule has the point frac(i * golden ratio), which the cumulative targets
map to a source.  The n-th slot of a source takes the n-th block of that source's shuffled
stream of words; blocks hold equally many words, and a source whose target passes its size
starts again at its first block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import cut

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
SEED = 5
#: Slots, and documents, in a group that is ranked at once.
CHUNK = 4096
#: floor(2**31 / golden ratio), odd; and the cells by which points find their source.
_STEP, _RING, _CELLS = 1327217885, 1 << 31, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, ord, weight, source_size, target, n_docs.

    Sources are ordered by code points, null last, and weigh ``weights`` in turn.  They share
    the sum of all sizes; a target stops at ``repeats`` times its source's size and the rest
    share the excess by weight.  With sources in the order of that limit over their weight,
    those that stop are a prefix, so running sums find the level.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("ord", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int")).cast("double"))
    limit = F.lit(float(repeats)) * F.col("source_size")
    by_limit = Window.orderBy(F.col("__at"), F.col("ord"))
    every = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("__limit", limit).withColumn("__at", limit / F.col("weight"))
    src = src.withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("__level", F.col("__left") / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("__stops", F.col("__at") <= F.col("__level"))
    level = F.min(F.when(~F.col("__stops"), F.struct("__at", "ord", "__level"))).over(every)["__level"]
    src = src.withColumn("target", F.when(F.col("__stops"), F.col("__limit")).otherwise(F.col("weight") * level))
    return src.drop("__limit", "__at", "__left", "__level", "__stops")


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """Slots: ord, slot (place in the mix), block, words from/to of the source's stream.

    A source gets as many slots as its target needs; the last is cut to size.  What the
    points leave over or short by (a few slots a source) is dropped or put at the end.
    """
    spark = targets.sparkSession
    n = math.ceil(total / block)
    t = targets.withColumn("quota", F.round("target").cast("long"))
    t = t.where("quota > 0")
    t = t.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    t = t.withColumn("full", F.expr("quota div source_size")).withColumn("rest", F.expr("quota % source_size"))
    t = t.withColumn("slots", F.expr(f"full * blocks + (rest + {block - 1}) div {block}"))
    order = Window.orderBy("ord")
    t = t.withColumn("hi", F.sum("target").over(order) / F.lit(float(max(total, 1)))).withColumn("lo", F.col("hi") - F.col("target") / F.lit(float(max(total, 1))))
    cells = t.select("ord", "lo", "hi", F.explode(F.expr(f"sequence(cast(floor(lo * {_CELLS}) as int), cast(floor(hi * {_CELLS}) as int))")).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.pmod(F.pmod(F.col("id"), F.lit(_RING)) * F.lit(_STEP), F.lit(_RING)) / float(_RING)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * _CELLS).cast("int"))
    drawn = points.join(cells, "cell").where("u >= lo and u < hi").select("ord", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    each = drawn.groupBy("ord", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ord").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("ord", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(each, ["ord", "chunk"]).select("ord", "slot", (F.col("before") + F.col("r")).alias("rank"))
    have = each.groupBy("ord").agg(F.sum("n").alias("have"))
    short = t.join(have, "ord", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    short = short.select("ord", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank")).select("ord", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    all_slots = ranked.unionByName(short).join(t.select("ord", "blocks", "full", "rest", "slots", "source_size"), "ord").where("rank < slots")
    all_slots = all_slots.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    end = F.when(F.col("epoch") < F.col("full"), F.col("source_size")).otherwise(F.col("rest"))
    return all_slots.select("ord", "slot", "epoch", "block", (F.col("block") * block).alias("from"), F.least((F.col("block") + 1) * block, end).alias("to"))


def streams(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``sized`` with its place in its source's shuffled stream: ord, start, pos.

    Sources are summed in slices of the hash's range first, so that no window holds a
    whole source.
    """
    rows = sized.count()
    bits = max(1, math.ceil(math.log2(max(2, rows / CHUNK))))
    s = sized.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("slice", F.shiftright("h", 64 - bits))
    s = s.join(targets.select(F.col("source").alias("__s"), "ord"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    sums = s.groupBy("ord", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("ord").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("ord", "slice", "base")
    inside = Window.partitionBy("ord", "slice").orderBy("h", "id", "size")
    s = s.withColumn("__run", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("pos", F.row_number().over(inside))
    return s.join(sums, ["ord", "slice"]).withColumn("start", F.col("base") + F.col("__run")).drop("__run", "base", "h")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, sources, documents) of the mix.

    ``documents``: row (its place: ord, slice, pos), id, source, size.  ``sources``: see
    source_targets().  ``pieces``: the same place, with slot, epoch, first (word of the
    document, from 0) and words: what the slot takes.  Null or empty texts have no words
    and no pieces; a null source is a source of its own; repeated rows are streamed one
    after the other, as are rows whose ids are equal or null.  Nothing taken passes
    ``repeats`` times a document.  Long texts are cut into blocks, not dropped.  Other
    columns are ignored.  An empty table gives three empty ones.

    Targets are windows over all sources in one task: a row a source, so meant for up to some
    million sources.  All that is about documents is dealt by source and slice.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    targets = cut(source_targets(sized, weights, repeats), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    placed = cut(streams(sized, targets, seed), "placed")
    slots = schedule(targets, int(total), block)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = parts.join(slots, ["ord", "block"]).withColumn("first", F.greatest(F.col("from") - F.col("start"), F.lit(0)))
    pieces = pieces.withColumn("words", F.least(F.col("to"), F.col("start") + F.col("size")) - F.col("start") - F.col("first")).where("words > 0")
    return pieces.select("ord", "slice", "pos", "id", "slot", "epoch", "first", "words"), targets, placed


def taken(pieces: DataFrame, targets: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, copies (how often
    its first word is taken)."""
    got = pieces.groupBy("ord", "slice", "pos").agg(F.sum("words").alias("taken"), F.count_if(F.col("first") == 0).alias("copies"))
    out = placed.join(got, ["ord", "slice", "pos"], "left").join(targets.select("ord", "source_size", "target"), "ord")
    return out.select("id", "source", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "copies")])
