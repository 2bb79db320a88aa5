"""Scans over segments of long books."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import segments, structure
from quire.sources import adapters as A

SF = "/root/testdata/sf0.001"


def one_book(spark, times=1):
    """All books' batches as one book."""
    b = A.fx_batches(spark, SF).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    n = F.row_number().over(Window.orderBy("t", F.col("book_id") % 7, "book_id", "batch_idx"))
    b = b.select(F.lit(1).cast("long").alias("book_id"), n.alias("batch_idx"), "text")
    return b.select("book_id", "batch_idx", ((F.col("batch_idx") - 1) * 25 + 1).alias("page_start"), (F.col("batch_idx") * 25).alias("page_end"), "text")


def test_carried_against_one_by_one(spark):
    r = random.Random(2)
    rows = [(b, o // 7, o, r.choice([None, None, f"e{o}"]), r.randint(0, 3)) for b in (1, 2) for o in r.sample(range(100), 60)] + [(3, 0, 1, None, 5), (4, 9, 1, "x", 1), (4, 2, 0, None, 1)]
    df = spark.createDataFrame(rows, "book_id int, segment int, o int, e string, n int").repartition(3)
    got = {(x.book_id, x.o): (x.was, x.now, x.total) for x in segments.carried(df, "o", before={"was": F.col("e")}, upto={"now": F.col("e")}, sums={"total": F.col("n")}).collect()}
    assert len(got) == len(rows)
    for b in (1, 2, 3, 4):
        last, total = None, 0
        for _, _, o, e, n in sorted((x for x in rows if x[0] == b), key=lambda x: x[2]):
            total += n
            assert got[b, o] == (last, e or last, total)
            last = e or last


@pytest.mark.parametrize("span", [25, 400, 1_000_000])
def test_one_long_book_has_the_same_tree(spark, span):
    batches = segments.staged(one_book(spark))
    want = sorted(map(str, structure.marked_lines(batches).collect()))
    got = segments.marked_lines(batches, span=span)
    assert sorted(map(str, got.select(*structure.marked_lines(batches).columns).collect())) == want and len(want) > 1000


def test_nothing_has_no_lines(spark):
    assert segments.marked_lines(one_book(spark).limit(0)).collect() == []
