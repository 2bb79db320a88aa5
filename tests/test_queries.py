"""All queries against their SQL on the smallest tables, and files in and out."""

import glob
import io
import json
import os
import zipfile

import duckdb
import pytest

from quire import oracle
from quire.operators import audit
from quire.queries import QUERIES
from quire.sources import files
from quire.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(oracle.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert want
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pages_with_references_that_do_not_end(spark, tmp_path):
    """Of a title cut inside &amp; and of an address: SQL leaves them, too."""
    rows = [(1, "<title>a&amp</title> &amp;quot; &quot;x&quot;"), (2, "?a=1&copy=2&middot;&copy"), (3, "&amp&amp;&am&amp;p;"), (4, "&notit; &nosuch;"), (5, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(oracle.SQL["f2_unescape_pages"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["f2_unescape_pages"](spark, str(tmp_path)).collect()) == want


def test_link_rewrite_changes_links(spark):
    lines = [r.line for r in QUERIES["j10_link_rewrite"](spark, SF).collect()]
    assert sum("(https://cdn/images/" in x for x in lines) > 10


def test_inputs_reach_all_branches(spark):
    """Styles, contents with pages and in batches of their own, gates."""
    styles = {r.style for r in QUERIES["a2_chapter_style"](spark, SF).collect()}
    pages = [r.page for r in QUERIES["c2_toc_entries"](spark, SF).collect()]
    ratios = [r.ratio for r in QUERIES["a1_toc_ratios"](spark, SF).collect()]
    nodes = QUERIES["c3_rebuild"](spark, SF).collect()
    gates = {r.gate for r in QUERIES["p10_table_gates"](spark, SF).collect()}
    assert styles == {"numbered", "hash"} and any(pages) and not all(pages) and max(ratios) > 0.5
    assert any(n.page_range and "-" not in n.page_range for n in nodes) and any(n.title == "T1x" and n.level == 1 for n in nodes)
    assert "empty" in gates and any(g.startswith("rows=2") for g in gates)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_load_batches(spark, tmp_path):
    book = tmp_path / "b1_x"
    book.mkdir()
    (book / "batch_02_p11-20.md").write_text("two")
    (book / "batch_01_p1-10.md").write_text("one\nline")
    (book / "notes.md").write_text("skip")
    (book / "batch_01_p1-10.json").write_text(json.dumps([{"type": "image", "img_path": "images/a.png"}]))
    (book / "batch_02_p11-20.json").write_text("{broken")
    rows = files.load_batches(spark, str(tmp_path)).orderBy("batch_idx").collect()
    assert [(r.book, r.batch_idx, r.page_start, r.page_end, r.text) for r in rows] == [("b1_x", 1, 1, 10, "one\nline"), ("b1_x", 2, 11, 20, "two")]
    assert rows[0].content_list[0].img_path == "images/a.png" and not rows[1].content_list
    assert files.list_files(spark, str(tmp_path), "*.md").count() == 3


def test_zip_has_what_is_referred_to(spark):
    docs = spark.createDataFrame([(1, "a.md", "![](images/x.png) ![](images/x.png) ![](images/gone.png)")], "book_id long, path string, md string")
    images = spark.createDataFrame([(1, "images/x.png", bytearray(b"x")), (1, "images/other.png", bytearray(b"o"))], "book_id long, rel string, data binary")
    row = files.zip_bundles(files.bundle_members(docs, images)).first()
    with zipfile.ZipFile(io.BytesIO(row.zip)) as z:
        assert z.namelist() == ["a.md", "images/x.png"] and z.read("images/x.png") == b"x"


def test_golden(spark):
    cur = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["x", "y"]), ("c", 1, ["x"]), ("d", 1, ["x"])], "name string, chapter_count int, titles array<string>")
    gold = spark.createDataFrame([("a", 1, ["x"]), ("b", 3, ["x"]), ("c", 1, ["z"])], "name string, chapter_count int, titles array<string>")
    assert dict(audit.verify_golden(cur, gold).collect()) == {"a": "ok", "b": "count", "c": "titles", "d": "new"}


def test_stream_rebuilds_books(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "batches", "trees", "check")]
    row = lambda i, t: (1, i, i * 10 + 1, i * 10 + 10, t)
    for i, text in enumerate(["# 第一章 a\nx", "第一节 b\ny"]):
        spark.createDataFrame([row(i, text)], ingest.SCHEMA).write.mode("append").parquet(paths[0])
        ingest.ingest(spark, *paths).awaitTermination()
        titles = [r.title for r in spark.read.parquet(paths[2]).orderBy("node_id").collect()]
        assert titles == ["第一章 a", "第一节 b"][: i + 1]


def test_vault_folders_by_a_part_of_their_names(spark):
    vault = spark.createDataFrame([("a T1 b",), ("T12",), ("none",), ("x_y",)], "dir string")
    names = spark.createDataFrame([("b1_T1",), ("b12_T12",), ("b0_T",), ("y",), ("b7_",)], "name string")
    assert dict(audit.match_vault(vault, names).collect()) == {"a T1 b": "b0_T", "T12": "b0_T", "x_y": "y"}
    assert audit.match_vault(vault, names.limit(0)).collect() == []


def test_parts_of_folder_names_are_not_broadcast(spark):
    """A name has many parts: a table of folders that Spark takes for small makes too many for a driver."""
    vault = spark.createDataFrame([("a T1 b",)], "dir string")
    found = audit.match_vault(vault, spark.createDataFrame([("b1_T1",)], "name string"))
    assert found.collect() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_retention_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, v string")
    assert [r.k for r in audit.newest(df, 2, "k").collect()] == [3]


def test_files_of_trees_structures_and_baselines(spark, tmp_path):
    path = str(tmp_path)
    tree = spark.createDataFrame([(1, 1, "x"), (2, 1, "题")], "book_id long, node_id long, title string")
    files.write_nodes(tree, f"{path}/trees")
    assert [r.title for r in files.read_nodes(spark, f"{path}/trees", 2).collect()] == ["题"]
    files.write_structures(tree, f"{path}/json")
    assert {r.value for r in spark.read.text(f"{path}/json").collect()} == {'{"book_id":1,"node_id":1,"title":"x"}', '{"book_id":2,"node_id":1,"title":"题"}'}
    (tmp_path / "golden.json").write_text(json.dumps([{"name": "a", "book_id": "b1", "chapter_count": 2, "titles": ["x", "y"], "pages_covered": "p1-9"}]))
    (row,) = files.read_golden(spark, f"{path}/golden.json").collect()
    assert (row.name, row.chapter_count, row.titles) == ("a", 2, ["x", "y"])


def test_diff_ops_make_one_side_of_the_other(spark):
    """Both sides from the ops, with and without cutting common ends."""
    import random

    from quire.operators import diff

    r = random.Random(3)
    sides = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(60)]
    rows = [(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(sides)]
    df = spark.createDataFrame([*rows, (60, None, "x"), (61, "x", None)], "k int, raw string, rebuilt string")
    for trim in (True, False):
        ops = {}
        for o in diff.diff(df, "k", trim=trim).orderBy("k", "seq").collect():
            ops.setdefault(o.k, []).append(o)
        for i, (a, b) in enumerate([*sides, ([], ["x"]), (["x"], [])]):
            left, right, at = [], [], 0
            for o in ops.get(i, []):
                if o.t == "eq":
                    left += a[len(left) : len(left) + o.n]
                    right += b[len(right) : len(right) + o.n]
                    assert left[-o.n :] == right[-o.n :]
                elif o.t == "del":
                    left.append(o.a)
                else:
                    right.append(o.b)
            assert (left, right) == (a, b)


def test_rendering_decodes_all_references(spark):
    import html

    from pyspark.sql import functions as F

    from quire.plans import render

    text = "&mdash; &#x4e2d; &frac12; &notanentity; &amp;hellip; &#8212; x"
    row = spark.createDataFrame([(1, text, "content", 1, "t", 1)], "o int, line string, role string, level int, title string, book_id int")
    got = render.rendered_lines(row).select("md").first().md
    assert got == html.unescape(html.unescape(text)).replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
    table = row.withColumn("line", F.lit("<table><tr><td>&alpha;</td><td>b</td></tr><tr><td>1</td><td>&lt;2</td></tr></table>"))
    assert render.rendered_lines(table, "md").first().md == "\n| α | b |\n| --- | --- |\n| 1 | <2 |\n"
