"""Files of exact names, sources by file name, documents, page ranges, links."""

import glob
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.file_queries import QUERIES, SQL
from quire.operators import documents, intervals, links
from quire.sources import tree

SF = "/root/testdata/sf0.001"


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert want
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


# --- writing and reading ----------------------------------------------------------------------


def on_disk(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def frame(spark, files):
    return spark.createDataFrame([(p, c) for p, c in files.items()] if isinstance(files, dict) else files, "path string, content string")


def test_files_are_written_once_and_folders_replaced_whole(spark, tmp_path):
    first = {"a/x/1.md": "one", "a/2.md": "", "b/3.md": "三", "top.md": "t", "c d/ä (1).md": "space"}
    said = tree.write_files(frame(spark, first).repartition(3), str(tmp_path))
    assert on_disk(tmp_path) == first and said["files"] == 5 and said["bytes"] == sum(len(c.encode()) for c in first.values())
    tree.write_files(frame(spark, {"a/9.md": "new", "d/4.md": "four"}), "file://" + str(tmp_path))
    assert on_disk(tmp_path) == {"a/9.md": "new", "d/4.md": "four", "b/3.md": "三", "top.md": "t", "c d/ä (1).md": "space"}
    before = on_disk(tmp_path)
    tree.write_files(frame(spark, {}), str(tmp_path))
    tree.write_files(frame(spark, before), str(tmp_path))  # again: the same
    assert on_disk(tmp_path) == before


@pytest.mark.parametrize("bad", ["../x.md", "a/../../x.md", "/etc/x", "a//b", "a/./b", "c:/x", "a\\b", "con.md", "a/nul", "a/x. ", "a/\x00", "", None, ".jobs/x", "a/" + "x" * 256])
def test_unsafe_paths_fail_the_job_and_leave_nothing(spark, tmp_path, bad):
    assert not tree.is_safe(bad)
    assert not spark.createDataFrame([(bad,)], "p string").select(tree.safe_path(F.col("p"))).first()[0]
    with pytest.raises(Exception, match="not a path below the root"):
        tree.stage(frame(spark, [(f"ok/{i}.md", "x") for i in range(20)] + [(bad, "y")]), str(tmp_path))
    assert on_disk(tmp_path) == {} and not list((tmp_path / ".jobs").iterdir())


def test_staged_files_have_no_folders_of_their_own(spark, tmp_path):
    """A folder takes a block of the disk, and a job has as many as files."""
    job = tree.stage(frame(spark, {f"b{i}/x/{i % 3}.md": str(i) for i in range(40)}), str(tmp_path))
    home = tmp_path / ".jobs" / job
    assert [p for a in (home / "attempts").iterdir() for p in a.rglob("*") if p.is_dir()] == []
    tree.publish(spark, str(tmp_path), job)
    assert on_disk(tmp_path) == {f"b{i}/x/{i % 3}.md": str(i) for i in range(40)} and not home.exists()


@pytest.mark.parametrize("bad", [{"a": "1", "a/b/c": "2"}, {"a/" + "题" * 100: "x"}, {"/".join(["x" * 200] * 25): "x"}])
def test_names_that_a_disk_cannot_have_fail_before_the_manifest(spark, tmp_path, bad):
    tree.write_files(frame(spark, {"a/1": "old"}), str(tmp_path))
    with pytest.raises(Exception, match="a file and a folder of one name|too long a name"):
        tree.stage(frame(spark, bad).coalesce(1), str(tmp_path))
    assert on_disk(tmp_path) == {"a/1": "old"} and not list((tmp_path / ".jobs").iterdir())


def test_two_files_of_one_name_fail(spark, tmp_path):
    with pytest.raises(Exception, match="two files of one name"):
        tree.write_files(frame(spark, [("a/x", "1"), ("a/x", "2")]), str(tmp_path))
    assert on_disk(tmp_path) == {}


def test_safe_names_are_safe(spark):
    names = ["a", "a/b.md", "B1/01_第1章 T1x/第1章 T1x.md", ".obsidian/x", "console/x", "a b/c(1).md", "x" * 255]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", tree.safe_path(F.col("p")).alias("ok")).collect()
    assert all(r.ok for r in rows) and all(map(tree.is_safe, names))


def test_a_crash_before_the_manifest_leaves_the_old_folder(spark, tmp_path):
    tree.write_files(frame(spark, {"a/1": "old", "b/1": "old"}), str(tmp_path))
    writer = tree.TreeWriter(str(tmp_path), "lost")
    import pyarrow as pa

    writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a/1"], "content": [b"new"]})]))  # staged, never committed
    assert tree.read_files(spark, str(tmp_path)).where("path = 'a/1'").first().content == b"old"
    assert tree.recover(spark, str(tmp_path)) == ([], ["lost"])
    assert on_disk(tmp_path) == {"a/1": "old", "b/1": "old"}


def test_a_crash_after_the_manifest_is_rolled_forward(spark, tmp_path):
    tree.write_files(frame(spark, {"a/1": "old", "a/2": "old", "b/1": "old"}), str(tmp_path))
    job = tree.stage(frame(spark, {"a/1": "new", "c/d/1": "new"}), str(tmp_path))
    assert {k: v for k, v in on_disk(tmp_path).items() if not k.startswith(".jobs")} == {"a/1": "old", "a/2": "old", "b/1": "old"}
    home = tmp_path / ".jobs" / job
    attempts = json.loads((home / "manifest").read_text())["attempts"]
    for a in attempts:  # as far as half of the work: all gathered, one folder moved away
        list(tree._gather(str(tmp_path), job)(a))
    (home / "old").mkdir()
    (tmp_path / "a").rename(home / "old" / "a")
    assert tree.recover(spark, str(tmp_path)) == ([job], [])
    assert on_disk(tmp_path) == {"a/1": "new", "c/d/1": "new", "b/1": "old"}


def test_a_failed_attempt_is_not_in_the_manifest(spark, tmp_path):
    import pyarrow as pa

    batch = lambda c: pa.RecordBatch.from_pydict({"path": ["a/1"], "content": [c]})

    def broken():
        yield batch(b"half")
        raise OSError("lost")

    writer = tree.TreeWriter(str(tmp_path), "j")
    with pytest.raises(OSError):
        writer.write(broken())
    assert on_disk(tmp_path) == {}
    late, good = writer.write(iter([batch(b"late")])), writer.write(iter([batch(b"good")]))  # of two attempts one counts
    writer.commit([good, None])
    tree.publish(spark, str(tmp_path), "j")
    assert on_disk(tmp_path) == {"a/1": "good"} and late.attempt != good.attempt


def test_books_with_bad_paths_are_rejected_whole(spark):
    rows = [(1, "A/1", ""), (1, "A/2", ""), (2, "B/1", ""), (2, "B/../x", ""), (3, "C/1", ""), (3, "D/1", ""), (4, "E/1", ""), (5, "E/2", ""), (6, None, "")]
    kept, bad = tree.accepted(spark.createDataFrame(rows, "book_id int, path string, content string"), "book_id")
    assert sorted(r.path for r in kept.collect()) == ["A/1", "A/2"]
    assert {r.book_id: r.reason for r in bad.collect()} == {2: "unsafe path", 3: "several folders", 4: "folder of another", 5: "folder of another", 6: "unsafe path"}


def test_filters_decide_which_files_are_opened(spark, tmp_path, monkeypatch):
    for b in range(5):
        for i in range(1, 4):
            (tmp_path / f"b{b}").mkdir(exist_ok=True)
            (tmp_path / f"b{b}" / f"batch_{i:02d}_p{i * 25 - 24}-{i * 25}.md").write_text(f"{b} {i}")
        (tmp_path / f"b{b}" / "batch_x.md").write_text("skipped")
    (tmp_path / "b1" / "batch_02_p26-50.json").write_text('[{"type":"text"}]')
    every = tree.read_batches(spark, str(tmp_path))
    assert every.count() == 15 and every.where("content_json is not null").count() == 1
    one = every.where("book = 'b1' and page_start > 25 and text like '1%'")
    assert [(r.batch_idx, r.text) for r in one.orderBy("batch_idx").collect()] == [(2, "1 2"), (3, "1 3")]
    assert every.where("book = 'none'").count() == 0 and every.where("book in ('b0', 'b4') and page_end <= 25").count() == 2
    # what the source itself does with these filters
    reader = tree.BatchReader({"path": str(tmp_path)}, ["book", "batch_idx", "page_start", "page_end", "text", "content_json"])
    left = list(reader.pushFilters([tree.EqualTo(("book",), "b1"), tree.GreaterThan(("page_start",), 25), tree.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [p.names for p in reader.partitions()] == [["b1"]]
    for other in ("b0", "b2", "b3", "b4"):  # other books' files can't even be opened
        for p in (tmp_path / other).iterdir():
            p.chmod(0)
    assert [r["text"] for batch in reader.read(reader.partitions()[0]) for r in batch.to_pylist()] == ["1 2", "1 3"]
    few = tree.BatchReader({"path": str(tmp_path), "partitions": "2"}, ["book"])
    assert [p.names for p in few.partitions()] == [["b0", "b1", "b2"], ["b3", "b4"]]


def test_an_empty_or_missing_root_has_no_files(spark, tmp_path):
    assert tree.read_files(spark, str(tmp_path)).count() == 0
    assert tree.read_files(spark, str(tmp_path / "none"), content=False).collect() == []


# --- documents --------------------------------------------------------------------------------


def nest(nodes):
    """Children below parents, by dictionaries."""
    by = {n["node_id"]: {**n, "children": []} for n in nodes}
    top = []
    for i in sorted(by):
        (by[by[i]["parent_id"]]["children"] if by[i]["parent_id"] is not None else top).append(by[i])
    fields = ["title", "level", "page_range", "lines", "char_count", "image_count", "table_count", "children", "board"]

    def shown(n):
        return {k: [shown(c) for c in n["children"]] if k == "children" else n.get(k) for k in fields}

    return [shown(n) for n in top]


def some_tree(seed, n, book=1):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        # depth-first: a parent is on the path to the node before
        path = []
        j = i - 1
        while j > 0:
            path.append(j)
            j = rows[j - 1]["parent_id"] or 0
        parent = r.choice([None, *path]) if path and r.random() < 0.3 else (path[0] if path else None)
        depth = 0 if parent is None else rows[parent - 1]["depth"] + 1
        rows.append({"book_id": book, "node_id": i, "parent_id": parent, "depth": depth, "level": depth, "board": r.random() < 0.2, "title": f'T"{i}\\', "page_range": f"p{i}", "char_count": i, "image_count": 0, "table_count": 1})
    return rows


KIND = "book_id long, node_id long, parent_id long, level int, board boolean, title string, page_range string, char_count long, image_count long, table_count long"


def tree_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in rows], KIND)


def test_documents_nest_and_come_back(spark):
    chain = [{"book_id": 9, "node_id": i, "parent_id": i - 1 if i > 1 else None, "depth": i - 1, "level": i, "board": False, "title": "t", "page_range": None, "char_count": 1, "image_count": 0, "table_count": 0} for i in range(1, 31)]
    books = [some_tree(s, n, s) for s, n in ((1, 1), (2, 40), (3, 7), (4, 90))] + [chain]
    rows = [r for b in books for r in b]
    random.Random(5).shuffle(rows)
    df = tree_frame(spark, rows).repartition(3)
    lines = df.select("book_id", "node_id", F.array("title", F.lit("行\n\t")).alias("lines"))
    s = spark.createDataFrame([(b[0]["book_id"], "p1-9", 3, ["w"], []) for b in books] + [(77, "p1-1", 0, [], [])], "book_id long, pages_covered string, pre_matter_chars long, warnings array<string>, orphans array<string>")
    docs = {r.book_id: json.loads(r.document) for r in documents.documents(s, df, lines).collect()}
    assert len(docs) == 6 and docs[77]["chapters"] == [] and list(docs[1]) == ["book", "pages_covered", "chapters", "pre_matter_chars", "skipped_orphans", "warnings"]
    for b in books:
        assert docs[b[0]["book_id"]]["chapters"] == nest([{**r, "lines": [r["title"], "行\n\t"]} for r in b])
    back = documents.nodes_of(documents.documents(s, df, lines)).collect()
    got = sorted((r.book_id, r.node_id, r.parent_id, r.depth, r.title, r.level, r.board, r.char_count) for r in back)
    assert got == sorted((r["book_id"], r["node_id"], r["parent_id"], r["depth"], r["title"], r["level"], r["board"], r["char_count"]) for r in rows)
    none = documents.nodes_of(spark.createDataFrame([(1, "no json"), (2, None), (3, "{}"), (4, '{"chapters":[]}')], "book_id long, document string"))
    assert none.collect() == []


def test_walk_is_depth_first_and_tells_what_it_does_not_reach(spark):
    rows = some_tree(8, 120, 1) + some_tree(9, 5, 2)
    assert max(r["depth"] for r in rows) >= 4
    out = documents.walk(tree_frame(spark, rows).repartition(5)).collect()
    assert {(r.book_id, r.node_id): (r.pre, r.depth) for r in out} == {(r["book_id"], r["node_id"]): (r["node_id"], r["depth"]) for r in rows}
    odd = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 4), (1, 4, 5), (1, 5, 3), (1, 6, 5), (1, 7, 99), (1, 8, 7), (1, 9, 9)], "book_id int, node_id int, parent_id int")
    walked = documents.walk(odd)
    assert sorted(r.node_id for r in walked.collect()) == [1, 2]
    assert {r.node_id: r.reason for r in documents.unreached(odd, walked).collect()} == {3: "cycle", 4: "cycle", 5: "cycle", 6: "cycle", 7: "no parent", 8: "no parent", 9: "cycle"}


# --- page ranges and links --------------------------------------------------------------------


def test_overlaps_against_all_pairs(spark):
    r = random.Random(1)
    at = lambda: r.choice([None, *range(0, 400)]) if r.random() < 0.1 else r.randint(0, 400)
    left = [(r.randint(1, 3), i, at(), at()) for i in range(150)]
    right = [(r.randint(1, 3), i, s := r.randint(0, 400), s + r.choice([-3, 0, 5, 24, 200])) for i in range(150)]
    a = spark.createDataFrame(left, "b int, i int, lo int, hi int")
    b = spark.createDataFrame(right, "b int, j int, s int, e int")
    want = sorted((i, j) for x, i, lo, hi in left for y, j, s, e in right if x == y and None not in (lo, hi) and s <= hi and e >= lo)
    for width in (1, 25, 1000):
        assert sorted((p.i, p.j) for p in intervals.overlapping(a, b, "b", ("lo", "hi"), ("s", "e"), width).collect()) == want
    starts = sorted({(x, i, lo) for x, i, lo, _ in left}, key=lambda t: (t[0], t[1]))
    following = {(x, i): next((lo2 for y, i2, lo2 in starts if y == x and i2 > i), None) for x, i, _ in starts}
    want = sorted((i, j) for x, i, lo in starts for y, j, s, e in right if x == y and lo is not None and s <= e and e >= lo and (following[x, i] is None or s < following[x, i]))
    fine = b.where("s <= e")
    got = intervals.until_next(spark.createDataFrame(starts, "b int, i int, lo int"), fine, "b", "i", "lo", ("s", "e"))
    assert sorted((p.i, p.j) for p in got.collect()) == want


def test_a_book_of_many_batches_meets_in_many_keys(spark):
    batches = spark.range(100_000).select(F.lit(1).alias("b"), F.col("id").alias("j"), (F.col("id") * 25 + 1).alias("s"), (F.col("id") * 25 + 25).alias("e"))
    chapters = spark.range(10_000).select(F.lit(1).alias("b"), F.col("id").alias("i"), (F.col("id") * 250 + 1).alias("lo"), (F.col("id") * 250 + 250).alias("hi"))
    assert intervals.overlapping(chapters, batches, "b", ("lo", "hi"), ("s", "e")).count() == 100_000


def test_links_of_any_line(spark):
    url = "https://cdn/a b"
    lines = [
        (1, 1, "![](images/a.jpg) and ![x](images/a.jpg) and ![](images/b.jpg)"),
        (1, 2, "no link (images) [x](other/a.jpg)"),
        (1, 3, ""),
        (1, 4, None),
        (1, 5, '<IMG class="c" src=\'images/a.jpg\'> [see](images/a.jpg) (images/c.jpg)'),
        (1, 5, '<IMG class="c" src=\'images/a.jpg\'> [see](images/a.jpg) (images/c.jpg)'),
        (1, 6, "$1 \\ ![images/a.jpg](images/a.jpg)$0"),
        (2, 1, "![](images/a.jpg)"),
        (None, 1, "![](images/a.jpg)"),
    ]
    urls = [(1, "images/a.jpg", url), (1, "images/a.jpg", url + "z"), (1, "images/c.jpg", "https://cdn/c"), (1, "images/b.jpg", None), (3, "images/a.jpg", "no")]
    df = spark.createDataFrame(lines, "book_id int, ln int, line string").repartition(3)
    got = links.rewritten(df, spark.createDataFrame(urls, "book_id int, rel string, url string")).collect()
    want = []
    for b, ln, line in lines:
        if b == 1 and line:
            # c.jpg is no image of the book, so a path in brackets stays
            line = line.replace("(images/a.jpg)", f"({url})").replace("src='images/a.jpg'", f"src='{url}'")
        want.append((b, ln, line))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_links_of_a_long_line(spark):
    line = " ".join(f"![](images/{i}.jpg) x" for i in range(3000))
    urls = spark.range(3000).select(F.lit(1).alias("book_id"), F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".jpg")).alias("rel"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    got = links.rewritten(spark.createDataFrame([(1, 1, line)], "book_id int, ln int, line string"), urls).first().line
    assert got == re.sub(r"images/(\d+)\.jpg", r"u\1", line)


def test_trees_are_walked_and_read_once(spark):
    """Each mention of a recursion is run anew, and reading documents reads their files anew."""
    df = tree_frame(spark, some_tree(1, 9, 1))
    s = spark.createDataFrame([(1, "p1-9", 3, ["w"], [])], "book_id long, pages_covered string, pre_matter_chars long, warnings array<string>, orphans array<string>")
    docs = documents.documents(s, df, df.select("book_id", "node_id", F.array("title").alias("lines")))
    given = spark.createDataFrame([(1, '{"chapters":[]}')], "book_id long, document string")
    for made in (docs, documents.nodes_of(given)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("UnionLoop ") == 1


def test_folders_are_switched_by_many_tasks(spark, tmp_path, monkeypatch):
    """Their names are few bytes, which Spark would join into one task."""
    each, tasks = tree._each, []
    monkeypatch.setattr(tree, "_each", lambda names, f, schema: tasks.append(names.rdd.getNumPartitions()) or each(names, f, schema))
    tree.write_files(frame(spark, {f"b{i}/1.md": "x" for i in range(40)}), str(tmp_path))
    assert tasks[-1] >= spark.sparkContext.defaultParallelism and len(on_disk(tmp_path)) == 40
