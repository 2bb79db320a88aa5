"""Results kept up to date, columns added later, resumed parsing."""

import random

from pyspark.sql import functions as F

from quire.operators import evolving, incremental
from quire.streaming import resume


def files_read(df):
    """By the metrics of the scans of partitioned tables."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    spark.conf.unset("spark.sql.adaptive.enabled")
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().get("numFiles").get().value() for s in scans if "bucket" in s.verboseString(1000) and s.metrics().contains("numFiles"))


def test_only_what_changed_is_read_and_computed(spark, tmp_path):
    at, store = str(tmp_path / "in"), str(tmp_path / "store")
    books = spark.range(300).select(F.col("id").alias("book_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    incremental.write_inputs(books, at)
    handed, files = [], []

    def compute(asked):
        rows = incremental.inputs_of(spark, at, asked)
        handed.append(asked.count())
        files.append(files_read(rows))
        return rows.select("book_id", F.upper("text").alias("u"))

    one = books.select("book_id", F.lit(1).cast("long").alias("version"))
    assert incremental.refresh(one, compute, store).count() == 300
    assert incremental.refresh(one, compute, store).count() == 0 and handed == [300]  # nothing to do
    changed = F.col("book_id").isin(5, 77, 240)
    incremental.write_inputs(books.withColumn("text", F.when(changed, "new").otherwise(F.col("text"))), at)
    two = one.where("book_id <> 9").withColumn("version", F.when(changed, 2).otherwise(1).cast("long")).unionByName(spark.createDataFrame([(1000, 1)], "book_id long, version long"))
    said = {r.book_id: (r.version, r.was) for r in incremental.refresh(two, compute, store).collect()}
    assert said == {5: (2, 1), 77: (2, 1), 240: (2, 1), 9: (None, 1), 1000: (1, None)}
    assert handed == [300, 4] and files[1] <= 4 < files[0]  # of about 260 folders
    now = {r.book_id: (r.u, r.generation) for r in incremental.current(spark, store).collect()}
    assert len(now) == 299 and now[5] == ("NEW", 2) and now[6] == ("T6", 1) and 9 not in now
    # a crash between results and versions: nothing is lost, and the next refresh goes on
    books.limit(1).select("book_id", F.lit("bad").alias("u")).write.parquet(f"{store}/results/generation=3")
    assert {r.book_id: r.u for r in incremental.current(spark, store).collect()} == {k: v[0] for k, v in now.items()}
    assert incremental.refresh(one, compute, store).count() == 4 + 1
    assert incremental.current(spark, store).count() == 300
    incremental.compact(spark, store, str(tmp_path / "compact"))
    same = lambda s: sorted(map(tuple, incremental.current(spark, s).select("book_id", "u").collect()))
    assert same(str(tmp_path / "compact")) == same(store)


def test_columns_that_older_files_lack(spark, tmp_path):
    path = str(tmp_path / "t")
    evolving.write_generation(spark.createDataFrame([(1, "a")], "id int, title string"), path, 1)
    evolving.write_generation(spark.createDataFrame([(None, 2, 7), ("c", 3, None)], "title string, ID long, n int"), path, 2)
    evolving.write_generation(spark.createDataFrame([(4, "d", 1, "x")], "id int, title string, n int, more string"), path, 10)
    rows = evolving.read_generations(spark, path, {"id": ("long", None), "title": ("string", "?"), "n": ("int", 0), "late": ("string", "l")})
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 0, "l"), (2, None, 7, "l"), (3, "c", None, "l"), (4, "d", 1, "l")]
    (tmp_path / "none").mkdir()
    assert evolving.read_generations(spark, str(tmp_path / "none"), {"id": ("long", 1)}).collect() == []


def test_merged_changes_against_one_by_one(spark):
    r = random.Random(4)
    rows = {i: {"a": f"a{i}", "b": i} for i in range(20)}
    changes = []
    for seq in r.sample(range(10_000), 300):
        sets = r.sample(["a", "b"], r.randint(0, 2))
        changes.append((r.randint(0, 29), seq, r.choice(["insert", "update", "update", "delete"]), sets, r.choice([None, f"x{seq}"]), r.choice([None, seq])))
    want = {k: dict(v) for k, v in rows.items()}
    for key, _, op, sets, a, b in sorted(changes, key=lambda c: c[1]):
        new = {k: v for k, v in (("a", a), ("b", b)) if k in sets}
        if op == "delete":
            want.pop(key, None)
        elif op == "insert":
            want[key] = {"a": None, "b": None, **new}
        elif key in want:
            want[key] |= new
    base = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in rows.items()], "id long, a string, b long")
    ch = spark.createDataFrame(changes, "id long, seq long, op string, sets array<string>, a string, b long").repartition(3)
    got = {x.id: {"a": x.a, "b": x.b} for x in evolving.merged(base, ch, "id").collect()}
    assert got == want
    assert evolving.merged(base, ch.limit(0), "id").count() == 20
    assert {x.id for x in evolving.merged(base.limit(0), ch, "id").collect()} <= set(range(30))


def test_resumed_results_do_not_depend_on_the_cut(spark, tmp_path):
    r = random.Random(6)
    schema = "book long, seq long, day string, batch_idx long, pages long, error string"
    rows = [(r.randint(1, 6), seq, f"2026-01-{1 + seq // 30:02d}", r.randint(1, 8), r.randint(0, 25), r.choice([None, None, "timeout"])) for seq in range(150)]
    want, done, reserved = [], set(), set()
    for book, seq, day, batch, pages, error in rows:
        if (book, batch) in done:
            want.append((book, seq, day, batch, "skipped", 0, 0))
            continue
        files = int(book not in reserved)
        reserved.add(book)
        want.append((book, seq, day, batch, "parsed" if error is None else "failed", pages if error is None else 0, files))
        if error is None:
            done.add((book, batch))
    for n, cuts in enumerate(([150], [1, 2, 90, 150])):
        at, lo = str(tmp_path / str(n)), 0
        for k, hi in enumerate(cuts):
            part = rows[lo:hi]
            lo = hi
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{at}/in/{k}")
            resume.run(spark, f"{at}/in", schema, f"{at}/out", f"{at}/state")  # stopped and begun again each time
        out = spark.read.schema(resume.OUT).parquet(f"{at}/out")
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert sum(x.files_used for x in resume.usage(out).collect()) == len(reserved)
