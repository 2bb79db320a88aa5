"""Rule ensemble, ball-tree clusters and whitening."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.llm import balls, rules, whiten
from quire.llm.queries import op11_quality, op12_clusters, op13_whitening

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


# --- clusters ---------------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, salt="3", dims=64):
    """(id, cluster, distance) of the rows (id, vector), and centroids, one by one."""
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in order[:k]]
    if not cents:
        return [], []
    x = np.array([v for _, v in kept], np.int64)

    def nearest():
        d = ((x[:, None, :] - np.array(cents, np.int64)[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = nearest()
        for c in range(len(cents)):
            if (own == c).any():
                n = int((own == c).sum())
                cents[c] = [int(s) // n for s in x[own == c].sum(0)]
    own, d = nearest()
    return [(i, int(c), int(y)) for (i, _), c, y in zip(kept, own, d)], cents


def blobs(n, dims, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, dims))
    return (at[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))).astype(float)


@pytest.mark.parametrize("spread", [0.01, 0.3, 2.0])
def test_balls_assign_as_every_distance_does(spread):
    x = np.floor(1024 * blobs(3000, 6, 9, spread)).astype(np.int64)
    x[100:200] = x[0]
    order, spans, radii, sums = balls.build(x)
    points = x[order]
    assert sorted(order) == list(range(len(x))) and (sums[0] == x.sum(0)).all()
    for (lo, hi, left), r, s in zip(spans, radii, sums):
        assert (points[lo:hi].sum(0) == s).all()
        assert np.sqrt(((points[lo:hi] - s / (hi - lo)) ** 2).sum(1)).max() <= r + 1e-6
        if left >= 0:
            assert (spans[left][0], spans[left][1], spans[left + 1][1]) == (lo, spans[left + 1][0], hi)
    cents = points[np.random.default_rng(2).choice(len(x), 8, replace=False)]
    cents[5] = cents[2]  # a tie: the smaller number has all
    whole, places, winner = balls.assigned(points, spans, radii, sums, cents)
    got = np.full(len(x), -1)
    got[places] = winner
    for ball, c in whole:
        assert (got[spans[ball, 0] : spans[ball, 1]] == -1).all()
        got[spans[ball, 0] : spans[ball, 1]] = c
    assert (got == ((points[:, None, :] - cents[None]) ** 2).sum(2).argmin(1)).all()
    if spread == 0.01:
        assert sum(spans[b, 1] - spans[b, 0] for b, _ in whole) > len(x) / 3  # many go as whole balls


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_of_odd_rows(spark):
    v = blobs(300, 64, 12, 0.2).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(1, v[1]), (1, v[1]), (1, v[7]), (None, v[3]), (None, v[4]), (400, None), (401, []), (402, v[0][:63]), (403, v[0] + [0.0]), (404, [None] + v[0][1:]), (405, [math.nan] + v[0][1:]), (406, [math.inf] + v[0][1:])]
    rows += [(500 + i, v[9]) for i in range(40)] + [(-3, [-0.0] * 64), (-4, [-0.00001] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("n", F.lit(1))
    want, cents = lloyd(rows)
    out, got = balls.cluster(df.repartition(5))
    assert got.tolist() == cents
    assert as_rows(out) == sorted(want, key=str)
    few = df.where("vec_id in (2, 3)")
    assert as_rows(balls.cluster(few)[0]) == sorted(lloyd([r for r in rows if r[0] in (2, 3)])[0], key=str)
    assert as_rows(balls.with_inertia(*balls.cluster(df.limit(0)))) == []
    named = df.withColumn("vec_id", F.concat(F.lit("a"), "vec_id")).where("vec_id is not null")
    assert as_rows(balls.cluster(named)[0]) == sorted(lloyd([(f"a{i}", x) for i, x in rows if i is not None])[0], key=str)


def test_vectors_beyond_exact_distances_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="squared distances"):
        balls.cluster(df)[0].collect()


def test_cluster_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, cents = lloyd(rows)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    got = {r.vec_id: r for r in op12_clusters(spark, SF).collect()}
    assert len(got) == len(want)
    for i, c, d in want:
        r = got[i]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) == (c, d, inertia[c], sum(inertia.values()), sha[c])


# --- whitening --------------------------------------------------------------------------------


def whitened(rows, most=8):
    """n, sums, exact deviations, eigenvalues and axes, trace; the kept rows."""
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, s = len(x), [int(t) for t in x.sum(0)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for _, v in kept]
    centred = x - np.array(s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return kept, n, deviations, values[order], axes[:, order], values.sum(), centred


def check_whitening(out, rows):
    kept, n, deviations, values, axes, trace, centred = whitened(rows)
    w = centred @ axes / np.sqrt(values)
    got = out.collect()
    assert len(got) == len(kept) * len(values)
    want = Counter((i, d) for (i, _), d in zip(kept, deviations))
    assert Counter((r[0], r.deviation) for r in got if r.component == 1) == want
    by = {(r[0], r.component, r.deviation): r for r in got}
    for k in range(len(values)):
        mine = np.array([by[i, k + 1, d].whitened for (i, _), d in zip(kept, deviations)])
        sign = np.sign((mine * w[:, k]).sum())
        assert np.allclose(sign * mine, w[:, k], atol=1e-7)
        assert by[kept[0][0], k + 1, deviations[0]].explained == pytest.approx(values[k] / trace, rel=1e-9)
    assert {r.n for r in got} == {n} and all(abs(r.identity_error) < 1e-8 for r in got) and len({r.identity_error for r in got}) == 1


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(200, 10)) * np.arange(1, 11)).tolist()
    rows = list(enumerate(v)) + [(3, v[3]), (3, v[3]), (None, v[5]), (300, None), (301, [None] + v[0][1:]), (302, [math.nan] + v[0][1:]), (303, [-math.inf] + v[0][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit(7))
    check_whitening(whiten.whiten(df.repartition(3)), rows)
    # vectors of other lengths have no place in this covariance
    more = df.unionByName(spark.createDataFrame([(900, [1.0, 2.0]), (901, [])], "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit(7)))
    check_whitening(whiten.whiten(more), rows)
    assert whiten.whiten(df.limit(0)).collect() == []
    assert whiten.whiten(df.where("vec_id > 299")).collect() == []


def test_whitening_where_nothing_varies(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (2, [1.0, 2.0, 5.0])]
    out = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 9
    first = sorted(abs(r.whitened) for r in out if r.component == 1)
    assert first == pytest.approx([0, math.sqrt(1.5), math.sqrt(1.5)]) and all(r.whitened is None for r in out if r.component > 1)
    assert all(r.explained == pytest.approx(1 if r.component == 1 else 0) for r in out)
    one = whiten.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, 0.0) for k in (1, 2, 3)]


def test_deviations_stay_exact():
    x, n = np.array([[1 << 40, 5], [3, 1 << 41]], np.int64), 1 << 10
    sums = np.array([1 << 50, 77], np.int64)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whiten.deviations(x, n, sums) == [e if e < 1 << 63 else None for e in exact]
    small = np.array([[100_001, 99_000], [100_500, 100_000]], np.int64)
    s = small.sum(0)
    assert whiten.deviations(small, 2, s) == [sum((2 * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in small]


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(op13_whitening(spark, SF), rows)


# --- rules ------------------------------------------------------------------------------------


def plain_statistics(text):
    """One text, character by character."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = "".join(c.lower() if c.isascii() else c for c in text)
    lowered = re.findall(r"[^\x20\x09-\x0D]+", low)
    lines = [x for x in low.split("\n") if x]
    runs = [tuple(lowered[i : i + 3]) for i in range(len(lowered) - 2)] or ([tuple(lowered)] if lowered else [])
    count = lambda s, of: sum(c in of for c in s)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letter = lambda c: c in upper or c in upper.lower() or ord(c) >= 128
    letters = sum(map(letter, text))
    symbols = "#$%&*+/<=>@\\^_`{|}~"
    over = lambda a, b: a / b if b else 0.0
    share = lambda test: over(sum(map(test, words)), len(words))
    return [
        len(text),
        len(words),
        len(lines),
        over(sum(map(len, words)), len(words)),
        over(len(words), len(lines)),
        max(map(len, words), default=0),
        over(count(text, upper), letters),
        over(count(text, "0123456789"), len(text)),
        over(count(text, ".,;:"), len(text)),
        over(count(text, "!?"), len(text)),
        over(count(text, "\"'()[]-"), len(text)),
        over(count(text, symbols), len(text)),
        over(sum(ord(c) >= 128 for c in text), len(text)),
        over(len(set(lowered)), len(words)),
        over(max(Counter(lowered).values(), default=0), len(words)),
        over(len(set(runs)), len(runs)),
        over(len(set(lines)), len(lines)),
        share(lambda w: all(map(letter, w))),
        share(lambda w: count(w, symbols) > 0),
        share(lambda w: count(w, "!?") > 0),
        share(lambda w: (n := sum(map(letter, w))) > 1 and count(w, upper) == n),
        share(lambda w: w[0] in upper),
        share(lambda w: len(w) <= 3),
        share(lambda w: w[-1] in ".,;:"),
    ]


def test_statistics_against_plain_ones(spark):
    texts = ["The cat, the CAT!! sat.\nthe cat, the cat!! sat.\n\nÄÖ übel |a| 12 x", "", None, " \n\t ", "a", "É", "日本 語。", "w " * 5000, "x" * 70000, "a\nb\na\nb", "$$ 5% (x) - 'y' [z]"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", rules.statistics(F.col("text")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.s) == pytest.approx(plain_statistics(texts[r.id]), abs=1e-12), texts[r.id]


def holds(rule, row):
    return all(low < row[name] <= high for name, low, high in rule)


def test_rules_become_columns(spark):
    a, b = (("chars", 3.0, math.inf), ("words", -math.inf, 2.0)), (("chars", 1.0, 9.0),)
    e = rules.Ensemble([(a, 1.5), (b, -2.0)], 0.25)
    rows = [(float(c), float(w)) for c in (0, 1, 3, 4, 9, 10) for w in (1, 2, 3)]
    df = spark.createDataFrame([Row(s=Row(chars=c, words=w)) for c, w in rows])
    for r in df.select("s", e.score().alias("score")).collect():
        z = 0.25 + sum(w for rule, w in e.weights if holds(rule, r.s.asDict()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert "chars" in str(e) and df.select(rules.Ensemble([], 0.0).score().alias("x")).first().x == 0.5


def test_fitted_rules_are_tree_paths_and_tell_held_out_rows_apart(spark):
    rng = np.random.default_rng(3)
    chars, words = rng.uniform(0, 100, 3000), rng.uniform(0, 50, 3000)
    label = ((chars > 40) & (words <= 20)).astype(float)
    zero = {s: 0.0 for s in rules.STATISTICS}
    kind = f"id long, s {rules.KIND_OF_STATISTICS}, label double"
    rows = [(i, tuple({**zero, "chars": float(c), "words": float(w)}.values()), float(y)) for i, (c, w, y) in enumerate(zip(chars, words, label))]
    df = spark.createDataFrame(rows, kind)
    e = rules.fit(df.where("id < 2000"), trees=3, depth=2)
    assert e.weights and any({n for n, _, _ in rule} == {"chars", "words"} for rule, _ in e.weights)
    out = df.where("id >= 2000").select("label", e.score().alias("score")).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in out) >= 0.97 * len(out)
    bounded = rules.fit(df, most=500, trees=2, depth=2)  # a bounded part of the rows will do
    assert sum((r.score >= 0.5) == (r.label == 1) for r in df.select("label", bounded.score().alias("score")).collect()) >= 0.9 * len(rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "good text here"), (2, None), (None, "x"), (3, ""), (4, "y " * 100000)], "doc_id long, text string").withColumn("score", F.lit("a")).withColumn("s", F.lit(1)).withColumn("id", F.lit(9)).withColumn("label", F.lit(2))
    every = F.lit(True)
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    scores = lambda lab, d=docs: sorted(r.score for r in rules.classify(d, lab, every)[0].collect())
    assert scores(labels()) == [0.5] * 6
    # two good rows of three labelled ones, then one more of each kind
    assert scores(labels((1, 1), (1, 1), (None, 0), (7, 0), (3, None))) == pytest.approx([3 / 4] * 6)
    assert scores(labels((2, 0))) == pytest.approx([1 / 3] * 6)
    assert scores(labels((1, 1)), docs.limit(0)) == []
    # of many labels about ``most`` are chosen; all rows have scores
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.col("id").cast("int")).alias("text"))
    some, e = rules.classify(many, spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") > 200).cast("int").alias("quality")), every, most=120)
    right = sum((r.score >= 0.5) == (r.id > 200) for r in some.collect())
    assert e.weights and 360 <= right <= 400
    mixed = scores(labels((1, 1), (1, 0), (2, 0), (4, 0), (4, 1)))  # means of a half count as good
    assert len(mixed) == 6 and all(0 < x < 1 for x in mixed)


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    out = op11_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    seen = [r for r in out if r.quality is not None and r.held_out]
    assert len(seen) > 40 and sum(r.predicted == r.quality for r in seen) >= 0.9 * len(seen)
