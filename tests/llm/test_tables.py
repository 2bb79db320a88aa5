"""Mixing, sharding and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, sharding
from quire.llm.queries import op3_mixing, op8_sharding

SF = "/root/testdata/sf0.001"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """By taking away what stops, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        stop = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not stop:
            out |= {s: weight[s] * level for s in free}
            break
        for s in stop:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= stop
    return out


def check_mix(rows, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += n_words(text)
    want = targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


@pytest.mark.parametrize("case", ["many", "tiny", "hot", "empty"])
def test_mix_reaches_targets(spark, case):
    docs = {
        "many": [(i, "w " * (i % 37), f"s{i % 9}" if i % 11 else None) for i in range(400)],
        "tiny": [(1, "a b c", "x"), (2, "d", "y"), (3, None, "z"), (3, "", "z"), (None, "e f", None), (1, "a b c", "x")],
        "hot": [(i, "w " * 50, "big" if i % 3 == 0 else f"s{i}") for i in range(90)],
        "empty": [],
    }[case]
    df = spark.createDataFrame([(i, t, s, 7, 8) for i, t, s in docs], "doc_id long, text string, source string, size int, ord int")
    runs = [sorted(map(tuple, mixing.taken(*mixing.mix(d, block=64)).collect()), key=str) for d in (df, df.repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == len(docs)
    check_mix(mixing.taken(*mixing.mix(df, block=64)).collect(), docs)


def test_mix_pieces_fill_slots(spark):
    docs = [(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    pieces, _, placed = mixing.mix(df, block=32)
    rows = pieces.collect()
    size = {r.id: r.size for r in placed.collect()}
    slots = defaultdict(int)
    for r in rows:
        assert 0 <= r["first"] and r["first"] + r.words <= size[r.id]
        slots[r.slot] += r.words
    assert max(slots.values()) == 32
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.ord].append(r.slot)
    half = max(slots) / 2  # each source is spread over the schedule
    assert all(0.3 < sum(s < half for s in v) / len(v) < 0.7 for v in by_source.values() if len(v) > 40)


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op3_mixing(spark, SF).join(docs.select("doc_id", "source"), "doc_id").collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_shards_are_whole_and_stable(spark):
    rows = op8_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.size == len(docs[r.doc_id].encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(rows) == sorted(op8_sharding(spark, SF).collect())


def test_one_more_shard_takes_records_only_into_itself(spark):
    now = {r.doc_id: r for r in op8_sharding(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, 41).collect()}
    assert grown == {i: r.grown_shard for i, r in now.items()} and 40 in grown.values()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[i].encode()) and r.law == "key" for i, r in now.items())


def test_shards_of_odd_rows(spark):
    rows = [(i, f"t{i}", "s", i) for i in range(200)] + [(None, None, "s", 0), (None, "x", "s", 0), (7, "dup", "s", 1), (7, "dup", "s", 1), (8, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    for size in (sharding.BUCKET_BYTES, 200):
        got = [sharding.shard(d, 3, bucket_bytes=size).collect() for d in (df, df.repartition(5))]
        assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
        slots = defaultdict(list)
        for r in got[0]:
            slots[r.shard].append(r.slot)
        assert len(got[0]) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(df.limit(0), 3).collect() == []
    one = sharding.shard(df, 1).orderBy("slot").collect()
    assert len(one) == len(rows) and [r.doc_id for r in one] != sorted(r.doc_id or 0 for r in one)


def odd_documents(spark, path):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}{chr(97 + i % 11)}" for i in range(60))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    leak = bench.first().text
    extra = [(9001, long, "en", "a", 1), (9002, long + " tail", "en", "b", 1), (9003, "the " + leak, "en", "a", 1), (9004, None, None, None, None), (9005, "123 456", "en", "a", 7), (None, "no id at all here", "en", "a", 1), (9006, "", "en", None, 0), (9001, long, "en", "a", 1)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from tests.llm.test_pairs import Union, gram_set

    odd_documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at = spark.createDataFrame(at.collect(), docs.schema)
        kept.append(at.collect())
    spoken = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert Counter(r.doc_id for r in kept[0]) == Counter(r.doc_id for r in spoken)
    u = Union()
    sets = [(r.doc_id, gram_set(r.text)) for r in kept[0] if r.doc_id is not None]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                u.join(i, j)
    least = defaultdict(list)
    for i, _ in sets:
        least[u.find(i)].append(i)
    want = {min(v) for v in least.values()} | {None}
    assert {r.doc_id for r in kept[1]} == want and 9002 not in want and 9001 in want
    gone = {r.doc_id for r in kept[1]} - {r.doc_id for r in kept[2]}
    assert 9003 in gone
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies) <= {r.doc_id for r in kept[2]} and max(copies.values()) <= 6
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert len(last) == len(kept[3])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 50
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("x")).where("x <> 0").count() == 0
    assert np.isfinite(out.count())


def test_clashing_names_and_empty_tables(spark):
    names = ["doc_id", "text", "source", "shard", "slot", "order", "_order", "bucket", "size", "may", "one", "n", "copies", "rank", "again", "language", "hits"]
    kinds = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names[3:])
    rows = [(i, f"some text of the number {i} and more", "ab"[i % 2], *range(len(names) - 3)) for i in range(30)]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], kinds)
    out = sharding.shard(df, 4)
    assert set(out.columns) == set(names) and out.count() == 32
    mixed = corpus_pipeline.source_mix(spark, df, SF)
    assert mixed.columns == names and mixed.count() > 0
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == names and kept.count() == 32  # rows of one id stay together
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.source_mix, corpus_pipeline.shards):
        empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
        assert stage(spark, empty, SF).collect() == []


def test_mix_stage_shares_copies_among_equal_rows(spark):
    """As many rows as the mix takes first words, also of rows that are equal."""
    rows = [(i // 3, "w " * (20 + i // 3 % 5), f"s{i // 3 % 3}") for i in range(120)] + [(5, "w " * 33, "s2"), (None, "w " * 9, "s1"), (7, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(map(tuple, corpus_pipeline.source_mix(spark, df, SF).collect()))
    keyed = df.withColumn("row", F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("h")))
    taken = defaultdict(int)
    for r in mixing.taken(*mixing.mix(keyed, id_col="row")).where("size > 0").collect():
        taken[(r.id.id, r.source, r.size)] += r.copies
    want = {(i, t, s): taken[(i, s, n_words(t))] if t else 1 for i, t, s in rows}
    assert got == Counter({k: v for k, v in want.items() if v})
