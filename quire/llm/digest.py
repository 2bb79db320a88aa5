"""Document fingerprints: quartile bucket digests.

Byte triplets of a sliding window of four bytes are hashed into buckets.  The digest has,
for each bucket, the quartile (of the document's own counts) that its count falls in, and
the logarithm of the length.  Digests are compared by a bounded difference score.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

BUCKETS = 256
#: Offsets of the triplets in a window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Of the score: the most for the length, and what a quartile's distance of 0, 1, 2, 3 counts.
LENGTH_MOST = 32
STEP = np.array([0, 1, 2, 4], np.int64)
MOST = LENGTH_MOST + int(STEP[3]) * BUCKETS

_A = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SALT = [np.uint32(x) for x in (0x165667B1, 0x27D4EB2F, 0x2545F491)]


def counts(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    x = raw.astype(np.uint32)
    for t, salt in zip(TRIPLETS, _SALT):
        n = len(x) - t[-1]
        if n > 0:
            h = (x[t[0] : t[0] + n] + salt) * _A[0]
            h ^= (x[t[1] : t[1] + n] * _A[1]) ^ (h >> np.uint32(15))
            h += x[t[2] : t[2] + n] * _A[2]
            h ^= h >> np.uint32(13)
            h *= _A[0]
            out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(text: str | bytes) -> str:
    """Two hexadecimal digits of length, then two bits a bucket; for equal texts equal."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
    c = counts(raw)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (c[:, None] > q[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    size = min(255, int(round(8 * np.log2(1 + len(raw)))))
    return f"{size:02x}{packed.tobytes().hex()}"


_PAIRS = np.array([[sum(int(STEP[abs((a >> s & 3) - (b >> s & 3))]) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    score = min(LENGTH_MOST, abs(int(x[0]) - int(y[0]))) + int(_PAIRS[x[1:], y[1:]].sum())
    return 1.0 - score / MOST


def fingerprint(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; a null text counts as empty.  Other columns stay (one
    named ``fingerprint`` is replaced); repeated rows, whole texts and empty tables are taken
    as they are."""
    small_batches(docs.sparkSession)
    return docs.withColumn("fingerprint", fingerprint_udf(F.col(text_col)))


def fingerprint_udf(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([digest(x.as_py() or "") for x in column], pa.string())

    return run(text)


#: Ranges of documents for each shuffle partition, so that partitions are about even, and
#: code points of a text that a range's key has.
RANGES, START = 8, 64


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, lead, has_id, id, start, text): documents by ranges of their order, with ``lead``
    true on a copy of the first document of the range after (the first of all after the
    last).

    The order is by id, nulls first, then by text.  Ranges are found by a pass over ids and
    the beginnings of texts (START code points), so an id that many rows have is cut into
    ranges as well; the driver gets the first key of each, RANGES for each shuffle partition.
    Besides the documents only one document a range is moved.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).isNotNull().alias("has_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.substring(text, 1, START).alias("start"), text.alias("text"))
    key = F.struct("has_id", "id", "start")
    ranged = base.select(key.alias("k")).repartitionByRange(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    firsts = sorted(tuple(r["m"]) for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("m")).collect())
    firsts = [x for i, x in enumerate(firsts) if i == 0 or x != firsts[i - 1]]
    shared = spark.sparkContext.broadcast(firsts)

    @F.arrow_udf("int")
    def part_of(has_id: pa.Array, number: pa.Array, start: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value, x) - 1 for x in zip(has_id.to_pylist(), number.to_pylist(), start.to_pylist())], pa.int32())

    own = base.select(part_of("has_id", "id", "start").alias("part"), F.lit(False).alias("lead"), "*")
    if not firsts:
        return own
    # of several documents with a range's first key, that with the least text leads
    heads = own.join(F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(firsts)], "before int, has_id boolean, id long, start string")), ["has_id", "id", "start"])
    heads = heads.groupBy("before", "has_id", "id", "start").agg(F.min("text").alias("text"))
    heads = heads.select(((F.col("before") + len(firsts) - 1) % len(firsts)).cast("int").alias("part"), F.lit(True).alias("lead"), "has_id", "id", "start", "text")
    return own.unionByName(heads)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (its last half replaced by the first
    as many code points of the next text) and the likeness of the first to the edited one
    and to the next document's.

    The next document is the next by id; null ids come first, and equal ids follow each
    other in the order of their texts.  The last is followed by
    the first, a single one by itself.  Null texts are empty; an empty text's edited text is
    empty, and two empty texts are alike (1).  Whole texts count, however long.  Repeated
    rows give a row each.  Other columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    d = with_next(docs, id_col, text_col)
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, fingerprint) that waits for the next

        def row(text: str, fp: str, following: str, fp_next: str, doc) -> tuple:
            e = edited(text, following)
            fe = digest(e)
            return (doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp, fe, likeness(fp, fe), likeness(fp, fp_next))

        for batch in batches:
            out = []
            for part, lead, has_id, number, text in zip(*(c.to_pylist() for c in batch.columns)):
                fp = digest(text)
                if held is not None and held[0] == part:
                    out.append(row(held[2], held[3], text, fp, held[1]))
                held = None if lead else (part, number if has_id else None, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ordered = d.repartition(parts, "part").sortWithinPartitions("part", "lead", "has_id", "id", "text")
    return ordered.select("part", "lead", "has_id", "id", "text").mapInArrow(run, EDITED)
