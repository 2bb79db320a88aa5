"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets of a size that fits in memory, by seeded
hashes; pass two shuffles each bucket (Fisher-Yates, seeded by the bucket) and gives out
slots.  The shard of a record follows from its id and the number of shards alone
(rendezvous hashing), so one more shard takes records only into itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, small_batches

BUCKET_BYTES = 32 << 20
SEED = 11
RECORD_OVERHEAD = 16


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_OVERHEAD


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is the highest."""
    scored = [F.struct(F.xxhash64(key, F.lit(j), F.lit(seed)).alias("h"), F.lit(j).alias("j")) for j in range(shards)]
    return (F.greatest(*scored) if shards > 1 else scored[0])["j"]


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each
    shard, in shuffled order).

    Null ids share one shard; null texts count 16 bytes.  Reruns give the same slots:
    buckets are put in the order of a hash of the whole row before they are shuffled, and
    rows equal in all columns are interchangeable.  Columns named ``shard`` or ``slot`` are
    replaced; all others stay, whatever their names.  Records are moved whole, however
    long: a bucket has at least one.  An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("shard", "slot")
    names = docs.columns
    order, size, bucket = (free_name([*names, "shard", "slot"], x) for x in ("order", "size", "bucket"))
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in names],
        shard_of(F.col(f"`{id_col}`"), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]).alias(order),
        record_bytes(F.col(f"`{text_col}`")).alias(size),
    )
    total = keyed.agg(F.sum(f"`{size}`")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, total / shards / bucket_bytes))))
    k = 1 << bits
    keyed = keyed.withColumn(bucket, (F.col("shard") * k + F.pmod(F.shiftright(order, 7), F.lit(k))).cast("long")).drop(size)
    counts = np.zeros(shards * k, np.int64)  # 8 bytes for each bucket of about bucket_bytes
    for r in keyed.groupBy(bucket).count().toLocalIterator():
        counts[r[0]] = r[1]
    offsets = (np.cumsum(counts.reshape(shards, k), axis=1) - counts.reshape(shards, k)).ravel()
    shared = spark.sparkContext.broadcast(offsets)
    out = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def pass_two(part: pa.Table) -> pa.Table:
        number = part[bucket][0].as_py()
        part = part.sort_by([(order, "ascending")])
        turn = np.arange(part.num_rows)
        np.random.Generator(np.random.PCG64([seed, number])).shuffle(turn)
        part = part.take(pa.array(turn)).drop_columns([order, bucket])
        return part.append_column("slot", pa.array(shared.value[number] + np.arange(len(turn)), pa.int64()))

    return keyed.groupBy(bucket).applyInArrow(pass_two, out)


def write_shards(sharded: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each shard, its records in the order of their slots."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(fmt).save(path)
