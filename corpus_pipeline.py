"""Documents to shuffled training shards: five stages, each of one operator of quire.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds
its own.  run() writes each stage's result to the shared folder and reads it again.
Documents may have other columns, whatever their names.  An empty table goes through all
stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import decontam, dense, langid, mixing, ngramjoin, sharding
from quire.llm.common import cut, free_name, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages, ``lang`` as predicted.  Texts that are
    null or have no letter have no language and go."""
    columns = docs.columns
    out = langid.identify(docs, langid.fit(docs))
    return out.where(F.col("language.lang") != langid.UNKNOWN).withColumn("lang", F.col("language.lang")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the least doc_id.  Rows
    with a null doc_id stay; rows with equal doc_ids stay or go together."""
    joined = cut(ngramjoin.join(docs.select("doc_id", "text")), "components")
    gone = joined.where("doc_id != component_id").select("doc_id").distinct()
    may = dense.id_filter(gone, "doc_id")
    mark = free_name(docs.columns, "may")
    marked = docs.withColumn(mark, F.coalesce(may(F.col("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull())
    clear = marked.where(~F.col(mark)).drop(mark)
    return clear.unionByName(marked.where(F.col(mark)).drop(mark).join(gone, "doc_id", "left_anti").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: whole texts are read, however
    long; equal documents stay or go together; null texts have no words and stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("hits.n_hit = 0").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their first word (not at all, up to three times).
    Rows without words stay once.  Rows are known by id, source and a hash of the text; of
    rows that are equal in these, each gets its share of what they are taken in all."""
    one, n, copies, rank, again = (free_name(docs.columns, x) for x in ("one", "n", "copies", "rank", "again"))
    row = F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("h"))
    keyed = docs.withColumn(one, row)
    counted = mixing.taken(*mixing.mix(keyed.select(F.col(one).alias("row"), "text", "source"), id_col="row"))
    counted = counted.where("size > 0").groupBy("id").agg(F.count("*").alias(n), F.sum("copies").alias(copies)).withColumnRenamed("id", again)
    # keys are made null-safe by their text form
    text_of = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    out = keyed.withColumn(one, text_of(one)).join(counted.withColumn(again, text_of(again)), F.col(one) == F.col(again), "left")
    single = out.where(F.coalesce(F.col(n), F.lit(1)) == 1).withColumn(copies, F.coalesce(F.col(copies), F.lit(1)))
    repeated = out.where(F.col(n) > 1).withColumn(rank, F.row_number().over(Window.partitionBy(one).orderBy(one)))
    repeated = repeated.withColumn(copies, F.expr(f"{copies} div {n} + if({rank} <= {copies} % {n}, 1, 0)")).drop(rank)
    every = single.unionByName(repeated).where(F.col(copies) > 0)
    return every.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it.  Repeated rows are each one record of
    their document's shard, in an order that the seed decides; long texts aren't cut."""
    return sharding.shard(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Suffix automata and the mix's seeded hashes have no SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None
