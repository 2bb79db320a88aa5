"""Audits of catalogues, folders, images and baselines; all are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T


#: Characters that a folder's name has at most.
LONGEST_NAME = 255


def orphan_dirs(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """Folders (kind, name) whose b<id> prefix no catalogue entry (name) has."""
    known = catalog.select(T.dir_prefix(F.col("name")).alias("__p")).where("__p is not null").distinct()
    d = disk.withColumn("__q", T.dir_prefix(F.col("name"))).where("__q is not null")
    return d.join(known, F.col("__q") == F.col("__p"), "left_anti").select("kind", "name")


def missing_dirs(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, name) of catalogue entries without a folder of exactly their name."""
    kinds = disk.select("kind").distinct()
    want = catalog.where(T.dir_prefix(F.col("name")).isNotNull()).select("name").withColumn("kind", F.explode(F.array(F.lit("build"), F.lit("md"))))
    return want.join(disk.select("kind", "name"), ["kind", "name"], "left_anti").select("kind", "name")


def orphan_images(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files (book_id, rel, bytes) that no text of their own book refers to."""
    return files.join(refs.select("book_id", "rel").distinct(), ["book_id", "rel"], "left_anti")


def verify_golden(current: DataFrame, golden: DataFrame) -> DataFrame:
    """(name, verdict) of current samples (name, chapter_count, titles) against a baseline:
    new, count, titles or ok."""
    g = golden.select(F.col("name").alias("__n"), F.col("chapter_count").alias("__c"), F.col("titles").alias("__t"))
    joined = current.join(g, F.col("name") == F.col("__n"), "left")
    verdict = F.when(F.col("__n").isNull(), "new").when(F.col("chapter_count") != F.col("__c"), "count").when(F.col("titles") != F.col("__t"), "titles").otherwise("ok")
    return joined.select("name", verdict.alias("verdict"))


def match_vault(vault: DataFrame, structures: DataFrame) -> DataFrame:
    """For each vault folder (dir) the first structure folder (name), by name, whose title is
    a part of the folder's name.  The title is what follows the first underscore, or all.

    Parts of a folder's name as long as some title are looked up among the titles, so the
    join is one of equal keys; folder names have at most 255 characters.  A name has many
    parts, which Spark's estimate of sizes doesn't see: the join is sorted, as the parts
    would else be broadcast where the table of folders is small."""
    title = F.when(F.contains("name", F.lit("_")), F.regexp_replace("name", "^[^_]*_", "")).otherwise(F.col("name"))
    s = structures.select("name", title.alias("__t")).where("__t <> ''").groupBy("__t").agg(F.min("name").alias("name"))
    sizes = [r[0] for r in s.select(F.length("__t").alias("n")).distinct().where(f"n <= {LONGEST_NAME}").collect()]
    if not sizes:
        return vault.select("dir", F.lit(None).cast("string").alias("name")).limit(0)
    parts = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("dir") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length("dir")), lambda i: F.substr("dir", i, n)))))
    return vault.select("dir", F.explode(parts).alias("__t")).hint("merge").join(s, "__t").groupBy("dir").agg(F.min("name").alias("name"))


def incomplete_batches(content: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, batch_idx, missing) of batches whose content list names absent images."""
    want = content.select("book_id", "batch_idx", F.explode("content_list").alias("e")).select("book_id", "batch_idx", F.col("e.img_path").alias("rel")).where("rel is not null and rel <> ''")
    gone = want.join(files.select("book_id", "rel").distinct(), ["book_id", "rel"], "left_anti")
    return gone.groupBy("book_id", "batch_idx").agg(F.count_distinct("rel").alias("missing"))


def newest(df: DataFrame, keep: int, *order) -> DataFrame:
    """All but the ``keep`` first rows in an order, as what a retention rule deletes.  The
    rows kept are found by a top-k, the rest by a null-safe anti-join; of rows equal in all
    columns either all stay or all go."""
    kept = df.orderBy(*order).limit(keep).select(F.struct(*df.columns).alias("__kept")).distinct()
    return df.join(kept, F.struct(*df.columns).eqNullSafe(F.col("__kept")), "left_anti")


def cleanup_plan(disk: DataFrame, catalog: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(action, kind, name, bytes): what a clean-up would do, in one relation: folders and
    images without use to delete, and folders that are missing.  Nothing is deleted."""
    none = F.lit(None).cast("long").alias("bytes")
    dirs = orphan_dirs(disk, catalog).select(F.lit("delete_dir").alias("action"), "kind", "name", none)
    gone = missing_dirs(disk, catalog).select(F.lit("missing_dir").alias("action"), "kind", "name", none)
    images = orphan_images(files, refs).select(F.lit("delete_image").alias("action"), F.lit("md").alias("kind"), F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit("/"), "rel").alias("name"), "bytes")
    return dirs.unionByName(gone).unionByName(images)


def upload_plan(refs: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """(book_id, rel, action) of images referred to: failed if there is no file, skip if the
    store has the key, else upload."""
    there = files.select("book_id", "rel").distinct().withColumn("__there", F.lit(True))
    had = stored.select("book_id", "rel").distinct().withColumn("__stored", F.lit(True))
    j = refs.select("book_id", "rel").distinct().join(there, ["book_id", "rel"], "left").join(had, ["book_id", "rel"], "left")
    return j.select("book_id", "rel", F.when(F.col("__there").isNull(), "failed").when(F.col("__stored"), "skip").otherwise("upload").alias("action"))
