"""Batches, structures and listings in folders; zip bundles and vaults as sinks."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

CONTENT = "array<struct<type:string,text:string,page_idx:int,text_level:int,bbox:array<double>,img_path:string>>"


def _name() -> F.Column:
    return F.col("_metadata.file_path")


def load_batches(spark: SparkSession, path: str) -> DataFrame:
    """(book, batch_idx, page_start, page_end, text, content_list) of files
    <book>/batch_<i>_p<a>-<b>.md below ``path``.  Files without a page range are skipped; a
    missing or unreadable JSON beside a batch gives a null list."""
    parts = r"([^/]+)/batch_(\d+)_p(\d+)-(\d+)\.(?:md|json)$"

    def read(pattern: str) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
        at = F.url_decode(F.regexp_replace(_name(), r"\+", "%2B"))
        files = files.select("value", at.alias("p")).where(F.rlike("p", F.lit(parts)))
        return files.select("value", F.regexp_extract("p", parts, 1).alias("book"), *[F.regexp_extract("p", parts, n).cast("int").alias(c) for n, c in ((2, "batch_idx"), (3, "page_start"), (4, "page_end"))])

    lists = read("*.json").select("book", "batch_idx", "page_start", "page_end", F.from_json("value", CONTENT, {"mode": "PERMISSIVE"}).alias("content_list"))
    return read("*.md").withColumnRenamed("value", "text").join(lists, ["book", "batch_idx", "page_start", "page_end"], "left").select("book", "batch_idx", "page_start", "page_end", "text", "content_list")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def _path(spark: SparkSession, path: str):
    """A path of the shared file system, and that system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


#: Folders that books are dealt to.
BOOK_BUCKETS = 1024


def book_bucket(book_id: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(book_id.cast("long")), F.lit(BOOK_BUCKETS)).cast("int")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Trees in BOOK_BUCKETS folders.  The books of ``nodes`` replace themselves; others in
    the same folders stay, and other folders aren't touched."""
    spark, aside = nodes.sparkSession, None
    new = nodes.withColumn("bucket", book_bucket(F.col("book_id")))
    if _exists(spark, path):
        # what stays is written beside first, as a folder can't be read while it is replaced
        old = spark.read.parquet(path)
        touched = new.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(new.select("book_id").distinct(), "book_id", "left_anti")
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        new.unionByName(kept.select(*new.columns)).write.parquet(aside)
        new = spark.read.schema(new.schema).parquet(aside)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if aside:
        at, fs = _path(spark, aside)
        fs.delete(at, True)


def read_nodes(spark: SparkSession, path: str, book_id: int | None = None) -> DataFrame:
    """Trees as write_nodes leaves them; for one book only its folder is read."""
    trees = spark.read.parquet(path)
    if book_id is not None:
        trees = trees.where((F.col("bucket") == spark.range(1).select(book_bucket(F.lit(book_id))).first()[0]) & (F.col("book_id") == book_id))
    return trees.drop("bucket")


def write_structures(structures: DataFrame, path: str) -> None:
    """A JSON line for each book, with non-ASCII characters as they are."""
    structures.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


GOLDEN = "name string, book_id string, chapter_count int, titles array<string>, pages_covered string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A baseline: a JSON array of samples, or a sample a line."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a local one only where all run in
    one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/quire-files-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what is read several times is
    computed once, and lineage ends there."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def zip_bundles(files: DataFrame) -> DataFrame:
    """(book_id, zip) of (book_id, path, data): a bundle a book, members in order."""

    def bundle(book: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(book["path"].to_pylist(), book["data"].to_pylist())):
                z.writestr(zipfile.ZipInfo(name), data)
        return pa.Table.from_pydict({"book_id": book["book_id"][:1].cast(pa.int64()), "zip": pa.array([out.getvalue()], pa.binary())})

    return files.select("book_id", "path", "data").groupBy("book_id").applyInArrow(bundle, "book_id long, zip binary")


def unbundled(bundles: DataFrame) -> DataFrame:
    """(book_id, path, data) of the members of bundles."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        yield pa.RecordBatch.from_pydict({"book_id": pa.array([book], pa.int64()), "path": pa.array([name], pa.string()), "data": pa.array([z.read(name)], pa.binary())})

    return bundles.select("book_id", "zip").mapInArrow(members, "book_id long, path string, data binary")


def bundle_members(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, path, data) for a bundle: each document (book_id, path, md), and each image
    that it refers to and that exists (book_id, rel, data), once."""
    refs = docs.select("book_id", F.explode(T.image_refs(F.col("md"))).alias("rel")).distinct()
    images = files.join(refs, ["book_id", "rel"], "left_semi").select("book_id", F.col("rel").alias("path"), "data")
    return docs.select("book_id", "path", F.encode("md", "UTF-8").alias("data")).unionByName(images)
