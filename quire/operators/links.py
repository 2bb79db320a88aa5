"""Image links to URLs: a line as alternating text and references, put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T

#: An image in either syntax, or a path in brackets, as other links to an image have.
TOKEN = rf"(?i){fixed.IMAGE_REF}|\((images/[^)\s]+)\)"
_MD, _IMG, _BARE = rf"(?i)^!\[[^\]]*\]\((images/[^)\s]+)\)$", r"(?i)^(<img\s+[^>]*src=[\"'])(images/[^\"']+)([\"'][^>]*>)$", r"(?i)^\((images/[^)\s]+)\)$"


def _target(token: Column) -> Column:
    """The path that a token refers to."""
    return F.when(F.startswith(token, F.lit("!")), F.regexp_extract(token, _MD, 1)).when(F.startswith(token, F.lit("(")), F.regexp_extract(token, _BARE, 1)).otherwise(F.regexp_extract(token, _IMG, 2))


def _pointed(token: Column, rel: Column, url: Column) -> Column:
    """A token with another target."""
    tag = F.concat(F.regexp_extract(token, _IMG, 1), url, F.regexp_extract(token, _IMG, 3))
    return F.when(F.startswith(token, F.lit("<")), tag).otherwise(F.concat(F.left(token, F.length(token) - F.length(rel) - 1), url, F.lit(")")))


def rewritten(lines: DataFrame, urls: DataFrame, book: str = "book_id", line: str = "line") -> DataFrame:
    """``lines`` with the images that ``urls`` (book, rel, url) has pointed to their URLs.
    Every row stays one row, and images without a URL keep their relative path.

    A path in brackets that isn't an image is rewritten if the same book has an image of that
    path, as readers expect of links to one.  Lines without references aren't moved; of the
    others each distinct reference of a book is looked up once by a join of equal keys.
    Of several URLs of one image the least counts; null URLs are none."""
    columns = lines.columns
    new, pos, token, rel, n = (F.col(c) for c in ("__new", "__pos", "__token", "__rel", "__n"))
    tokens = F.regexp_extract_all(F.col(line), F.lit(TOKEN), F.lit(0))
    marked = lines.withColumn("__tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    plain = marked.where(F.size("__tokens") == 0).select(*columns)
    each = marked.where(F.size("__tokens") > 0).select(F.struct(*columns).alias("__row"), F.col(book).alias("__book"), F.posexplode("__tokens").alias("__pos", "__token")).withColumn("__rel", _target(token))
    images = lines.select(F.col(book).alias("__b"), F.explode(T.image_refs(F.col(line))).alias("__r")).distinct()
    known = urls.where("url is not null").groupBy(F.col(book).alias("__b"), F.col("rel").alias("__r")).agg(F.min("url").alias("__url"))
    known = known.join(images, ["__b", "__r"], "left_semi")
    looked = each.join(known, (F.col("__book").eqNullSafe(F.col("__b"))) & (rel == F.col("__r")), "left")
    looked = looked.withColumn("__new", F.when(F.col("__url").isNull(), token).otherwise(_pointed(token, rel, F.col("__url"))))
    # rows that are equal in all columns are put together once and repeated
    whole = looked.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct(pos, new))).alias("__news"), F.count_if(pos == 0).alias("__n"))
    parts = F.split(F.col(f"__row.{line}"), TOKEN, -1)
    text = F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with("__news", F.slice(parts, 2, F.size(parts)), lambda a, b: F.concat(a["__new"], b)), ""))
    whole = whole.withColumn("__text", text).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    back = whole.select(*[F.col("__text").alias(c) if c == line else F.col(f"__row.`{c}`").alias(c) for c in columns])
    return plain.unionByName(back)
