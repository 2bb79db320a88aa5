"""Line diffs of text pairs: Ratcliff-Obershelp opcodes, one pair at a time."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = "array<struct<t:string,n:int,a:string,b:string>>"


def line_ops(left: list[str], right: list[str], trim: bool = True) -> list[dict]:
    """eq with a count, del and add with a line; common ends are cut off first."""
    head = tail = 0
    if trim:
        most = min(len(left), len(right))
        while head < most and left[head] == right[head]:
            head += 1
        while tail < most - head and left[-1 - tail] == right[-1 - tail]:
            tail += 1
    a, b = left[head : len(left) - tail], right[head : len(right) - tail]
    same = lambda n: [{"t": "eq", "n": n, "a": None, "b": None}] if n else []
    out = same(head)
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out += same(j - i)
        else:
            out += [{"t": "del", "n": None, "a": x, "b": None} for x in a[i:j]] + [{"t": "add", "n": None, "a": None, "b": x} for x in b[k:m]]
    return out + same(tail)


def _udf(trim: bool):
    @F.arrow_udf(OPS)
    def ops(left: pa.Array, right: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32()), ("a", pa.string()), ("b", pa.string())]))
        return pa.array([line_ops((x or "").splitlines(), (y or "").splitlines(), trim) for x, y in zip(left.to_pylist(), right.to_pylist())], kind)

    return ops


def diff(pairs: DataFrame, *keys: str, left: Column | str = "raw", right: Column | str = "rebuilt", trim: bool = True) -> DataFrame:
    """(keys, seq, t, n, a, b): the ops that make the left text's lines the right's.  Null
    texts are empty."""
    return pairs.select(*keys, F.posexplode(_udf(trim)(left, right)).alias("seq", "op")).select(*keys, "seq", "op.*")


def stale(pairs: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """``pairs`` (keys, version, raw_lines, rebuilt_lines) with cached: whether ``cache`` has
    an entry of the same keys, version and numbers of lines; others are to be diffed anew."""
    same = [*keys, "version", "raw_lines", "rebuilt_lines"]
    have = cache.select(*same).distinct().withColumn("__have", F.lit(True))
    return pairs.join(have, same, "left").withColumn("cached", F.coalesce("__have", F.lit(False))).drop("__have")
