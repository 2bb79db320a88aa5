"""Character references of all of HTML, decoded by the standard library in Arrow batches."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions.text import Decoding


@F.arrow_udf(StringType())
def _unescape(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else html.unescape(x) for x in column.to_pylist()], pa.string())


def unescape(text: Column) -> Column:
    """Texts without an ampersand don't go to Python's decoder in vain, but they do travel;
    use text.unescape_basic where the set of references is known."""
    return _unescape(text)


_CLOSED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[^\t\n\f <&#;]{1,32};)")


def closed(x: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0]), x)


@F.arrow_udf(StringType())
def _unescape_closed(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else closed(x) for x in column.to_pylist()], pa.string())


def unescape_closed(text: Column) -> Column:
    """As ``unescape``, but a reference must end with a semicolon: raw pages have addresses
    like ?a=1&copy=2, and cut texts like x&amp, which stay as they are."""
    return _unescape_closed(text)


def decoded(x):
    return None if x is None else html.unescape(x) if isinstance(x, str) else [decoded(y) for y in x]


@F.arrow_udf(ArrayType(StringType()))
def unescape_list(column: pa.Array) -> pa.Array:
    return pa.array(decoded(column.to_pylist()), pa.list_(pa.string()))


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def unescape_lists(column: pa.Array) -> pa.Array:
    return pa.array(decoded(column.to_pylist()), pa.list_(pa.list_(pa.string())))


ALL = Decoding(unescape, unescape_list, unescape_lists)
