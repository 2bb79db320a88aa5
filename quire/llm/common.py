"""What the operators of this subpackage share: reading, staging, byte-level words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch sent to Python, so that batches of long texts stay small.
ARROW_ROWS = 512
#: Bytes of text that are hashed at once; a single longer text is hashed alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only where all run in one process may it
    be left unnamed; then it is a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if spark.conf.get("spark.quire.stage.dir", None) is None:
        import tempfile

        spark.conf.set("spark.quire.stage.dir", "file://" + tempfile.mkdtemp(prefix="quire-stage-"))
    return spark.conf.get("spark.quire.stage.dir")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table of the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and each
    row is computed once.  Lost executors don't matter to what is read later."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column is called so in any case."""
    had = {c.lower() for c in columns}
    while name.lower() in had:
        name = f"_{name}"
    return name


def release() -> None:
    """Give freed memory back: a worker that is reused keeps it otherwise, beside an
    executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- bytes, words, hashes -------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on a copy."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BYTE64 = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, CHUNK_BYTES + 4096, 2 * len(_POW) if len(_POW) < 1 << 22 else n)
        with np.errstate(over="ignore"):
            for name, base in (("_POW", _MULT), ("_INV", _MULT_INV)):
                x = np.full(n, base, U64)
                x[0] = 1
                globals()[name] = np.multiply.accumulate(x)
    return _POW, _INV


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] a polynomial hash of values[s:e], times a power of position s."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal for equal content wherever it stands."""
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[ends] - prefix[starts]) * inv[starts])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Bytes of [\x20\x09-\x0D]: what separates words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, off: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the number of its first word
    (one more entry than rows).  Words don't run over the ends of rows."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~separator[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    edge = off[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    edge = off[1:] - 1
    after[edge[edge >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z in lower case."""
    return span_hash(prefix_hash(_BYTE64[LOWER[raw]]), starts, ends)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their rows; a row with fewer words, but not none,
    has its whole sequence as one."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), n)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    end = np.minimum(begin + k, first[1:][row])
    return span_hash(prefix_hash(words), begin, end), row
