"""Counters over a fixed number of hash bins, summed over all partitions of an input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "block int, at binary, n binary"
BLOCK = 1 << 15


def blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """The bins of a task that aren't zero, by blocks of bins."""
    at = np.flatnonzero(counts)
    cuts = np.searchsorted(at, np.arange(0, len(counts) + 1, BLOCK))
    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if j > i:
            yield b, (at[i:j] - b * BLOCK).astype(np.uint16).tobytes(), counts[at[i:j]].astype(np.uint32).tobytes()


def total(rows: DataFrame, bins: int) -> np.ndarray:
    """Sums of all tasks' counters; what reaches the driver has ``bins`` numbers, however
    large the input."""
    parts = -(-bins // BLOCK)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                s = sums.setdefault(b, np.zeros(BLOCK, np.int64))
                s[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "at": pa.array([b""] * len(sums), pa.binary()), "n": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    out = np.zeros(parts * BLOCK, np.int64)
    for b, _, n in rows.repartition(parts, "block").mapInArrow(add, SCHEMA).toLocalIterator():
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(n, np.int64)
    return out[:bins]


def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    return (h >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)


def bit_table(hashes: DataFrame, bins: int) -> np.ndarray:
    """Packed bits of the bins that the 64-bit hashes of a one-column frame fall in."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bins, np.uint32)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seen[bin_of(h, bins)] = 1
        got = list(blocks(seen))
        if got:
            b, at, n = zip(*got)
            yield pa.RecordBatch.from_pydict({"block": pa.array(b, pa.int32()), "at": pa.array(at, pa.binary()), "n": pa.array(n, pa.binary())})

    return np.packbits(total(hashes.mapInArrow(mark, SCHEMA), bins) > 0)


def in_table(bits: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    at = bin_of(h, bins)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def id_filter(ids: DataFrame, column: str, bins: int = 1 << 22):
    """A column function that is true for all ids in ``ids`` and for few others: a table of
    ``bins`` bits, whatever the input.  Beyond some ids for each bit it lets more and more
    through, which costs time and drops nothing."""
    bits = ids.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64(column).alias("h")), bins))

    @F.arrow_udf("boolean")
    def may_have(column: pa.Array) -> pa.Array:
        return pa.array(in_table(bits.value, column.to_numpy(zero_copy_only=False).view(np.uint64), bins))

    return lambda c: may_have(F.xxhash64(c))
