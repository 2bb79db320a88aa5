"""Columns of numbers packed into binary rows, so that shuffles move few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def unpack(payloads: list[bytes], *kinds) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for out, kind in zip(parts, kinds):
            out.append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds)]


class Dealer:
    """Gathers equally long columns and deals them out to blocks of their first column's hash."""

    def __init__(self, blocks: int, rows: int = 500_000):
        self.blocks, self.rows, self.held, self.waiting = blocks, rows, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        """True if it is time to flush."""
        if len(columns[0]):
            self.held.append(columns)
            self.waiting += len(columns[0])
        return self.waiting >= self.rows

    def flush(self) -> pa.RecordBatch:
        if not self.held:
            return pa.RecordBatch.from_pydict({"block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        columns = [np.concatenate(x) for x in zip(*self.held)]
        self.held, self.waiting = [], 0
        block = ((columns[0].view(np.uint64) >> np.uint64(21)) % np.uint64(self.blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(self.blocks + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "payload": pa.array([pack(*(c[order[cuts[b] : cuts[b + 1]]] for c in columns)) for b in some], pa.binary())})


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted x, and its length at the end."""
    if not len(x):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


class Seen:
    """Remembers up to ``most`` names, so that a task sends what repeats once; beyond it some
    go again."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.names = most, np.zeros(0, np.uint64)

    def new(self, names: np.ndarray) -> np.ndarray:
        """Which of the names come here for the first time."""
        one, at = np.unique(names, return_index=True)
        fresh = np.ones(len(one), bool)
        if len(self.names) and len(one):
            fresh = self.names[np.minimum(np.searchsorted(self.names, one), len(self.names) - 1)] != one
        if len(self.names) < self.most:
            self.names = np.insert(self.names, np.searchsorted(self.names, one[fresh]), one[fresh])
        out = np.zeros(len(names), bool)
        out[at[fresh]] = True
        return out
