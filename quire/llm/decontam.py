"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.  A window is
``window`` consecutive words of an item (the whole item if it has fewer).  The automaton's
symbols are words, numbered as the benchmark has them; it is built once, as arrays, and
broadcast.  A text is turned into symbols and scanned once: all pieces of a batch in step,
each with the last words of the piece before it.  Every occurrence of a window is mapped
back to word numbers and to code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, cut, release, small_batches, text_bytes, word_hashes, word_spans

WINDOW = 10
#: Windows in one automaton: at most WINDOW states each, of STATE_BYTES.  A larger benchmark
#: takes several automata, one pass over the texts for each.
BLOCK_WINDOWS = 400_000
STATE_BYTES = 8 + 4 + 4
#: Words that a piece of a text adds to the scan.
PIECE = 256
IS_GAP = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])

_TO_WORDS = bytes(32 if IS_GAP[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))
SPAN = "array<struct<start:long,end:long>>"
SCHEMA = f"struct<n_words:long,n_hit:long,items:array<string>,words:{SPAN},spans:{SPAN}>"
U64 = np.uint64


def normalised(text: str | None) -> bytes:
    """Lower-case words between spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


class Automaton:
    """States are numbered by depth; state i + 1 is where edge i leads, and edges are sorted
    as (state before, symbol).  ``least`` is the first state, along the links to shorter
    suffixes from each state itself, at which a window ends."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw, off = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = word_spans(raw, off, IS_GAP)
        hashes = word_hashes(raw, starts, ends)
        self.names = [i for i, _ in items]
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes)
        count = np.diff(first)
        n = np.where(count > 0, np.maximum(count - window, 0) + 1, 0)
        self.windows = int(n.sum())
        item = np.repeat(np.arange(len(items)), n)
        begin = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][item]
        length = np.minimum(count, window)[item]
        state, edges, states = np.zeros(len(item), np.int64), [np.zeros(0, np.int64)], 1
        for d in range(window):
            live = np.flatnonzero(length > d)
            new, at = np.unique(state[live] << 32 | symbols[begin[live] + d], return_inverse=True)
            state[live] = states + at
            edges.append(new)
            states += len(new)
        self.edges = np.concatenate(edges)
        self.root = np.zeros(len(self.vocabulary) + 1, np.int32)  # the last: a word no item has
        self.root[self.edges[: len(edges[1])] & 0xFFFFFFFF] = np.arange(1, len(edges[1]) + 1)
        self.shorter, self.least = np.zeros(states, np.int32), np.zeros(states, np.int32)
        self.least[state] = state
        at = len(edges[1])
        for new in edges[2:]:
            self.shorter[at + 1 : at + 1 + len(new)] = self.step(self.shorter[new >> 32].astype(np.int64), new & 0xFFFFFFFF)
            at += len(new)
        at = 0
        for new in edges[1:]:
            here = np.arange(at + 1, at + 1 + len(new))
            self.least[here] = np.where(self.least[here] == 0, self.least[self.shorter[here]], self.least[here])
            at += len(new)
        order = np.lexsort((item, state))
        self.of: dict[int, tuple[int, list[int]]] = {}
        for s, k, i in zip(state[order].tolist(), length[order].tolist(), item[order].tolist()):
            got = self.of.setdefault(s, (k, []))[1]
            if not got or got[-1] != i:
                got.append(i)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.edges, self.shorter, self.least, self.root, self.vocabulary))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            top = state == 0
            out[todo[top]] = self.root[symbol[top]]
            todo, state, symbol = todo[~top], state[~top], symbol[~top]
            key = state << 32 | symbol
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            went = self.edges[at] == key
            out[todo[went]] = at[went] + 1
            todo, state, symbol = todo[~went], self.shorter[state[~went]].astype(np.int64), symbol[~went]
        return out

    def scan(self, symbols: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end: places in ``symbols`` and the states there.  ``first`` has the
        first place of each text, and one more."""
        size = np.diff(first)
        lanes = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), lanes)
        begin = (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * PIECE
        end = np.minimum(begin + PIECE, size[row]) + first[:-1][row]
        lead = np.minimum(begin, window - 1)  # symbols of the piece before
        at = begin - lead + first[:-1][row]
        symbols = np.append(symbols, len(self.vocabulary))
        state = np.zeros(len(row), np.int64)
        places, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(PIECE + window - 1):
            symbol = symbols[np.where(at < end, at, len(symbols) - 1)]
            new = self.root[symbol].astype(np.int64)
            deep = np.flatnonzero(state)
            if len(deep):
                new[deep] = self.step(state[deep], symbol[deep])
            state = new
            hit = np.flatnonzero(self.least[state])
            hit = hit[i >= lead[hit]]
            if len(hit):
                places.append(at[hit])
                states.append(self.least[state[hit]].astype(np.int64))
            at = at + 1
        return np.concatenate(places), np.concatenate(states)


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scanned(column: pa.Array, before: list[dict | None], model: Automaton, window: int) -> list[dict]:
    """The hits of each text, with those that other automata found before."""
    raw, off = text_bytes(column)
    out: list[dict] = []
    for i, j in chunks(off):
        part, edge = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, edge, IS_GAP)
        hashes = word_hashes(part, starts, ends)
        symbols = np.full(len(hashes), len(model.vocabulary), np.int64)
        if len(model.vocabulary):
            at = np.minimum(np.searchsorted(model.vocabulary, hashes), len(model.vocabulary) - 1)
            symbols = np.where(model.vocabulary[at] == hashes, at, len(model.vocabulary))
        places, states = model.scan(symbols, first, window)
        order = np.argsort(places, kind="stable")
        places, states = places[order], states[order]
        cuts = np.searchsorted(places, first)
        for r in range(j - i):
            n = int(first[r + 1] - first[r])
            had = before[i + r]
            if cuts[r] == cuts[r + 1] and not (had and had["n_hit"]):
                out.append({"n_words": n, "n_hit": 0, "items": [], "words": [], "spans": []})
                continue
            change, items = np.zeros(n + 1, np.int64), set(had["items"] if had else [])
            for x in had["words"] if had else []:
                change[x["start"]] += 1
                change[x["end"]] -= 1
            for place, state in zip((places[cuts[r] : cuts[r + 1]] - first[r]).tolist(), states[cuts[r] : cuts[r + 1]].tolist()):
                while state:
                    k, of = model.of[state]
                    change[place + 1 - k] += 1
                    change[place + 1] -= 1
                    items.update(model.names[x] for x in of)
                    state = int(model.least[model.shorter[state]])
            hit = np.cumsum(change)[:-1] > 0
            lead = np.cumsum((part[edge[r] : edge[r + 1]] & 0xC0) != 0x80)  # code points up to each byte
            a, b = runs_of(hit)
            chars = [{"start": int(lead[starts[first[r] + x] - edge[r]]) - 1, "end": int(lead[ends[first[r] + y - 1] - 1 - edge[r]])} for x, y in zip(a, b)]
            out.append({"n_words": n, "n_hit": int(hit.sum()), "items": sorted(items), "words": [{"start": int(x), "end": int(y)} for x, y in zip(a, b)], "spans": chars})
    return out


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[Automaton]:
    """Automata of at most about ``most`` windows, of which the driver holds one at a time;
    a longer item is cut into pieces that overlap by window - 1 words."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull())
    held: list[tuple[str, str]] = []
    size = 0
    for item, text in rows.orderBy(F.col(item_col).cast("string"), text_col).toLocalIterator():
        words = normalised(text).split()
        for i in range(0, max(len(words) - window + 1, 1), most):
            part = words[i : i + most + window - 1]
            n = max(len(part) - window, 0) + 1
            if held and size + n > most:
                yield Automaton(held, window)
                held, size = [], 0
            held.append((item, b" ".join(part).decode("utf-8", "surrogatepass")))
            size += n
    yield Automaton(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``hits``: struct of n_words, n_hit, items (sorted strings), words (runs
    of hit words, from and to) and spans (the same in code points of the original text).

    Null or empty text: no words, no hits, empty lists.  Null items or item texts match
    nothing; items with equal ids are one.  Whole texts are scanned, however long.  Rows keep
    all their columns whatever their names (a column named ``hits`` is replaced); repeated
    rows are each scanned.  An empty benchmark hits nothing; an empty table gives an empty
    one.  A benchmark of more than ``block_windows`` windows takes several automata: each is
    built, broadcast, used in one pass over the texts, whose result is written to the shared
    folder, and freed before the next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = automata(benchmark, item_col, item_text_col, window, block_windows)
    model, out = next(rest), docs.withColumn("hits", F.lit(None).cast(SCHEMA))
    while model is not None:
        shared = spark.sparkContext.broadcast(model)
        out = out.withColumn("hits", hits_of(shared, window)(F.col(text_col), F.col("hits")))
        model = next(rest, None)
        if model is not None:
            out = cut(out, "hits")
            shared.unpersist()
    return out


def hits_of(shared, window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), *((x, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for x in ("words", "spans"))])

    @F.arrow_udf(SCHEMA)
    def hits(column: pa.Array, before: pa.Array) -> pa.Array:
        out = pa.array(scanned(column, before.to_pylist(), shared.value, window), kind)
        release()
        return out

    return hits
