"""Line dedup by a segment-partition edit join.

A line is cut into EDITS + 1 segments; of two lines within EDITS edits, a substring of the
longer at a bounded shift equals a segment of the shorter.  Segments and substrings (with
the length of the line that the segment is of) meet in runs of equal hashes, dealt to blocks.
Lines whose character counts differ from all others of a run by more than the edits can
explain leave it there.  The texts of the others are brought to their runs, where a banded
bit-parallel automaton compares all pairs whose character counts are near.  Of the runs that
two lines share, the one with the least key compares them, so each pair is compared and each
link counted once.  What leaves a block are each line's number of links and the links of a
spanning forest, for the classes; never the pairs.

A run of over RUN lines is dealt to pieces, and any two pieces meet in one place.

Lines are the parts of a text between line feeds; empty ones don't count.  Equal lines are
one class.  Lines within as many edits as the shorter one allows are linked, and connected
lines are one class.  From MIN_CHARS code points on that's EDITS; below it falls with length,
to one edit in ten code points, so that lines of less than ten are duplicates only of equal
ones.  Each number of edits has its own segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import dense
from quire.llm.blobs import Dealer, Seen, pack, runs, unpack
from quire.llm.common import chunks, cut, mix64, prefix_hash, release, small_batches, span_hash, text_bytes
from quire.llm.ngramjoin import components

EDITS = 2
#: Code points of a line that allows all EDITS.
MIN_CHARS = 20
BLOCK_ENTRIES = 2_000_000
#: Lines of a run, or of a piece of it, that are compared in one place.
RUN = 4096
#: Comparisons of letters in a run, up to which lines without a near one are found at once.
LETTER_PAIRS = 4_000_000
#: Pairs of lines whose letters are compared at once, and whose edits are; fewer than FEW of
#: them, and lines longer than WIDE, are compared one by one.
PAIRS, TOGETHER, FEW, WIDE = 1 << 17, 1 << 13, 64, 512
#: Bytes of packed lines that a task holds before it deals them out.
HELD_BYTES = 8 << 20
BINS = 1 << 22
U64 = np.uint64


def lines_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some texts; and of each non-empty line its row, start and end."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = lead[off]
    n = len(points)
    breaks = np.flatnonzero(points == 10)
    starts = np.unique(np.concatenate([edge[:-1], breaks + 1]))
    starts = starts[starts < n]
    feed = np.append(breaks, n)[np.searchsorted(breaks, starts)]
    ends = np.minimum(feed, edge[np.minimum(np.searchsorted(edge, starts, side="right"), len(edge) - 1)])
    some = ends > starts
    starts, ends = starts[some], ends[some]
    return points, np.searchsorted(edge, starts, side="right") - 1, starts, ends


def hashed(points: np.ndarray) -> np.ndarray:
    return prefix_hash(mix64(points.astype(U64) + U64(1)))


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines; the last segments are the longer ones."""
    short = length // (edits + 1)
    longer = length % (edits + 1)
    lead = np.maximum(i - (edits + 1 - longer), 0)
    return i * short + lead, short + (i >= edits + 1 - longer)


def allowed(length: np.ndarray, edits: int, least: int) -> np.ndarray:
    """Edits between lines of these lengths and others as long or longer."""
    return np.minimum(edits, length * edits // least)


def tiers(edits: int, least: int) -> list[tuple[int, int, int]]:
    """(edits, shortest, longest): lengths that allow as many edits, one or more."""
    low = [-(-e * least // edits) for e in range(1, edits + 1)]
    return list(zip(range(1, edits + 1), low, [*(x - 1 for x in low[1:]), 1 << 62]))


def shifts(i: int, less: int, edits: int) -> range:
    """Of segment i of a line, in another that has ``less`` code points more."""
    return range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)


def probes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(lines, keys, part, less): of each line its segments (part 3: they are looked for and
    found) and the substrings that may equal a segment of a line as long or shorter, by
    ``less`` code points (1); for segments of lines of least to most code points."""
    size = ends - starts
    for less in range(edits + 1):
        other = size - less
        ok = np.flatnonzero((other >= least) & (other <= most))
        for i in range(edits + 1):
            at, n = segment(other[ok], i, edits)
            for shift in shifts(i, less, edits):
                begin = at + shift
                fits = (begin >= 0) & (begin + n <= size[ok])
                k = ok[fits]
                b = starts[k] + begin[fits]
                key = mix64(span_hash(prefix, b, b + n[fits]) + U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + other[k].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                yield k, key, 3 if less == 0 and shift == 0 else 1, less


def letter_counts(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight counters of code points, modulo 256, in 64 bits: an edit moves two at most."""
    n = ends - starts
    line = np.repeat(np.arange(len(starts)), n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + starts[line]
    p = points[at]
    bucket = ((p * np.uint32(0x9E3779B1)) >> np.uint32(29)).astype(np.int64)
    return np.bincount(line * 8 + bucket, minlength=8 * len(starts)).astype(np.uint8).reshape(-1, 8)


def sign(docs: DataFrame, edits: int, least: int, parts: int) -> DataFrame:
    """(doc_id, doc, names) of each text's lines, and (block, payload) of keys to match."""

    levels = tiers(edits, least)
    shortest = min((low for _, low, _ in levels), default=1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Dealer(parts)
        seen = Seen()

        def out(rows=None, blocks=None) -> pa.RecordBatch:
            ids, doc, names = rows or (pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())))
            a, b = len(ids), blocks.num_rows if blocks else 0
            block, payload = (blocks.column(0), blocks.column(1)) if blocks else (pa.array([], pa.int32()), pa.array([], pa.binary()))
            columns = [(ids.cast(pa.int64()), pa.nulls(b, pa.int64())), (doc, pa.nulls(b, pa.int64())), (names, pa.nulls(b, pa.list_(pa.int64()))), (pa.nulls(a, pa.int32()), block), (pa.nulls(a, pa.binary()), payload)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], names=["doc_id", "doc", "names", "block", "payload"])

        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            every, counts = [], []
            for i, j in chunks(off):
                points, row, starts, ends = lines_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                prefix = hashed(points)
                name = span_hash(prefix, starts, ends)
                every.append(name.view(np.int64))
                counts.append(np.bincount(row, minlength=j - i))
                starts, ends, name = (x[ends - starts >= shortest] for x in (starts, ends, name))
                new = seen.new(name)
                starts, ends, name = starts[new], ends[new], name[new]
                letters = letter_counts(points, starts, ends).view(U64).ravel()
                for level in levels:
                    for k, key, part, _ in probes(prefix, starts, ends, *level):
                        if deal.add(key, name[k], letters[k], np.full(len(k), part, np.uint8)):
                            yield out(blocks=deal.flush())
            if every:
                at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                yield out((batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(every)))))
        yield out(blocks=deal.flush())

    return docs.mapInArrow(run, "doc_id long, doc long, names array<long>, block int, payload binary")


def near_letters(left: np.ndarray, right: np.ndarray, edits: int) -> np.ndarray:
    """Whether letter counts allow that many edits."""
    d = np.abs(left.view(np.uint8).astype(np.int16) - right.view(np.uint8)).reshape(-1, 8)
    return np.minimum(d, 256 - d).sum(axis=1) <= 2 * edits


def accompanied(edge: np.ndarray, n: np.ndarray, found: np.ndarray, name: np.ndarray, letters: np.ndarray, edits: int) -> np.ndarray:
    """Whether each entry has, in its run, a segment of another line with nearly its
    letters, or is such a segment; runs with too many pairs pass whole.  The ``found``
    segments of a run are at its end."""
    some = np.zeros(len(name), bool)
    work = n * found
    wide = (found > 0) & (n > 1) & (work > LETTER_PAIRS)
    some[np.repeat(wide, n)] = True
    both = np.flatnonzero((found > 0) & (n > 1) & ~wide)
    total = np.cumsum(work[both])
    i = 0
    while i < len(both):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LETTER_PAIRS, side="right")))
        g = np.repeat(both[i:j], work[both[i:j]])
        k = np.arange(len(g)) - np.repeat(np.cumsum(work[both[i:j]]) - work[both[i:j]], work[both[i:j]])
        left, right = edge[g] + k // found[g], edge[g + 1] - found[g] + k % found[g]
        ok = name[left] != name[right]
        left, right = left[ok], right[ok]
        ok = near_letters(letters[left], letters[right], edits)
        some[left[ok]] = True
        some[right[ok]] = True
        i = j
    return some


def gathered(edits: int, parts: int):
    """Of one block: (block, payload) of name, run and lines of the run, for lines that have
    a key and nearly the letters of another."""

    def run(block: pa.Table) -> pa.Table:
        key, name, letters, part = unpack(block["payload"].to_pylist(), U64, U64, U64, np.uint8)
        order = np.lexsort((name, part, key))
        key, name, letters, part = (x[order] for x in (key, name, letters, part))
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (part[1:] != part[:-1])
        key, name, letters, part = (x[keep] for x in (key, name, letters, part))
        edge = runs(key)
        found = np.add.reduceat((part == 3).astype(np.int64), edge[:-1]) if len(key) else np.zeros(0, np.int64)
        some = accompanied(edge, np.diff(edge), found, name, letters, edits) if len(key) else np.zeros(0, bool)
        key, name = key[some], name[some]
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[keep], name[keep]
        edge = runs(key)
        deal = Dealer(parts)
        deal.add(name, key, np.repeat(np.diff(edge), np.diff(edge)).astype(np.int32) if len(key) else np.zeros(0, np.int32))
        release()
        return pa.Table.from_batches([deal.flush()])

    return run


def wanted(block: pa.Table) -> pa.Table:
    """Of one block: (name, keys), each line once with its packed runs."""
    name, key, size = unpack(block["payload"].to_pylist(), U64, U64, np.int32)
    order = np.lexsort((key, name))
    name, key, size = (x[order] for x in (name, key, size))
    edge = runs(name) if len(name) else np.zeros(1, np.int64)
    pieces = list(zip(edge[:-1], edge[1:]))
    return pa.Table.from_pydict({"name": pa.array([int(name[a].view(np.int64)) for a, _ in pieces], pa.int64()), "keys": pa.array([pack(key[a:b], size[a:b]) for a, b in pieces], pa.binary())})


def texts_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(name, line) of the lines whose names the bit table may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            names, texts = [], []
            for i, j in chunks(off):
                points, _, starts, ends = lines_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                name = span_hash(hashed(points), starts, ends)
                some = dense.in_table(shared.value, name, BINS) if len(name) else np.zeros(0, bool)
                starts, ends, name = starts[some], ends[some], name[some]
                new = np.flatnonzero(seen.new(name))
                names += name[new].view(np.int64).tolist()
                texts += [points[starts[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass") for k in new]
            yield pa.RecordBatch.from_pydict({"name": pa.array(np.array(names, np.int64)), "line": pa.array(texts, pa.string())})

    return docs.mapInArrow(run, "name long, line string")


#: Columns for which the letters' places are kept at once, and characters compared at once.
COLUMNS, STEP = 64, 4096


def common(a: str, b: str) -> int:
    """Characters that both begin with."""
    i, most = 0, min(len(a), len(b))
    while i < most and a[i : i + STEP] == b[i : i + STEP]:
        i += STEP
    i = min(i, most)
    while i < most and a[i] == b[i]:
        i += 1
    return i


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: after what both ends have in common
    goes, bits for the diagonals of a band, one word for each number of edits.  Places of
    letters are kept for the part of the band that is being gone through, so a line takes
    time in proportion to its length and the band."""
    if abs(len(a) - len(b)) > edits:
        return False
    i = common(a, b)
    a, b = a[i:], b[i:]
    j = common(a[::-1], b[::-1])
    a, b = a[: len(a) - j], b[: len(b) - j]
    band = (1 << (2 * edits + 1)) - 1
    state = [((1 << (d + 1)) - 1) << edits & band for d in range(edits + 1)]
    for first in range(0, len(b), COLUMNS):
        place: dict[str, int] = {}
        base = first - edits
        for k in range(max(base, 0), min(len(a), first + COLUMNS + edits)):
            place[a[k]] = place.get(a[k], 0) | 1 << k - base
        for j, c in enumerate(b[first : first + COLUMNS]):
            equal = place.get(c, 0) >> j & band
            now: list[int] = []
            for d in range(edits + 1):
                x = state[d] & equal
                if d:
                    x |= state[d - 1] >> 1 | state[d - 1] | now[d - 1] << 1
                now.append(x & band)
            state = now
            if not state[edits]:
                return False
    return bool(state[edits] >> (len(a) - len(b) + edits) & 1)


def all_within(texts: list[str], x: np.ndarray, y: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """``within`` of the pairs (x, y) of lines, y as long or longer, each with its number of
    edits: the same band, a column of all pairs at a time."""
    out = np.zeros(len(x), bool)
    if len(x) < FEW:
        out[:] = [within(texts[u], texts[v], d) for u, v, d in zip(x.tolist(), y.tolist(), edits.tolist())]
        return out
    one, who = np.unique(np.concatenate([x, y]), return_inverse=True)
    size = np.array([len(texts[i]) for i in one], np.int64)
    most, longest = int(edits.max()), int(size.max())
    alone = (size[who[len(x) :]] > WIDE) | (edits > 3)  # eight bits hold a band of 3 edits
    if alone.any():
        for k in np.flatnonzero(alone).tolist():
            out[k] = within(texts[x[k]], texts[y[k]], int(edits[k]))
        out[~alone] = all_within(texts, x[~alone], y[~alone], edits[~alone])
        return out
    points = np.array([texts[i] for i in one], f"U{longest}").view(np.uint32).reshape(len(one), longest)
    points[np.arange(longest) >= size[:, None]] = 1 << 31
    columns = np.full((longest + 2 * most, len(one)), 1 << 31, np.uint32)
    columns[most : most + longest] = points.T
    width, band = 2 * most + 1, np.uint8((1 << (2 * most + 1)) - 1)
    a, b, at = who[: len(x)], who[len(x) :], np.arange(len(x))
    left, right, end = columns[:, a], columns[most:, b], size[b]
    last = size[a] - end + most
    state = [np.full(len(x), ((1 << (d + 1)) - 1) << most, np.uint8) & band for d in range(most + 1)]
    for j in range(longest):
        equal = np.zeros(len(at), np.uint8)
        for p in range(width):
            equal |= (left[j + p] == right[j]).view(np.uint8) << np.uint8(p)
        now: list[np.ndarray] = []
        for d in range(most + 1):
            bits = state[d] & equal
            if d:
                bits |= state[d - 1] >> np.uint8(1) | state[d - 1] | now[d - 1] << np.uint8(1)
            now.append(bits & band)
        state = now
        done = np.flatnonzero(end == j + 1)
        out[at[done]] = np.stack(state)[edits[at[done]], done] >> last[done] & 1 if len(done) else False
        live = np.flatnonzero((state[most] != 0) & (end > j + 1))
        if not len(live):
            break
        if 2 * len(live) < len(at):
            left, right, end, last, at, state = left[:, live], right[:, live], end[live], last[live], at[live], [w[live] for w in state]
    return out


def placed(docs: DataFrame, parts: int) -> DataFrame:
    """(block, payload): lines (name, line, keys) packed for their runs.

    A run of over RUN lines has pieces: a line goes to each pair of its own and another, and
    to its own alone (see ``side_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int, bytes]]] = {}
        waiting = 0

        def flush() -> pa.RecordBatch:
            payload = [packed_lines(x) for x in held.values()]
            out = pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "payload": pa.array(payload, pa.binary())})
            held.clear()
            return out

        for batch in batches:
            for name, line, keys in zip(*(c.to_pylist() for c in batch.columns)):
                key, size = unpack([keys], U64, np.int32)
                text = line.encode("utf-8", "surrogatepass")
                pieces = -(-size.astype(np.int64) // RUN)
                own = (mix64(np.array([name], np.int64).view(U64)) % pieces.astype(U64)).astype(np.int64)
                k = np.repeat(np.arange(len(key)), pieces)
                other = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                key, own = key[k], own[k]
                pair = np.minimum(own, other) * pieces[k] + np.maximum(own, other)
                side = side_of(own, other)
                place = mix64(key ^ mix64(pair.astype(U64) + U64(1)))
                block = ((place >> U64(21)) % U64(parts)).astype(np.int64)
                for b in np.unique(block):
                    here = block == b
                    held.setdefault(int(b), []).append((key[here], pair[here], side[here], name, text))
                waiting += len(k) * (len(text) + 32)
                if waiting >= HELD_BYTES:
                    yield flush()
                    waiting = 0
        yield flush()
        release()

    return docs.select("name", "line", "keys").mapInArrow(run, "block int, payload binary")


def side_of(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """0: a line of the first of two pieces, compared with those of the second (1); 2: of a
    piece alone, compared with all of it."""
    return np.where(own == other, 2, own > other).astype(np.uint8)


def packed_lines(lines: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, bytes]]) -> bytes:
    """Run, pieces, side, name and size in bytes of each line, then the lines."""
    n = np.array([len(x[0]) for x in lines])
    texts = [x[4] for x in lines]
    size = np.array([len(t) for t in texts], np.int64)
    key, pair, side = (np.concatenate([x[i] for x in lines]) for i in range(3))
    return pack(key, pair, side, np.repeat(np.array([x[3] for x in lines], np.int64), n), np.repeat(size, n)) + b"".join(t for t, m in zip(texts, n) for _ in range(m))


def unpacked_lines(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """Run, pieces, side and name of each line, and each name's line."""
    texts: dict[int, str] = {}
    kinds = U64, np.int64, np.uint8, np.int64, np.int64
    for p in payloads:
        *_, name, size = unpack([p], *kinds)
        at = np.concatenate([[0], np.cumsum(size)]) + len(p) - int(size.sum())
        for k in np.unique(name, return_index=True)[1].tolist():
            if int(name[k]) not in texts:
                texts[int(name[k])] = p[at[k] : at[k + 1]].decode("utf-8", "surrogatepass")
    key, pair, side, name, _ = unpack(payloads, *kinds)
    return key, pair, side, name, texts


def marks(texts: list[str], edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its letters; the keys of its segments; and by ``less`` the keys that
    segments of a line as much shorter may have (0: none)."""
    n = len(texts)
    letters, own = np.zeros(n, U64), np.zeros((n, edits + 1), U64)
    keys = np.zeros((n, edits + 1, max(sum(len(shifts(i, less, e)) for i in range(e + 1)) for e in range(edits + 1) for less in range(e + 1))), U64)
    size = np.array([len(t) for t in texts], np.int64)
    for a, b in chunks(np.concatenate([[0], np.cumsum(size)])):
        points = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(size[a:b])
        starts = ends - size[a:b]
        letters[a:b] = letter_counts(points, starts, ends).view(U64).ravel()
        prefix = hashed(points)
        for level in tiers(edits, least):
            slot, segments = [0] * (edits + 1), 0
            for k, key, part, less in probes(prefix, starts, ends, *level):
                keys[a + k, less, slot[less]] = key
                slot[less] += 1
                if part == 3:
                    own[a + k, segments] = key
                    segments += 1
    return letters, own, keys


def least_shared(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least of the segments' keys that are among the others; beyond all keys if none is."""
    hit = (own[:, :, None] == keys[:, None, :]).any(axis=2) & (own != 0)
    return np.where(hit, own, ~U64(0)).min(axis=1)


def met(edge: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of lines that a run compares, some at once."""
    n = np.diff(edge)
    end = np.repeat(edge[1:], n)
    at = np.arange(len(side))
    second = end - np.repeat(np.add.reduceat((side == 1).astype(np.int64), edge[:-1]), n)
    first = np.where(side == 2, at + 1, np.where(side == 0, second, end))
    work = end - first
    total = np.cumsum(work)
    i = 0
    while i < len(side):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
        left = np.repeat(at[i:j], work[i:j])
        yield left, first[left] + np.arange(len(left)) - np.repeat(np.cumsum(work[i:j]) - work[i:j], work[i:j])
        i = j


def linked(edits: int, least: int):
    """Of one block: (a, b, n): lines a with their numbers n of links that are found here
    (b is null), and links (a, b) that connect all lines with links (n is null)."""

    def run(block: pa.Table) -> pa.Table:
        key, pair, side, name, texts = unpacked_lines(block["payload"].to_pylist())
        order = np.lexsort((name, side, pair, key))
        key, pair, side, name = (x[order] for x in (key, pair, side, name))
        one, who = np.unique(name, return_inverse=True)
        line = [texts[int(x)] for x in one]
        size = np.array([len(t) for t in line], np.int64)
        letters, own, keys = marks(line, edits, least)
        above = list(range(len(one)))

        def top(x: int) -> int:
            while (y := above[x]) != x:
                above[x] = above[y]
                x = y
            return x

        count = np.zeros(len(one), np.int64)
        found: list[tuple[int, int]] = []
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        for left, right in met(np.append(np.flatnonzero(new), len(key)), side) if len(key) else ():
            x, y = who[left], who[right]
            at = np.flatnonzero(np.abs(size[x] - size[y]) <= edits)
            at = at[near_letters(letters[x[at]], letters[y[at]], edits)]
            x, y, run_of = x[at], y[at], key[left[at]]
            swap = size[x] > size[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            less = size[y] - size[x]
            shared = np.minimum(least_shared(own[x], keys[y, less]), np.where(less == 0, least_shared(own[y], keys[x, 0]), ~U64(0)))
            here = shared == run_of
            x, y = x[here], y[here]
            most = allowed(size[x], edits, least)
            near = [all_within(line, *(c[i : i + TOGETHER] for c in (x, y, most))) for i in range(0, len(x), TOGETHER)]
            near = np.concatenate(near) if near else np.zeros(0, bool)
            x, y = x[near], y[near]
            count += np.bincount(x, minlength=len(one)) + np.bincount(y, minlength=len(one))
            for u, v in zip(x.tolist(), y.tolist()):
                if (p := top(u)) != (q := top(v)):
                    above[max(p, q)] = min(p, q)
                    found.append((u, v))
        release()
        some = np.flatnonzero(count)
        ends = one[np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)]
        links, counts = pa.nulls(len(ends), pa.int64()), pa.nulls(len(some), pa.int64())
        columns = [(pa.array(one[some]), pa.array(ends[:, 0])), (counts, pa.array(ends[:, 1])), (pa.array(count[some]), links)]
        return pa.Table.from_arrays([pa.concat_arrays(x) for x in columns], names=["a", "b", "n"])

    return run


def near_lines(docs: DataFrame, edits: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, doc, names) of the texts; (node, n_links) of the names of lines with links to
    different lines; and (node, comp), their classes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // 25 // BLOCK_ENTRIES))  # about a key for every 25 bytes
    signed = cut(sign(docs.select("doc_id", "doc", "text"), edits, least, parts), "signed")
    blocks = signed.where("block is not null").select("block", "payload")
    spread = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = blocks.groupBy("block").applyInArrow(gathered(edits, spread), "block int, payload binary")
    names = cut(names.groupBy("block").applyInArrow(wanted, "name long, keys binary"), "names")
    texts = texts_of(docs.select("text"), dense.bit_table(names.select("name"), BINS)).groupBy("name").agg(F.min("line").alias("line"))
    found = cut(placed(texts.join(names, "name"), spread).groupBy("block").applyInArrow(linked(edits, least), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return signed.where("block is null").select("doc_id", "doc", "names"), counts, components(found.where("b is not null").select("a", "b"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """One row for each non-empty line: doc_id, line_no (from 0, empty lines not counted),
    class_doc_id and class_line_no (the first line of its class, by doc_id, nulls first, a
    hash of the text, and place), n_links and keep (it is that first line).

    ``n_links`` counts all links of the line, to different lines; copies of one line count once.

    Null and empty texts have no lines, and an empty table has no rows.  Lines are compared
    whole, however long.  Of rows that repeat an id and text, one keeps its lines; an id's
    different texts are documents of their own.  Other columns are ignored, whatever their
    names.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("doc"), "text")
    rows, counts, labels = near_lines(base, edits, least)
    once = rows.groupBy("doc_id", "doc").agg(F.first("names").alias("names"), F.count("*").alias("n"))
    lines = once.select("doc_id", "doc", "n", F.posexplode("names").alias("line_no", "name")).withColumn("line_no", F.col("line_no").cast("long"))
    labels = labels.select("node", "comp").join(counts, "node")
    first = lines.groupBy("name").agg(F.min(F.struct("doc_id", "doc", "line_no")).alias("at"))
    first = first.join(labels, F.col("name") == F.col("node"), "left").select("name", "at", F.coalesce("comp", "name").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    top = first.groupBy("comp").agg(F.min("at").alias("top"))
    first = first.join(top, "comp").select(F.col("name").alias("__name"), "top", "n_links")
    out = lines.join(first, F.col("name") == F.col("__name"))
    is_first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("doc") == F.col("top.doc")) & (F.col("line_no") == F.col("top.line_no"))
    out = out.select("doc_id", "line_no", F.col("top.doc_id").alias("class_doc_id"), F.col("top.line_no").alias("class_line_no"), "n_links", is_first.alias("keep"), "n")
    again = out.where("n > 1").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select(*out.columns[:5], F.lit(False).alias("keep"))
    return out.drop("n").unionByName(again)
