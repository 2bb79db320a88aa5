"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and word n-grams columns of an incidence matrix.  A document's n-grams
are ordered by how often their hash bin occurs in the whole corpus, rarest first; two sets
as similar as asked must meet in a prefix of that order whose length follows from their
sizes.  The prefix part of the matrix is multiplied with its transpose block by block of
columns.  Pairs whose sizes, or places of the first common n-gram, bound their overlap below
the threshold are discarded; the overlap of the others is counted over their whole sets.

Equal sets are one row.  A column that more than a few rows share is linked first through
one of its rows, the hub.  Rows that these links don't join with their hub are then
multiplied with all rows of their columns; pairs inside a component can't change it.  A
column whose bin is very frequent is dealt to pieces; they have one hub, and rows outside its
component are multiplied with every piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import dense
from quire.llm.blobs import Seen, pack, runs, unpack
from quire.llm.common import chunks, cut, mix64, release, remove, shingles, small_batches, text_bytes, word_hashes, word_spans, written

NGRAM = 5
#: 100 * overlap >= 75 * union.  With it: overlap >= 3/7 of the sum of sizes, at least 6/7 of
#: the smaller and 3/4 of the larger set.
SIMILAR = 0.75
BINS = 1 << 19
#: Rows of a column whose pairs are all multiplied out at once.
FEW = 8
#: Sets that are compared with one other in one group.
GROUP = 64
#: Occurrences of a bin from which its columns are dealt to pieces, of about that many rows.
HOT = 1 << 20
#: Bytes of sets in one batch that goes to be compared.
BATCH_BYTES = 4 << 20
#: Entries in a block of columns.
BLOCK_ENTRIES = 1_000_000
#: A set's sketch: how many of its n-grams fall in each of some buckets, 255 for that many or
#: more; about a bucket for each FILL n-grams, a power of two between these.
FILL, LEAST_BUCKETS, MOST_BUCKETS = 4, 64, 1 << 13
U64 = np.uint64


def sets_of(raw: np.ndarray, off: np.ndarray, n: int, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row and the rows; ordered by row, by bin count (if given)
    and by hash."""
    starts, ends, first = word_spans(raw, off)
    h, row = shingles(word_hashes(raw, starts, ends), first, n)
    key = row if count is None else row << 24 | count[dense.bin_of(h, BINS)]
    order = np.lexsort((h, key))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and a 64-bit name of each set (0 for the empty one)."""
    size = np.bincount(row, minlength=rows)
    name = np.zeros(rows, U64)
    some = np.flatnonzero(size)
    if len(some):
        begin = np.cumsum(size[some]) - size[some]
        name[some] = mix64(np.add.reduceat(mix64(h ^ U64(0xA5A5A5A55A5A5A5A)), begin) + size[some].astype(U64))
    return size, name


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    size = np.bincount(row, minlength=rows)
    wide = np.clip(2 ** np.ceil(np.log2(np.maximum(size, 1) / FILL)), LEAST_BUCKETS, MOST_BUCKETS).astype(np.int64)
    begin = np.cumsum(wide) - wide
    cell = begin[row] + ((h >> U64(32)).astype(np.int64) & (wide[row] - 1))
    flat = np.minimum(np.bincount(cell, minlength=int(wide.sum())), 255).astype(np.uint8)
    return [flat[i : i + n].tobytes() for i, n in zip(begin, wide)]


def most_overlap(left: bytes, right: bytes) -> int:
    """The largest overlap that two sketches allow; the wider one is folded to the other."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if (x == 255).any() or (y == 255).any():
        return 1 << 62
    n = min(len(x), len(y))
    x, y = (z.reshape(-1, n).sum(axis=0, dtype=np.int64) for z in (x, y))
    return int(np.minimum(x, y).sum())


def features(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, node, sketch) of each document, and rows of bin counters (block not
    null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = np.zeros(BINS, np.uint32)

        def out(ids, size, node, sketch, block=(), at=(), count=()):
            k, m = len(ids), len(block)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(m, pa.int64())]), pa.array(list(size) + [None] * m, pa.int64()), pa.array(list(node) + [None] * m, pa.int64()), pa.array(list(sketch) + [None] * m, pa.binary()), pa.array([None] * k + list(block), pa.int32()), pa.array([None] * k + list(at), pa.binary()), pa.array([None] * k + list(count), pa.binary())],
                names=["doc_id", "size", "node", "sketch", "block", "at", "n"],
            )

        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            sizes, nodes, kept = [], [], []
            for i, j in chunks(off):
                h, row = sets_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
                counter += np.bincount(dense.bin_of(h, BINS), minlength=BINS).astype(np.uint32)
                size, name = signatures(h, row, j - i)
                sizes.append(size)
                nodes.append(name.view(np.int64))
                kept += sketches(h, row, j - i)
            if sizes:
                yield out(batch.column(0), np.concatenate(sizes), np.concatenate(nodes), kept)
        release()
        got = list(dense.blocks(counter))
        if got:
            yield out(pa.array([], pa.int64()), [], [], [], *zip(*got))

    return docs.mapInArrow(run, "doc_id long, size long, node long, sketch binary, block int, at binary, n binary")


def probe_length(size: np.ndarray) -> np.ndarray:
    return size - (3 * size + 3) // 4 + 1


def index_length(size: np.ndarray) -> np.ndarray:
    return size - (6 * size + 6) // 7 + 1


def entries(docs: DataFrame, shared, n: int, parts: int) -> DataFrame:
    """(block, payload): packed prefix entries of the incidence matrix, by blocks of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value.astype(np.int64)
        seen = Seen()
        held: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            cols, pos, node, size = (np.concatenate(x) for x in zip(*held))
            held.clear()
            pieces = -(-count[dense.bin_of(cols, BINS)] // HOT)
            piece = (mix64(node) % np.maximum(pieces, 1).astype(U64)).astype(U64)
            place = np.where(pieces > 1, mix64(cols >> U64(1) ^ mix64(piece + U64(1))), cols)
            block = ((place >> U64(21)) % U64(parts)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(parts + 1))
            ids, payload = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                take = order[cuts[b] : cuts[b + 1]]
                edge = np.flatnonzero(np.concatenate([[True], node[take][1:] != node[take][:-1]]))
                run_of = np.diff(np.concatenate([edge, [len(take)]]))
                ids.append(int(b))
                payload.append(np.array([len(take), len(edge)], np.int64).tobytes() + cols[take].tobytes() + node[take[edge]].tobytes() + pos[take].astype(np.int32).tobytes() + size[take[edge]].astype(np.int32).tobytes() + run_of.astype(np.int32).tobytes())
            return pa.RecordBatch.from_pydict({"block": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for i, j in chunks(off):
                h, row = sets_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], n, count)
                size, name = signatures(h, row, j - i)
                fresh = seen.new(name)
                pos = np.arange(len(h)) - (np.cumsum(size) - size)[row]
                take = fresh[row] & (pos < probe_length(size)[row])
                h, row, pos = h[take], row[take], pos[take]
                held.append((h & ~U64(1) | (pos < index_length(size)[row]).astype(U64), pos, name[row], size[row]))
                waiting += len(h)
                if waiting >= BLOCK_ENTRIES // 4:
                    yield flush()
                    waiting = 0
        if waiting:
            yield flush()
        release()

    return docs.mapInArrow(run, "block int, payload binary")


def unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    parts = []
    for p in payloads:
        m, k = np.frombuffer(p, np.int64, 2)
        a = 16 + 8 * m
        b = a + 8 * k
        c = b + 4 * m
        runs = np.frombuffer(p, np.int32, k, c + 4 * k)
        parts.append((np.frombuffer(p, U64, m, 16), np.repeat(np.frombuffer(p, U64, k, a), runs), np.frombuffer(p, np.int32, m, b), np.repeat(np.frombuffer(p, np.int32, k, c), runs)))
    return [np.concatenate(x) for x in zip(*parts)]


def possible(size_a, pos_a, size_b, pos_b) -> np.ndarray:
    """Whether sizes, and places of a first common n-gram, allow the threshold; a is the
    smaller set."""
    rest = 1 + np.minimum(size_a - pos_a, size_b - pos_b) - 1
    return (4 * size_a.astype(np.int64) >= 3 * size_b) & (7 * rest.astype(np.int64) >= 3 * (size_a.astype(np.int64) + size_b))


PACKED = "kind int, bucket int, col long, payload binary"
PAIRS, MEMBERS, COLUMNS, PIECES, HEADS = 0, 1, 2, 3, 4


def dealt(kind: int, a: np.ndarray, b: np.ndarray, buckets: int) -> list[tuple]:
    """Distinct pairs, packed by buckets of their hash."""
    if not len(a):
        return []
    a, b = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
    bucket = (mix64(mix64(a.view(U64)) ^ b.view(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(kind, int(k), None, pack(a[order[cuts[k] : cuts[k + 1]]], b[order[cuts[k] : cuts[k + 1]]])) for k in np.flatnonzero(np.diff(cuts))]


def packed_table(rows: list[tuple]) -> pa.Table:
    kind, bucket, col, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.Table.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "col": pa.array(col, pa.int64()), "payload": pa.array(payload, pa.binary())})


def distinct_pairs(packed: DataFrame) -> DataFrame:
    """(a, b) of packed pairs, each once."""

    def run(bucket: pa.Table) -> pa.Table:
        a, b = unpack(bucket["payload"].to_pylist(), np.int64, np.int64)
        a, b = np.unique(np.stack([a, b]), axis=1)
        return pa.Table.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return packed.select("bucket", "payload").groupBy("bucket").applyInArrow(run, "a long, b long")


def with_hub(v: np.ndarray, p: np.ndarray, s: np.ndarray, hub: tuple) -> np.ndarray:
    """Of a column's rows those that its hub (row, place, size) may be similar to."""
    row, pos, size = (np.array([x]) for x in hub)
    small = (s < size) | ((s == size) & (v < row))
    return np.where(small, possible(s, p, size, pos), possible(size, pos, s, p)) & (v != row)


def product(parts: int, counts):
    """Of one block of columns: pairs to count, (row, hub) of the columns that more than FEW
    rows share, and those columns themselves; of pieces of columns, them and a hub each."""

    def run(block: pa.Table) -> pa.Table:
        col, node, pos, size = unpacked(block["payload"].to_pylist())
        indexed = (col & U64(1)).astype(bool)
        hot = counts.value[dense.bin_of(col, BINS)] > HOT
        col = col >> U64(1)
        order = np.lexsort((node, size, col))
        col, node, pos, size, indexed, hot = (x[order] for x in (col, node, pos, size, indexed, hot))
        keep = np.ones(len(col), bool)
        keep[1:] = (col[1:] != col[:-1]) | (node[1:] != node[:-1])
        col, node, pos, size, indexed, hot = (x[keep] for x in (col, node, pos, size, indexed, hot))
        edge = runs(col)
        length = np.diff(edge)
        some = np.logical_or.reduceat(indexed, edge[:-1]) if len(col) else np.zeros(0, bool)
        shared = np.repeat((length > 1) & some, length) & ~hot
        few = np.repeat(length <= FEW, length)
        c, v, p, s, x = (y[shared & few] for y in (col, node, pos, size, indexed))
        left, right = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for d in range(1, FEW):
            if len(c) <= d:
                break
            ok = (c[:-d] == c[d:]) & x[:-d]
            ok[ok] = possible(s[:-d][ok], p[:-d][ok], s[d:][ok], p[d:][ok])
            left.append(v[:-d][ok])
            right.append(v[d:][ok])
        members, hubs, more = [np.zeros(0, U64)], [np.zeros(0, U64)], []
        for chosen, split in ((shared & ~few, False), (hot, True)):
            c, v, p, s, x = (y[chosen] for y in (col, node, pos, size, indexed))
            edge = runs(c) if len(c) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1], edge[1:]):
                # the fewer rarer n-grams before this column, the fewer of its own a row has: a good hub
                hub = i + int(np.lexsort((v[i:j], s[i:j], p[i:j]))[0])
                if split:
                    at = int(c[i].view(np.int64))
                    more += [(PIECES, 0, at, pack(c[i:j], v[i:j], p[i:j].astype(np.int32), s[i:j].astype(np.int32), x[i:j])), (HEADS, 0, at, pack(v[hub : hub + 1], p[hub : hub + 1].astype(np.int32), s[hub : hub + 1].astype(np.int32)))]
                    continue
                r = slice(i, j)
                ok = with_hub(v[r], p[r], s[r], (v[hub], p[hub], s[hub]))
                left.append(v[r][ok])
                right.append(np.full(int(ok.sum()), v[hub]))
                members.append(v[r])
                hubs.append(np.full(j - i, v[hub]))
            if len(c) and not split:
                more.append((COLUMNS, 0, None, pack(c, v, p.astype(np.int32), s.astype(np.int32), x)))
        out = packed_table(pairs_of(left, right, parts) + dealt(MEMBERS, np.concatenate(members), np.concatenate(hubs), parts) + more)
        release()
        return out

    return run


def pairs_of(left: list[np.ndarray], right: list[np.ndarray], parts: int) -> list[tuple]:
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    return dealt(PAIRS, np.minimum(a, b), np.maximum(a, b), parts)


def head_of(column: pa.Table) -> pa.Table:
    """The hub of a column in pieces: the best of its pieces' hubs."""
    v, p, s = unpack(column["payload"].to_pylist(), U64, np.int32, np.int32)
    k = int(np.lexsort((v, s, p))[0])
    return pa.Table.from_pydict({"col": column["col"][:1], "hub": pa.array(v[k : k + 1].view(np.int64)), "pos": pa.array(p[k : k + 1]), "size": pa.array(s[k : k + 1])})


def piece_links(made: DataFrame, parts: int) -> DataFrame:
    """Packed pairs and (row, hub) of the columns in pieces."""
    heads = made.where(F.col("kind") == HEADS).select("col", "payload").groupBy("col").applyInArrow(head_of, "col long, hub long, pos int, size int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, *hub in zip(*(c.to_pylist() for c in batch.columns)):
                _, v, p, s, _ = unpack([payload], U64, U64, np.int32, np.int32, bool)
                row = np.array([hub[0]], np.int64).view(U64)
                ok = with_hub(v, p, s, (row[0], hub[1], hub[2]))
                out = pairs_of([v[ok]], [np.repeat(row, int(ok.sum()))], parts) + dealt(MEMBERS, v, np.repeat(row, len(v)), parts)
                yield from packed_table(out).to_batches()

    return made.where(F.col("kind") == PIECES).select("col", "payload").join(heads, "col").select("payload", "hub", "pos", "size").mapInArrow(run, PACKED)


def multiplied(rows: tuple, strays: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one column's stray rows with its other rows; each (row, place, size, indexed)."""
    (v, p, s, x), left, right = rows, [np.zeros(0, U64)], [np.zeros(0, U64)]
    for row, pos, size, own in zip(*strays):
        smaller = (s < size) | ((s == size) & (v < row))
        pos, size = np.array([pos]), np.array([size])
        ok = np.where(smaller, x & possible(s, p, size, pos), own & possible(size, pos, s, p)) & (v != row)
        left.append(np.full(int(ok.sum()), row))
        right.append(v[ok])
    return np.concatenate(left), np.concatenate(right)


def stray_pairs(made: DataFrame, strays: DataFrame, parts: int, in_pieces: bool, bins: int = 1 << 21) -> DataFrame:
    """Packed pairs of (at least) the rows in ``strays`` with all rows of their columns, and
    of their columns' other pieces if there are columns in pieces."""
    bits = made.sparkSession.sparkContext.broadcast(dense.bit_table(strays.select("node"), bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, others in zip(*(c.to_pylist() for c in batch.columns)):
                c, *rows = unpack([payload], U64, U64, np.int32, np.int32, bool)
                edge = runs(c)
                for i, j in zip(edge[:-1], edge[1:]):
                    part = tuple(y[i:j] for y in rows)
                    some = unpack([others], U64, np.int32, np.int32, bool) if others is not None else [y[dense.in_table(bits.value, part[0], bins)] for y in part]
                    for k in range(0, len(some[0]), 1024):
                        left, right = multiplied(part, tuple(y[k : k + 1024] for y in some))
                        if len(left):
                            yield from packed_table(pairs_of([left], [right], parts)).to_batches()

    def only_strays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for col, payload in zip(*(c.to_pylist() for c in batch.columns)):
                _, *rows = unpack([payload], U64, U64, np.int32, np.int32, bool)
                stray = dense.in_table(bits.value, rows[0], bins)
                if stray.any():
                    yield pa.RecordBatch.from_pydict({"col": pa.array([col], pa.int64()), "others": pa.array([pack(*(y[stray] for y in rows))], pa.binary())})

    whole = made.where(F.col("kind") == COLUMNS).select("payload", F.lit(None).cast("binary").alias("others"))
    pieces = made.where(F.col("kind") == PIECES).select("col", "payload")
    if in_pieces:
        whole = whole.unionByName(pieces.join(pieces.mapInArrow(only_strays, "col long, others binary"), "col").select("payload", "others"))
    return whole.mapInArrow(run, PACKED)


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow the threshold: the overlap is at most
    the sum of the lesser counts of each bucket."""

    @F.arrow_udf("boolean")
    def allowed(size: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([7 * most_overlap(x, y) >= 3 * n for n, x, y in zip(size.to_pylist(), left.to_pylist(), right.to_pylist())], pa.bool_())

    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("x")), "a")
    both = one.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("y")), "b")
    return both.where(allowed(F.col("n") + F.col("m"), "x", "y")).select("a", "b")


def routes(pairs: DataFrame) -> DataFrame:
    """(node, to): where the sets of the nodes go to be compared.  Each pair meets at the
    one of its nodes that has more pairs, its centre; what meets at one centre is dealt to
    groups of about GROUP sets, and the centre's own set goes to each of them.  to: centre,
    group (of a centre, how many it has), and whether the node is the centre."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("n"))
    p = pairs.join(degree.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.expr(f"(greatest(na, nb) + {GROUP - 1}) div {GROUP}").alias("groups"))
    p = p.withColumn("g", F.pmod(F.xxhash64("node"), F.col("groups")))
    to = lambda is_centre: F.struct("centre", "g", F.lit(is_centre).alias("is_centre")).alias("to")
    centres = p.groupBy("centre").agg(F.max("groups").alias("g")).select(F.col("centre").alias("node"), "centre", "g").select("node", to(True))
    return p.select("node", to(False)).unionByName(centres).groupBy("node").agg(F.collect_list("to").alias("to"))


def linked(pairs: DataFrame, nodes: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough.  Only texts of pairs
    that their sketches don't rule out are moved, and each set once for each place where it
    is compared.  Of an id's texts only those with the node's own set count."""
    routed = routes(cut(bounded(pairs, nodes), "pairs")).join(nodes.select("node", "doc_id"), "node")
    routed = cut(routed, "routes")
    may = dense.id_filter(routed, "doc_id")
    texts = base.where(may(F.col("doc_id"))).join(routed, "doc_id").withColumn("__name", F.xxhash64("text")).dropDuplicates(["node", "__name"]).select("node", "text", "to")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            to = batch.column(2).to_pylist()
            names = batch.column(0).to_pylist()
            for i, j in chunks(off):
                h, row = sets_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                own = signatures(h, row, j - i)[1].view(np.int64)
                out, held = [], 0
                for k in np.flatnonzero(own == np.array(names[i:j], np.int64)).tolist():
                    grams = h[cuts[k] : cuts[k + 1]].tobytes()
                    for t in to[i + k]:
                        for g in range(t["g"]) if t["is_centre"] else (t["g"],):
                            out.append((t["centre"], g, t["is_centre"], names[i + k], grams))
                            held += len(grams)
                            if held >= BATCH_BYTES:
                                yield as_batch(out)
                                out, held = [], 0
                if out:
                    yield as_batch(out)
        release()

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["centre", "g", "is_centre", "node", "grams"])

    def compare(group: pa.Table) -> pa.Table:
        rows = list(zip(group["is_centre"].to_pylist(), group["node"].to_pylist(), group["grams"]))
        centre = next(np.frombuffer(x.as_buffer(), U64) for own, _, x in rows if own)
        found = []
        for own, node, x in rows:
            if not own:
                x = np.frombuffer(x.as_buffer(), U64)
                at = np.minimum(np.searchsorted(centre, x), len(centre) - 1)
                both = int((centre[at] == x).sum())
                if 100 * both >= 75 * (len(x) + len(centre) - both):
                    found.append(node)
        return pa.Table.from_pydict({"a": pa.array([group["centre"][0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    moved = texts.mapInArrow(sets, "centre long, g long, is_centre boolean, node long, grams binary")
    return cut(moved.groupBy("centre", "g").applyInArrow(compare, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with links; comp is the least node.  Labels spread along
    links and jump to their label's label, each round written before the next."""
    spark = links.sparkSession
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        to = labels.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        moved = moved.join(to, F.col("comp") == F.col("__n")).select("node", "old", F.least("comp", "__c").alias("comp"))
        before = path
        moved, path = written(moved, "labels")
        remove(spark, before)
        labels = moved.select("node", "comp")
        if moved.where("old != comp").limit(1).count() == 0:
            return labels


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Rows without words have no n-grams and link with nothing; their component is their own
    id.  Null ids have a size and a null component, and their texts link others with
    nothing.  Repeated rows give repeated rows, all in one component.  Columns besides id
    and text don't matter.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(features(base, n), "features")
    rows = found.where("block is null").select("doc_id", "size", "node", "sketch")
    counts = dense.total(found.where("block is not null").select("block", "at", "n"), BINS)
    total = rows.agg(F.sum(F.col("size") - F.expr("(3 * size + 3) div 4") + 1)).first()[0] or 0
    parts = max(1, -(-int(total) // BLOCK_ENTRIES))
    shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(np.int32))
    blocks = entries(base.where("doc_id is not null").select("text"), shared, n, parts)
    made = cut(blocks.groupBy("block").applyInArrow(product(parts, shared), PACKED), "product")
    linking = made
    if made.where(F.col("kind") == HEADS).limit(1).count():
        linking = made.unionByName(cut(piece_links(made, parts), "pieces"))
    pairs = cut(distinct_pairs(linking.where(F.col("kind") == PAIRS)), "pairs")
    members = cut(distinct_pairs(linking.where(F.col("kind") == MEMBERS)), "members")
    nodes = cut(rows.where("size > 0 and doc_id is not null").groupBy("node").agg(*[F.min(c).alias(c) for c in ("doc_id", "size", "sketch")]), "nodes")
    links = linked(pairs, nodes, base, n)
    labels = components(links)
    far = members.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    strays = cut(far.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.col("a").alias("node")).distinct(), "strays")
    rest = distinct_pairs(stray_pairs(made, strays, parts, linking is not made))
    rest = rest.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = linked(rest, nodes, base, n)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp").select(F.col("node").alias("__node"), "component_id")
    out = rows.join(named, F.col("node") == F.col("__node"), "left")
    own = F.when(F.col("size") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
