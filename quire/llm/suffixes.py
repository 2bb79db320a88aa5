"""Suffix-array dedup with sparse suffix arrays.

Of all word suffixes only those at minimisers are kept: positions whose PREFIX-word prefix
has the least hash among the prefixes of some run of MIN_WORDS words.  A passage of MIN_WORDS
words has the same minimiser wherever it stands, so two occurrences of it are suffixes with
an equal prefix and meet in one block of prefix hashes.  Suffixes without one from another
text end there.  The others get the words around them.  A block sorts its suffixes by their
words to the right, and by those to the left read backwards, and takes the common lengths of
neighbours; a match extends left by l words and right to MIN_WORDS in all where both orders
have no shorter length between two suffixes.  The extensions of a text merge into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import dense
from quire.llm.blobs import Dealer, Seen, pack, runs, unpack
from quire.llm.common import chunks, cut, prefix_hash, release, small_batches, span_hash, text_bytes, word_hashes, word_spans

MIN_WORDS = 50
PREFIX = 16
BLOCK_ENTRIES = 2_000_000
U64 = np.uint64
#: Of a prefix hash the low bits give way to its place in a text, of which Spark holds 2 GB.
_PLACE = U64((1 << 31) - 1)
#: Suffixes in a block, and held by a task with their contexts before they are dealt out.
CONTEXT_ENTRIES, HELD_ENTRIES = 100_000, 20_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])


def windows(raw: np.ndarray, off: np.ndarray, size: int, k: int):
    """Of some texts: number of words; and of each run of ``size`` words its text, first
    word (in the text), hash, and its minimiser's place (in the text) and hash."""
    starts, ends, first = word_spans(raw, off)
    words = word_hashes(raw, starts, ends)
    count = np.diff(first)
    n = np.maximum(count - size + 1, 0)
    row = np.repeat(np.arange(len(count)), n)
    if not len(row):
        z = np.zeros(0, np.int64)
        return count, z, z, z.view(U64), z, z.view(U64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    p = prefix_hash(words)
    i = np.arange(len(words) - k + 1)
    gram = span_hash(p, i, i + k)
    least = sliding_least(gram & ~_PLACE | i.astype(U64), size - k + 1)[at]
    place = (least & _PLACE).astype(np.int64)
    return count, row, at - first[:-1][row], span_hash(p, at, at + size), place - first[:-1][row], gram[place]


def sample(docs: DataFrame, size: int, k: int, parts: int) -> DataFrame:
    """(block, payload) with the kept suffixes, and (doc_id, name, n_words) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Dealer(parts)
        seen = Seen()

        def out(rows=None, blocks: pa.RecordBatch | None = None) -> pa.RecordBatch:
            ids, names, counts = rows or (pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()))
            a, b = len(ids), blocks.num_rows if blocks else 0
            more = [blocks.column(0), blocks.column(1)] if blocks else [pa.array([], pa.int32()), pa.array([], pa.binary())]
            none = pa.nulls(b, pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in ([ids, none], [names, none], [counts, none], [pa.nulls(a, pa.int32()), more[0]], [pa.nulls(a, pa.binary()), more[1]])], names=["doc_id", "name", "n_words", "block", "payload"])

        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            name = batch.column(1).to_numpy(zero_copy_only=False)
            counts = []
            for i, j in chunks(off):
                count, row, _, _, place, gram = windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], size, k)
                counts.append(count)
                new = seen.new(name[i:j].view(U64))
                keep = np.ones(len(row), bool)
                keep[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                keep &= new[row]
                if deal.add(gram[keep], name[i:j][row[keep]], place[keep].astype(np.int32)):
                    yield out(blocks=deal.flush())
            if counts:
                yield out((batch.column(0), batch.column(1), pa.array(np.concatenate(counts).astype(np.int64))))
        yield out(blocks=deal.flush())

    return docs.mapInArrow(run, "doc_id long, name long, n_words long, block int, payload binary")


def neighbours(block: pa.Table) -> pa.Table:
    """Names of texts and places of their suffixes that share a prefix with another text."""
    gram, name, place = unpack(block["payload"].to_pylist(), U64, np.int64, np.int32)
    order = np.lexsort((name, gram))
    gram, name, place = gram[order], name[order], place[order]
    edge = runs(gram)
    differ = name[edge[:-1]] != name[edge[1:] - 1] if len(name) else np.zeros(0, bool)
    keep = np.repeat(differ, np.diff(edge))
    name, place = name[keep], place[keep]
    order = np.lexsort((place, name))
    name, place = name[order], place[order]
    edge = runs(name)
    return pa.Table.from_pydict({"name": pa.array(name[edge[:-1]] if len(name) else [], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])] if len(name) else [], pa.binary())})


def context_type(reach: int) -> np.dtype:
    """What stands around a suffix: its prefix, how many words there are on both sides (of
    ``reach``), and hashes of those words, going away from the prefix."""
    return np.dtype([("prefix", U64), ("n_left", np.uint16), ("n_right", np.uint16), ("left", np.uint32, (reach,)), ("right", np.uint32, (reach,))])


#: A suffix: its text (the least id and the name), its place, and the number of its context.
SUFFIX = np.dtype([("first", np.int64), ("name", np.int64), ("place", np.int32), ("context", np.int32)])


def distinct(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each of some contexts, and the number of each in that list."""
    _, at, number = np.unique(context.view(f"S{context.dtype.itemsize}"), return_index=True, return_inverse=True)
    return at, number.ravel()


def contexts(docs: DataFrame, size: int, k: int, parts: int) -> DataFrame:
    """(block, payload): the suffixes of (first, name, text, places) and their contexts, by
    their prefixes; of equal contexts that a task has at a time one goes."""
    reach = size - k
    kind = context_type(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(reach)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            context = np.concatenate([np.zeros(0, kind), *(c for c, _ in held)])
            suffix = np.concatenate([np.zeros(0, SUFFIX), *(s for _, s in held)])
            held.clear()
            at, number = distinct(context)
            block = ((context["prefix"] >> U64(21)) % U64(parts)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(parts + 1))
            some, payload = np.flatnonzero(np.diff(cuts)), []
            for b in some:
                rows = order[cuts[b] : cuts[b + 1]]
                used, own = np.unique(number[rows], return_inverse=True)
                out = suffix[rows]
                out["context"] = own.ravel()
                first = pack(context[at[used]])
                payload.append(np.int64(len(first)).tobytes() + first + pack(out))
            return pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "payload": pa.array(payload, pa.binary())})

        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            first, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            places = [np.unique(np.frombuffer(b"".join(x), np.int32)) for x in batch.column(3).to_pylist()]
            for i, j in chunks(off):
                begin, end, edge = word_spans(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                words = word_hashes(raw[off[i] : off[j]], begin, end)
                prefix = prefix_hash(words)
                short = np.append((words >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                row = np.repeat(np.arange(i, j), [len(p) for p in places[i:j]])
                place = np.concatenate([np.zeros(0, np.int32), *places[i:j]]).astype(np.int64)
                for x in range(0, len(row), HELD_ENTRIES):
                    r, p = row[x : x + HELD_ENTRIES], place[x : x + HELD_ENTRIES]
                    at = edge[r - i] + p
                    suffix, context = np.zeros(len(r), SUFFIX), np.zeros(len(r), kind)
                    suffix["first"], suffix["name"], suffix["place"] = first[r], name[r], p
                    context["prefix"] = span_hash(prefix, at, at + k)
                    context["n_left"], context["n_right"] = np.minimum(p, reach), np.minimum(edge[r - i + 1] - at - k, reach)
                    for side, where in (("left", at[:, None] - 1 - step), ("right", at[:, None] + k + step)):
                        context[side] = short[np.where(step < context[f"n_{side}"][:, None], where, len(short) - 1)]
                    held.append((context, suffix))
                    waiting += len(r)
                    if waiting >= HELD_ENTRIES:
                        yield flush()
                        waiting = 0
        yield flush()
        release()

    return docs.select("first", "name", "text", "places").mapInArrow(run, "block int, payload binary")


def received(payloads: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of a block, and its suffixes with their numbers among them."""
    context, suffix, had = [np.zeros(0, kind)], [np.zeros(0, SUFFIX)], 0
    for p in payloads:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        context.append(np.frombuffer(p, kind, (n - 8) // kind.itemsize, 16))
        own = np.frombuffer(p, SUFFIX, (len(p) - n - 16) // SUFFIX.itemsize, n + 16).copy()
        own["context"] += had
        suffix.append(own)
        had += len(context[-1])
    every, suffixes = np.concatenate(context), np.concatenate(suffix)
    at, number = distinct(every)
    suffixes["context"] = number[suffixes["context"]]
    return every[at], suffixes


def common_lengths(prefix: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (prefix, words) and, for each in that order, how many words it has in
    common with the one before (-1: not even the prefix)."""
    prefix = np.ascontiguousarray(prefix)
    keys = np.ascontiguousarray(np.concatenate([prefix.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(words).view(np.uint8).reshape(len(prefix), -1)], axis=1))
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    del keys
    common = np.full(len(prefix), -1)
    for i in range(1, len(prefix), HELD_ENTRIES):
        before, here = order[i - 1 : i - 1 + HELD_ENTRIES], order[i : i + HELD_ENTRIES]
        before = before[: len(here)]
        differ = np.concatenate([words[here] != words[before], np.ones((len(here), 1), bool)], axis=1)
        common[i : i + len(here)] = np.where(prefix[here] == prefix[before], differ.argmax(axis=1), -1)
    return order, common


def agreeing(size: int, k: int):
    """Of one block: for each text the first words (from, to) of runs of ``size`` words,
    around its suffixes, that another text has too, and of those that aren't the first such
    run (by the text's least id, its name, and place).

    Contexts are sorted and compared, and what they have in common holds for all suffixes
    that have them: of these only the texts with the least and the greatest name, and the
    first, matter to others."""
    reach = size - k
    kind = context_type(reach)

    def run(block: pa.Table) -> pa.Table:
        context, suffix = received(block["payload"].to_pylist(), kind)
        owners = np.lexsort((suffix["place"], suffix["name"], suffix["first"]))
        suffix = suffix[owners]  # a suffix's number is its rank
        by = np.argsort(suffix["context"], kind="stable")
        edge = runs(suffix["context"][by])[:-1] if len(by) else np.zeros(0, np.int64)
        low, high, first = (f.reduceat(x, edge) if len(by) else np.zeros(0, np.int64) for f, x in ((np.minimum, suffix["name"][by]), (np.maximum, suffix["name"][by]), (np.minimum, by)))
        n = len(context)
        shared, owner = np.zeros((n, reach + 1), bool), np.full((n, reach + 1), -1)
        if n:
            right, right_common = common_lengths(context["prefix"], context["right"])
            left, left_common = common_lengths(context["prefix"], context["left"])
            of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
            for more in range(reach + 1):  # words to the left of the prefix
                of_right[right] = np.cumsum(right_common < reach - more)
                of_left[left] = np.cumsum(left_common < more)
                some = np.flatnonzero((context["n_left"] >= more) & (context["n_right"] >= reach - more))
                if not len(some):
                    continue
                group = of_left[some] * (n + 1) + of_right[some]
                order = np.argsort(group, kind="stable")
                some, at = some[order], runs(group[order])
                size_of = np.diff(at)
                shared[some, reach - more] = np.repeat(np.minimum.reduceat(low[some], at[:-1]) != np.maximum.reduceat(high[some], at[:-1]), size_of)
                owner[some, reach - more] = np.repeat(np.minimum.reduceat(first[some], at[:-1]), size_of)
        names, ats, laters = [], [], []
        edge = runs(suffix["name"]) if len(suffix) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            at = suffix["context"][a:b]
            if shared[at].any():
                names.append(int(suffix["name"][a]))
                ats.append(starts(shared[at], suffix["place"][a:b], reach))
                laters.append(starts(shared[at] & (owner[at] != np.arange(a, b)[:, None]), suffix["place"][a:b], reach))
        release()
        return pa.Table.from_pydict({"name": pa.array(names, pa.int64()), "at": pa.array(ats, pa.binary()), "later": pa.array(laters, pa.binary())})

    return run


def starts(flags: np.ndarray, place: np.ndarray, reach: int) -> bytes:
    """Packed (from, to) of the first words that the rows' flags stand for: the last flag is
    for a row's own place, those before for places before it."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1] - 1
    base = place[row].astype(np.int64) - reach
    return np.stack([base + begin, base + end], axis=1).astype(np.int32).tobytes()


SPANS = "array<struct<start:long,end:long>>"


def merged(size: int):
    """From lists of packed first words (from, to) to spans of words."""

    @F.arrow_udf(SPANS)
    def spans(column: pa.Array) -> pa.Array:
        out = []
        for parts in column.to_pylist():
            at = np.frombuffer(b"".join(parts or []), np.int32).reshape(-1, 2).astype(np.int64)
            at = at[np.argsort(at[:, 0], kind="stable")]
            end = np.maximum.accumulate(at[:, 1]) + size
            new = np.flatnonzero(np.concatenate([[True], at[1:, 0] > end[:-1]])) if len(at) else np.zeros(0, np.int64)
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(at[new, 0], end[np.append(new[1:], len(at)) - 1])] if len(at) else [])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return spans


def covered(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_repeated, n_cut, spans, cuts) of each row of ``docs``.

    ``spans``: words (from, to) that lie in a passage of at least ``min_words`` words which
    another text has too; ``cuts``: those of which the text isn't the first occurrence (by
    the least id that has it, and a hash of it), to be removed if each passage is to stay
    once.  A passage that only one text has, however often, isn't repeated.  A copy of a
    whole text is cut whole if it has ``min_words`` words; fewer words repeat nothing.

    Null texts have no words.  Null ids are left out of the search and have no spans.  Rows
    that repeat an id and text get equal results; an id's different texts are compared like
    those of different ids.  Texts are searched whole, however long.  Other columns are
    ignored, whatever their names.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("name"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = int(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # about one suffix for every 100 bytes
    parts = max(spread, -(-size // 100 // BLOCK_ENTRIES))
    known = base.where("doc_id is not null")
    kept = cut(sample(known, min_words, prefix, parts), "suffixes")
    rows = kept.where("block is null").select("doc_id", "name", "n_words")
    alive = kept.where("block is not null").select("block", "payload").groupBy("block").applyInArrow(neighbours, "name long, places binary")
    alive = alive.groupBy("name").agg(F.collect_list("places").alias("places"))
    firsts = rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("copies"))
    wanted = cut(alive.join(firsts, "name").select("first", "name", "places"), "wanted")
    may = dense.id_filter(wanted, "name")
    texts = known.where(may(F.col("name"))).join(wanted.withColumn("doc_id", F.col("first")), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"])
    found = contexts(texts, min_words, prefix, max(spread, -(-size // 100 // CONTEXT_ENTRIES)))
    found = found.groupBy("block").applyInArrow(agreeing(min_words, prefix), "name long, at binary, later binary")
    found = found.groupBy("name").agg(F.collect_list("at").alias("at"), F.collect_list("later").alias("later"))
    to_spans = merged(min_words)
    per = firsts.join(found.select("name", to_spans("at").alias("at"), to_spans("later").alias("later")), "name", "left").withColumnRenamed("name", "__name")
    out = rows.join(per, F.col("name") == F.col("__name"))
    none = F.array().cast(SPANS)
    whole = F.when(F.col("n_words") >= min_words, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(none).cast(SPANS)
    spans = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("at", none))
    cuts = F.when(F.col("doc_id") != F.col("first"), whole).otherwise(F.coalesce("later", none))
    out = out.select("doc_id", "n_words", spans.alias("spans"), cuts.alias("cuts"))
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words"), none.alias("spans"), none.alias("cuts"))
    out = out.unionByName(lost)
    return out.select("doc_id", "n_words", covered(F.col("spans")).alias("n_repeated"), covered(F.col("cuts")).alias("n_cut"), "spans", "cuts")
