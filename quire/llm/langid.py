"""Language ID by cross-parsing entropy.

A suffix automaton of a sample of labelled text stands for each language.  A text is parsed
greedily into the longest phrases that occur in the sample; the language that needs the
fewest phrases for each symbol wins.  Texts are parsed in pieces of ``PIECE`` symbols, all
pieces of a batch and all languages in step, as one lookup of a cell for each symbol.  A piece
is parsed as if a phrase began with it; then the phrase that comes in from the piece before is
followed until it is in the same state, from where on both are one.  So phrases are those of
the whole text, wherever pieces begin.

Transitions are sparse: each state has a place of its own, and its transition by a symbol is
in the cell of that place plus the symbol, which says whose it is.  Cells are about four
times as many as transitions, whatever the alphabet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import release, small_batches

#: Characters of each language that are learned, in whole rows; a longer row is never picked.
SAMPLE_CHARS = 24_000
#: Rows of a language looked at, in the order of a hash of their ids, until the sample is full.
SAMPLE_ROWS = 200
PIECE = 256
#: Symbols that are parsed at once; of a longer text one block after the other.
BLOCK = 1200 * PIECE
UNKNOWN = "und"

_MASK = np.int64((1 << 32) - 1)


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


_LETTERS: np.ndarray | None = None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(points: np.ndarray) -> np.ndarray:
    """Letters as they are; each run of anything else as one space, none at the ends."""
    p = np.where(letters()[points], points, np.uint32(32))
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    p = p[keep]
    return p[int(len(p) > 0 and p[0] == 32) : len(p) - int(len(p) > 1 and p[-1] == 32)]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; none leads to the start
    state, 0."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def cells_of(nxt: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The states' places, all different, and cells: at place + symbol the state's place in
    the upper and the next state's place in the lower half; -1 where no state has any.

    States with many transitions choose first; a place is drawn until all its cells are free.
    """
    span = 4 * sum(map(len, nxt)) + 2 * len(nxt) + 2 * width
    free, places = bytearray(b"\1") * (span + width), np.zeros(len(nxt), np.int64)
    had: set[int] = set()
    draw = 1
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
        while True:
            draw = (draw * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            at = (draw >> 20) % span
            if at not in had and all(free[at + c] for c in nxt[s]):
                break
        had.add(at)
        places[s] = at
        for c in nxt[s]:
            free[at + c] = 0
    cells = np.full(span + width, -1, np.int64)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            cells[places[s] + c] = places[s] << 32 | places[t]
    return places, cells


class Model:
    """Symbols: 0 pads, 1 is a letter no sample has, 2 is the space, others are letters.

    ``cells`` has the transitions of all languages one after the other; ``start`` the places
    of their start states, and ``first`` [language, symbol] those after one symbol.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: [squeezed(code_points(t)) for t in samples[k]] for k in self.languages}
        known = sorted({int(c) for v in texts.values() for t in v for c in np.unique(t)} - {32})
        self.symbol = np.zeros(0x110000, np.uint8 if len(known) < 250 else np.int32)
        self.symbol[letters()] = 1
        self.symbol[~letters()] = 2
        self.symbol[known] = np.arange(3, 3 + len(known))
        width = 3 + len(known)
        cells, self.start = [np.zeros(0, np.int64)], []
        self.first = np.zeros((len(self.languages), width), np.int64)
        at = 0
        for i, k in enumerate(self.languages):
            nxt = suffix_automaton([int(c) for t in texts[k] for c in (*self.symbol[t], 2)])
            places, own = cells_of(nxt, width)
            if at + len(own) > _MASK:
                raise ValueError("the samples need more than 2**32 cells")
            cells.append(np.where(own < 0, own, own + (at << 32 | at)))
            self.start.append(at + int(places[0]))
            self.first[i] = self.start[-1]
            for c, t in nxt[0].items():
                self.first[i, c] = at + places[t]
            at += len(own)
        self.cells = np.concatenate(cells)

    def _parsed(self, parts: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[language, part] counts of the phrases that begin inside parts of texts (symbols),
        and the states after them, given the states before (``entry``)."""
        sizes = np.array([len(t) for t in parts])
        lanes = -(-sizes // PIECE)
        first = np.cumsum(lanes) - lanes
        row = np.repeat(np.arange(len(parts)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid = np.zeros((PIECE, int(lanes.sum())), self.symbol.dtype)
        grid[pos % PIECE, first[row] + pos // PIECE] = np.concatenate(parts)
        begin = np.array(self.start, np.int64)[:, None]
        state = np.repeat(begin, grid.shape[1], axis=1)
        states, breaks = np.empty((PIECE, *state.shape), np.int64), np.empty((PIECE, *state.shape), bool)
        for p, symbols in enumerate(grid):
            cell = self.cells[state + symbols]
            on = cell >> 32 == state
            breaks[p] = ~on & (symbols != 0)
            state = states[p] = np.where(on, cell & _MASK, self.first[:, symbols])  # or the symbol opens the next phrase
        alone, ends = breaks.sum(0), state.copy()
        count = alone.copy()
        # what comes in from the piece before, until it ends in the state of the piece alone
        opens = np.zeros(grid.shape[1], bool)
        opens[first] = True
        into = np.concatenate([begin, ends[:, :-1]], axis=1)
        into[:, first] = entry
        lang, lane = np.nonzero(into != begin)
        while len(lang):
            at, more, end = into[lang, lane], np.zeros(len(lang), np.int64), state[lang, lane]
            left = np.arange(len(lang))
            for p in range(PIECE):
                k, w = lang[left], lane[left]
                symbols = grid[p, w]
                cell = self.cells[at + symbols]
                on = cell >> 32 == at
                at = np.where(on, cell & _MASK, self.first[k, symbols])
                more[left] += (~on & (symbols != 0)).astype(np.int64) - breaks[p, k, w]
                apart = at != states[p, k, w]
                left, at = left[apart], at[apart]
                if not len(left):
                    break
            end[left] = at
            count[lang, lane] = alone[lang, lane] + more
            other = end != ends[lang, lane]  # then the next piece is followed again
            ends[lang, lane] = end
            onwards = other & (lane + 1 < len(opens))
            onwards[onwards] &= ~opens[lane[onwards] + 1]
            lang, lane = lang[onwards], lane[onwards] + 1
            into[lang, lane] = ends[lang, lane - 1]
        return np.add.reduceat(count, first, axis=1), ends[:, first + lanes - 1]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[language, text] counts of phrases, for non-empty texts in squeezed code points."""
        begin = np.array(self.start, np.int64)[:, None]
        out = np.ones((len(self.languages), len(texts)), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
        if short:
            out[:, short] += self._parsed([self.symbol[texts[i]] for i in short], np.repeat(begin, len(short), axis=1))[0]
        for i in sorted(set(range(len(texts))) - set(short)):
            state = begin
            for at in range(0, len(texts[i]), BLOCK):
                more, state = self._parsed([self.symbol[texts[i][at : at + BLOCK]]], state)
                out[:, i] += more[:, 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        i = 0
        while i < len(texts):  # some hundred thousand symbols at once
            take, points, size = [], [], 0
            while i < len(texts) and size < BLOCK:
                p = squeezed(code_points(texts[i] or ""))
                if len(p) and not (len(p) == 1 and p[0] == 32):
                    take.append(i)
                    points.append(p)
                    size += len(p)
                i += 1
            if not take:
                continue
            n = self.phrases(points)
            best = np.argmin(n, axis=0)  # the first of equals
            low = np.sort(n, axis=0)
            rest = low[1] if len(low) > 1 else np.array([len(p) for p in points])
            for k, at in enumerate(take):
                langs[at] = self.languages[best[k]]
                scores[at] = float(max(0.0, 1 - low[0][k] / max(rest[k], low[0][k])))
        return langs, scores


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most ``chars`` characters of each label.

    Rows without text or label teach nothing.  Rows are taken whole, in the order of a hash
    of their ids, as long as they fit; a label whose texts are all longer is learned from the
    beginning of one.  Hashes beyond what ``rows`` rows need are filtered
    out before any shuffle, and only the sample reaches the driver.
    """
    have = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    size, fits = F.length("t"), F.length("t") <= chars
    found = have.groupBy("l").agg(F.count_if(fits).alias("n"), F.count_if(fits & (size > 0)).alias("some"), F.count_if(size > chars).alias("longer")).collect()
    if not found:
        return Model({})
    long = [r["l"] for r in found if not r["some"] and r["longer"]]
    counts = {r["l"]: r["longer"] if r["l"] in long else r["n"] for r in found}
    have = have.where(F.when(F.col("l").isin(long), ~fits).otherwise(fits)).withColumn("t", F.substring("t", 1, chars))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3.0 * rows / n))])
    h = F.xxhash64(F.col("i").cast("string"), F.lit(17))
    some = have.withColumn("h", F.pmod(h, F.lit(1 << 30)) / float(1 << 30)).where(F.col("h") <= share[F.col("l")])
    w = Window.partitionBy("l").orderBy("h", "t")
    some = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= rows)
    samples: dict[str, list[str]] = {k: [] for k in counts}
    left = dict.fromkeys(counts, chars)
    for r in sorted(some.select("l", "k", "t").collect(), key=lambda r: (r["l"], r["k"])):
        if 0 < len(r["t"]) <= left[r["l"]]:
            left[r["l"]] -= len(r["t"])
            samples[r["l"]].append(r["t"])
    return Model(samples)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``language``: struct of lang and score (0 to 1: by how much the best
    language needs fewer phrases than the next).

    Null texts and texts without a letter: ``und``, score 0.  Equal counts: the first label
    by code points.  Whole texts are parsed, however long.  Without labelled rows every
    text is ``und``.  Repeated rows are each parsed; an empty table gives an empty one.  All
    other columns stay (one named ``language`` is replaced).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def language(column: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(column.to_pylist())
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return docs.withColumn("language", language(F.col(text_col)))
