"""A quality classifier of few rules: conjunctions over statistics of a text, lasso weights.

Statistics are counted in whole texts, byte by byte, in Arrow batches.  Boosted trees over
the statistics of labelled rows give rules, one for each path from a root to a node; a
logistic regression with an L1 penalty leaves most of them without a weight; the others
become one Spark column expression, which scores any number of rows without Python.

What is learned from is bounded: of more than ``most`` labels those whose id hashes below
``most`` over their number are taken (``TRAIN_ROWS``: in expectation that many), and of rows
that have one again if ids repeat.  Trees and weights are fitted by Spark's own library on
that table.

Nulls and odd rows: a null text is an empty one; all statistics of an empty text are 0, and it
has a score as any other.  A null id has no label.  A document with several labels has their
mean, and counts as good from one half on; a null label is none.  Repeated documents are
learned from as often as they occur.  Without labelled rows, or with labels of one kind, the
score is the share of good ones with one more of each kind.  No documents give no rows.  Very
long texts are counted alone.  Extra columns of documents are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, U64, chunks, cut, free_name, shingles, small_batches, text_bytes, word_hashes, word_spans

#: Labelled rows that are learned from, at most (in expectation).
TRAIN_ROWS = 50_000
#: Parts of the table that is learned from.
TRAIN_PARTS = 2
#: Boosted trees, their depth, and the penalty on the sum of the rules' absolute weights.
TREES, DEPTH, LASSO = 10, 3, 0.001
SEED = 11

# classes of bytes
SPACE, LOWER, UPPER, DIGIT, POINT, MARK, BRACKET, SYMBOL, LINE, LEAD, TAIL, OTHER = range(12)
KIND = np.full(256, OTHER, np.uint8)
for _kind, _of in ((SPACE, SPACES), (LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (POINT, b".,;:"), (MARK, b"!?"), (BRACKET, b"\"'()[]-"), (SYMBOL, b"#$%&*+/<=>@\\^_`{|}~"), (LINE, b"\n"), (LEAD, range(192, 256)), (TAIL, range(128, 192))):
    KIND[list(_of)] = _kind
IS_LINE = np.zeros(256, bool)
IS_LINE[10] = True

STATISTICS = [
    "chars",
    "words",
    "lines",
    "word_chars",
    "line_words",
    "longest_word",
    "upper_share",
    "digit_share",
    "point_share",
    "mark_share",
    "bracket_share",
    "symbol_share",
    "wide_share",
    "distinct_words",
    "top_word",
    "distinct_runs",
    "distinct_lines",
    "plain_words",
    "symbol_words",
    "mark_words",
    "upper_words",
    "capital_words",
    "short_words",
    "ended_words",
]
KIND_OF_STATISTICS = f"struct<{','.join(f'{s}:double' for s in STATISTICS)}>"


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of different hashes and of the most frequent one."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(U64) << U64(44)) | (hashes >> U64(20)))
    begins = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    of = (key[begins] >> U64(44)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, of, np.diff(np.append(begins, len(key))))
    return np.bincount(of, minlength=rows).astype(float), top


def statistics_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a chunk of bytes."""
    rows = len(off) - 1
    kind = KIND[raw]
    row_of_byte = np.repeat(np.arange(rows), np.diff(off))
    n = np.bincount(row_of_byte * 12 + kind, minlength=rows * 12).reshape(rows, 12).astype(float)
    over = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=b > 0)
    starts, ends, first = word_spans(raw, off)
    words = np.diff(first).astype(float)
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    has = {}
    for name, mask in (("symbol", kind == SYMBOL), ("mark", kind == MARK), ("upper", kind == UPPER), ("letter", (kind == LOWER) | (kind == UPPER) | (kind >= LEAD) & (kind <= TAIL)), ("tail", kind == TAIL)):
        total = np.concatenate([[0], np.cumsum(mask)])
        has[name] = total[ends] - total[starts]
    size = ends - starts
    share = lambda flags: over(np.bincount(row_of_word[flags], minlength=rows).astype(float), words)
    chars = n.sum(1) - n[:, TAIL]
    letters = n[:, LOWER] + n[:, UPPER] + n[:, LEAD]
    longest = np.zeros(rows)
    np.maximum.at(longest, row_of_word, size - has["tail"])
    hashes = word_hashes(raw, starts, ends)
    distinct, top = _distinct(row_of_word, hashes, rows)
    run, run_row = shingles(hashes, first, 3)
    distinct_runs, _ = _distinct(run_row, run, rows)
    line_start, line_end, line_first = word_spans(raw, off, IS_LINE)
    lines = np.diff(line_first).astype(float)
    distinct_lines, _ = _distinct(np.repeat(np.arange(rows), np.diff(line_first)), word_hashes(raw, line_start, line_end), rows)
    last = kind[ends - 1] if len(ends) else kind[:0]
    head = kind[starts] if len(starts) else kind[:0]
    return np.column_stack(
        [
            chars,
            words,
            lines,
            over(np.bincount(row_of_word, size - has["tail"], rows), words),
            over(words, lines),
            longest,
            over(n[:, UPPER], letters),
            *(over(n[:, k], chars) for k in (DIGIT, POINT, MARK, BRACKET, SYMBOL, LEAD)),
            over(distinct, words),
            over(top, words),
            over(distinct_runs, np.bincount(run_row, minlength=rows).astype(float)),
            over(distinct_lines, lines),
            share(has["letter"] == size),
            share(has["symbol"] > 0),
            share(has["mark"] > 0),
            share((has["upper"] == has["letter"]) & (has["letter"] > 1)),
            share(head == UPPER),
            share(size - has["tail"] <= 3),
            share(last == POINT),
        ]
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text column."""

    @F.arrow_udf(KIND_OF_STATISTICS)
    def count(text: pa.Array) -> pa.Array:
        raw, off = text_bytes(text)
        parts = [statistics_of(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], STATISTICS)

    return count(text)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s): the statistics of each text, written once, as texts are long and these short."""
    small_batches(docs.sparkSession)
    return cut(docs.select(F.col(id_col).alias("id"), statistics(F.col(text_col)).alias("s")), "statistics")


# --- rules ------------------------------------------------------------------------------------

#: A rule: for each statistic in it, bounds low < x <= high.
Rule = tuple[tuple[str, float, float], ...]


def paths(node, names: list[str], within: dict | None = None) -> Iterator[Rule]:
    """The conjunctions along all paths from the root of a fitted tree to another node."""
    within = within or {}
    if within:
        yield tuple((s, *within[s]) for s in sorted(within))
    if node.subtreeDepth() == 0:
        return
    name, at = names[node.split().featureIndex()], node.split().threshold()
    low, high = within.get(name, (-math.inf, math.inf))
    yield from paths(node.leftChild(), names, {**within, name: (low, min(high, at))})
    yield from paths(node.rightChild(), names, {**within, name: (max(low, at), high)})


def condition(rule: Rule, s: str = "s") -> Column:
    tests = [F.col(f"{s}.{name}") > F.lit(low) for name, low, _ in rule if low > -math.inf] + [F.col(f"{s}.{name}") <= F.lit(high) for name, _, high in rule if high < math.inf]
    return reduce(lambda a, b: a & b, tests)


class Ensemble:
    """Weighted rules and a constant; ``score`` is their logistic value as a column."""

    def __init__(self, weights: list[tuple[Rule, float]], constant: float):
        self.weights, self.constant = weights, constant

    def score(self, s: str = "s") -> Column:
        z = reduce(lambda a, rule: a + F.when(condition(rule[0], s), F.lit(rule[1])).otherwise(F.lit(0.0)), self.weights, F.lit(self.constant))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def __str__(self) -> str:
        shown = lambda rule: " and ".join(f"{low:g} < {n} <= {high:g}" for n, low, high in rule)
        return "\n".join([f"{self.constant:+.3f}", *(f"{w:+.3f} if {shown(r)}" for r, w in sorted(self.weights, key=lambda x: -abs(x[1])))])


def hashed_below(most: int, n: int) -> Column:
    """Of n ids about ``most``, by a hash."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 30)) < int(most / n * (1 << 30))


def labelled(rows: DataFrame, labels: DataFrame, learn: Column, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, s, label) of measured rows with a label, of about ``most`` labels at most.  These are
    chosen first and broadcast, being so few, so that rows without one aren't moved."""
    mean = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("m")).where("m is not null").where(learn)
    n = mean.count()
    some = mean.where(hashed_below(most, n)) if n > most else mean
    return rows.join(F.broadcast(some.select("id", (F.col("m") >= 0.5).cast("double").alias("label"))), "id").select("id", "s", "label")


def fit(rows: DataFrame, most: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Rules and weights from (id, s, label)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return Ensemble([], math.log((good + 1) / (n - good + 1)))
    if n > most:
        rows = rows.where(hashed_below(most, n))
    train = cut(rows.select("s", "label").repartition(TRAIN_PARTS), "train")
    features = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(train.select("label", "s.*")).select("label", "features")
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, minInstancesPerNode=max(5, int(1e-4 * min(n, most))), seed=SEED).fit(features)
    rules = sorted({r for tree in boosted.trees for r in paths(tree._call_java("rootNode"), STATISTICS)})
    if not rules:
        return Ensemble([], math.log((good + 1) / (n - good + 1)))
    holds = train.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=50, tol=1e-4).fit(holds)
    return Ensemble([(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w != 0], float(model.intercept))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> tuple[DataFrame, Ensemble]:
    """(id, s, score) of all documents, and the rules, learned from the labelled rows for
    which ``learn``, a condition on id, holds."""
    rows = measured(docs, id_col, text_col)
    rules = fit(labelled(rows, labels, learn, most, id_col), most)
    return rows.withColumn(free_name(rows.columns, "score"), rules.score()), rules
