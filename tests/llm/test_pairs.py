"""N-gram join, line dedup and suffix dedup against brute force."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import lines, ngramjoin, suffixes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def gram_set(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.find(a)] = self.find(b)


def near_docs(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]
    passage = [r.choice(vocab) for _ in range(60)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(150)] = r.choice(vocab)
        docs.append((i, " ".join(w[: r.randrange(100, 150)] if r.random() < 0.2 else w)))
    for i in range(80):
        docs.append((1000 + i, " ".join([r.choice(vocab) for _ in range(r.choice([3, 10, 15]))] + passage + [r.choice(vocab) for _ in range(5)])))
    return docs + [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  B"), (None, "a b"), (5004, "a b"), (5004, "a b"), (5005, "Ä b"), (5006, "ä b")]


def test_ngram_join_finds_all_components(spark):
    docs = near_docs()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, size string")
    got = sorted(map(tuple, ngramjoin.join(df).collect()), key=str)
    sets = [(k, i, gram_set(t)) for k, (i, t) in enumerate(docs)]
    u = Union()
    for k, i, s in sets:
        for m, j, t in sets[:k]:
            both = len(s & t)
            if i is not None and j is not None and s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                u.join(k, m)
    comp = defaultdict(list)
    for k, i, _ in sets:
        comp[u.find(k)].append(i)
    want = sorted([(i, len(s), None if i is None else i if not s else min(comp[u.find(k)])) for k, i, s in sets], key=str)
    assert got == want


def test_ngram_join_of_an_id_with_several_texts(spark):
    r = random.Random(6)
    text = lambda: [f"w{r.randrange(3000)}" for _ in range(80)]
    docs = []
    for i in range(0, 60, 2):
        a, b = text(), text()
        docs += [(i, " ".join(a)), (i, " ".join(b)), (i + 1, " ".join(a[:79])), (i + 1, " ".join(b[1:])), (500 + i, " ".join(a[1:])), (600 + i, " ".join(b[:79]))]
    got = ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(i, len(gram_set(t)), i % 100 // 2 * 2) for i, t in docs]
    assert sorted(map(tuple, got)) == sorted(want)


def test_ngram_join_of_hot_columns(spark, monkeypatch):
    """Columns of bins with over 6 occurrences are dealt to pieces, with one hub each."""
    monkeypatch.setattr(ngramjoin, "HOT", 6)
    docs = [(i, t) for i, t in near_docs(7) if i is not None]
    got = {r.doc_id: r.component_id for r in ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: gram_set(t) for i, t in docs}
    u = Union()
    for i, s in sets.items():
        for j, t in sets.items():
            both = len(s & t)
            if i < j and both and 100 * both >= 75 * (len(s) + len(t) - both):
                u.join(i, j)
    comp = defaultdict(list)
    for i in sets:
        comp[u.find(i)].append(i)
    assert got == {i: min(comp[u.find(i)]) for i in sets}


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(edits):
    r = random.Random(edits)
    for _ in range(4000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert lines.within(a, b, edits) == (edit_distance(a, b) <= edits)
    for _ in range(60):  # over several parts of the band
        a = "".join(r.choice("abcd") for _ in range(r.randint(60, 300)))
        b = list(a)
        for _ in range(r.randint(0, edits + 1)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "bd"])
        assert lines.within(a, "".join(b), edits) == (edit_distance(a, "".join(b)) <= edits)


def test_edit_distance_of_very_long_lines():
    """In time that grows with the line."""
    a = "abcdefg hij" * 30_000
    b = "x" + a[1:200_000] + a[200_001:] + "y"
    began = time.process_time()
    assert lines.within(a, b, 3) and not lines.within(a, b, 2) and lines.within(a, a + "z", 1) and lines.within(a, a, 0)
    assert time.process_time() - began < 8



def test_line_dedup_finds_all_links(spark):
    r = random.Random(2)
    known = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(30, 70))) for _ in range(25)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(r.randint(0, 4)):
            x = list(r.choice(known))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                op, at = r.random(), r.randrange(len(x))
                if op < 0.4:
                    x[at] = "z"
                elif op < 0.7:
                    x.insert(at, "q")
                else:
                    x.pop(at)
            out.append("".join(x))
        docs.append((i, "\n".join(out)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort\nshore"), (None, "short"), (104, "no end\n")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, name int")
    got = {(x[0], x[1]): tuple(x[2:]) for x in lines.dedup(df).collect()}
    at = defaultdict(list)
    for i, t in docs:
        for n, x in enumerate([x for x in (t or "").split("\n") if x]):
            at[x].append((i, n))
    u, links = Union(), defaultdict(int)
    long = [x for x in at if len(x) >= lines.MIN_CHARS]
    for k, x in enumerate(long):
        for y in long[:k]:
            if edit_distance(x, y) <= lines.EDITS:
                u.join(x, y)
                links[x] += 1
                links[y] += 1
    classes = defaultdict(list)
    for x in at:
        classes[u.find(x)] += at[x]
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    want = {}
    for x in at:
        first = min(classes[u.find(x)], key=order)
        for p in at[x]:
            want[p] = (*first, links[x], p == first)
    assert sum(links.values()) > 20
    # of the links those stay that connect a class
    assert all((n == 0) == (want[p][2] == 0) and n <= want[p][2] for p, (_, _, n, _) in got.items())
    assert {p: (a, b, k) for p, (a, b, _, k) in got.items()} == {p: (a, b, k) for p, (a, b, _, k) in want.items()}


def test_line_dedup_links_shorter_lines(spark):
    r = random.Random(5)
    known = ["".join(r.choice("abcdefgh é") for _ in range(n)) for n in range(7, 42) for _ in range(2)]
    every = ["Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh."]
    for x in known:
        every.append(x)
        for n in (1, 2):
            y = list(x)
            for at in r.sample(range(len(x)), n):
                y[at] = r.choice(["z", "zq", ""])
            every.append("".join(y))
    every = sorted(set(every))
    got = {every[x.doc_id]: x for x in lines.dedup(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    links, u = defaultdict(int), Union()
    for k, x in enumerate(every):
        for y in every[:k]:
            n = min(len(x), len(y))
            if edit_distance(x, y) <= (2 if n >= 20 else 1 if n >= 10 else 0):
                u.join(x, y)
                links[x] += 1
                links[y] += 1
    first = {}
    for x in every:
        first.setdefault(u.find(x), x)
    assert {x: (v.n_links > 0, every[v.class_doc_id]) for x, v in got.items()} == {x: (links[x] > 0, first[u.find(x)]) for x in every}
    assert links["Thwhesnd esator whshing and hewh."] == 1 and sum(0 < links[x] for x in every if len(x) < 20) > 10


def test_line_dedup_of_split_runs(spark, monkeypatch):
    """Runs in pieces of 8 lines: classes that their hubs don't reach are compared everywhere."""
    monkeypatch.setattr(lines, "RUN", 8)
    r = random.Random(8)
    start = "".join(r.choice("abcdefgh") for _ in range(30))
    ends = ["".join(r.choice("abcdefgh") for _ in range(20)) for _ in range(12)]
    every = [start + x for x in ends]
    for x in ends:
        for _ in range(12):
            y = list(x)
            y[r.randrange(20)] = r.choice("abcdefgh")
            every.append(start + "".join(y))
    every = sorted(set(every))
    r.shuffle(every)
    got = {every[x.doc_id]: every[x.class_doc_id] for x in lines.dedup(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    u = Union()
    for k, x in enumerate(every):
        for y in every[:k]:
            if edit_distance(x, y) <= 2:
                u.join(x, y)
    first = {}
    for x in every:
        first.setdefault(u.find(x), x)
    assert got == {x: first[u.find(x)] for x in every}
    assert 1 < len(first) < 40


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_edit_distances_of_many_pairs(edits):
    """Together as one by one, lines of all lengths and with null characters too."""
    r = random.Random(edits)
    texts = []
    for n in (10, 12, 20, 33, 64, 130, lines.WIDE, lines.WIDE + 1):
        x = "".join(r.choice("abc\0\U0001f600") for _ in range(n))
        for _ in range(20):
            y = list(x)
            for _ in range(r.randint(0, edits + 1)):
                at = r.randrange(len(y))
                y[at : at + r.randint(0, 1)] = r.choice(["", "a", "\0", "bc"])
            texts.append("".join(y))
    pairs = sorted({tuple(sorted((i, j), key=lambda k: len(texts[k]))) for i in range(len(texts)) for j in range(i - i % 20, i)})
    x, y = np.array(pairs).T
    some = np.array([r.randint(1, edits) for _ in pairs])
    want = [lines.within(texts[i], texts[j], int(d)) for (i, j), d in zip(pairs, some)]
    assert lines.all_within(texts, x, y, some).tolist() == want and 0 < sum(want) < len(want)


@pytest.mark.parametrize("most", [4096, 8])
def test_line_dedup_counts_all_links(spark, monkeypatch, most):
    """Each pair of near lines once, however many segments they share, in runs whole and split."""
    monkeypatch.setattr(lines, "RUN", most)
    r = random.Random(most)
    every = {"a" * n for n in (9, 10, 11, 19, 20, 21, 22, 23)} | {"ab" * 9 + x for x in ("", "a", "b", "ab", "ba", "abab")}
    for n in (12, 24, 60):
        x = "".join(r.choice("abcdefgh é\U0001f600") for _ in range(n))
        for _ in range(40):
            y = list(x)
            for _ in range(r.choice([1, 1, 2])):
                at = r.randrange(len(y))
                y[at : at + r.randint(0, 1)] = r.choice(["", "z", x[at - 1], "zq"])
            every.add("".join(y))
    every = sorted(every)
    links = dict.fromkeys(every, 0)
    for k, x in enumerate(every):
        for y in every[:k]:
            n = min(len(x), len(y))
            if edit_distance(x, y) <= (2 if n >= 20 else 1 if n >= 10 else 0):
                links[x] += 1
                links[y] += 1
    rows = [(i, x + "\n" + x) for i, x in enumerate(every)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.line_no, x.n_links) for x in got) == sorted((i, k, links[x]) for i, x in enumerate(every) for k in (0, 1))
    assert max(links.values()) > 8


def test_line_dedup_of_repeated_rows_and_ids(spark):
    rows = [(1, "one line of some length\nand another one"), (1, "one line of some length\nand another one"), (1, "one lime of some length"), (None, "x"), (None, "x"), (2, "y" * 70_000), (3, "y" * 69_999)]
    df = spark.createDataFrame([(i, t, 0, 1, "n") for i, t in rows], "doc_id long, text string, names int, block int, name string")
    got = lines.dedup(df).collect()
    assert len(got) == 9
    assert sorted((x.class_doc_id is not None, x.class_doc_id or 0) for x in got if x.keep) == [(False, 0), (True, 1), (True, 1), (True, 2)]


def test_line_dedup_of_nothing(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_dedup_finds_all_passages(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 90, 200)]
    docs = []
    for i in range(40):
        w = text(r.randint(0, 120))
        for p in r.sample(shared, r.choice([0, 1, 1, 2])):
            w += p[r.choice([0, 0, 3]) :] + text(r.randint(0, 30))
        docs.append((i, " ".join(w)))
    whole = " ".join(text(60))
    docs += [(100, whole), (101, whole), (102, " ".join(shared[0][:20])), (103, " ".join(shared[0][:20])), (104, None), (105, ""), (None, whole), (106, "x " * 200)]
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, name string")
    got = {x.doc_id: (x.n_words, x.n_repeated, x.n_cut) for x in suffixes.repeats(df).collect() if x.doc_id is not None}
    where, first, texts = defaultdict(set), {}, {}
    for i, t in docs:
        if i is not None:
            w = words(t)
            for k in range(len(w) - 49):
                g = tuple(w[k : k + 50])
                where[g].add(i)
                first.setdefault(g, (i, k))
    want = {}
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        rep, cut = [0] * len(w), [0] * len(w)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if len(where[g]) > 1:
                rep[k : k + 50] = [1] * 50
                if first[g] != (i, k):
                    cut[k : k + 50] = [1] * 50
        want[i] = (len(w), sum(rep), sum(cut))
    assert sum(v[1] for v in want.values()) > 500
    assert got == want


def passage_words(texts, least=50):
    """For each distinct text, which of its words lie in a passage that another has too."""
    texts = sorted(set(texts))
    where = defaultdict(set)
    for t in texts:
        w = words(t)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(t)
    out = {}
    for t in texts:
        w = words(t)
        hit = [0] * len(w)
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                hit[k : k + least] = [1] * least
        out[t] = [i for i, x in enumerate(hit) if x]
    return out


def test_suffix_dedup_of_an_id_with_several_texts(spark):
    r = random.Random(9)
    text = lambda n: [f"v{r.randrange(4000)}" for _ in range(n)]
    passage, long = text(60), text(30_000)
    docs = [(5, " ".join(text(20) + passage + text(9))), (5, " ".join(passage + text(70))), (5, " ".join(text(90))), (6, " ".join(text(80)))]
    docs += [(7, " ".join(long)), (8, " ".join(text(10) + long[20_000:20_070])), (8, " ".join(text(10) + long[20_000:20_070]) + " end")]
    # near copies, one word apart at one or the other side of their minimisers
    base = text(140)
    for i in range(30):
        w = list(base)
        for at in r.sample(range(140), r.choice([1, 2, 3])):
            w[at] = f"n{i}-{at}"
        docs.append((20 + i % 7, " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, name int, block string")
    got = sorted((x.doc_id, [k for s in x.spans for k in range(s["start"], s["end"])]) for x in suffixes.repeats(df).collect())
    want = passage_words([t for _, t in docs])
    assert got == sorted((i, want[t]) for i, t in docs)
    assert sum(len(x) > 0 for _, x in got) > 25


def test_suffixes_are_sorted_and_compared():
    r = random.Random(3)
    prefix = np.array([r.randrange(3) for _ in range(80)], np.uint64)
    rows = np.array([[r.randrange(1, 3) for _ in range(6)] for _ in range(80)], np.uint32)
    order, common = suffixes.common_lengths(prefix, rows)
    key = [(int(p).to_bytes(8, "little"), x.tobytes()) for p, x in zip(prefix, rows)]
    assert [key[i] for i in order] == sorted(key)
    for k in range(1, 80):
        a, b = order[k - 1], order[k]
        n = next((i for i in range(6) if rows[a][i] != rows[b][i]), 6)
        assert common[k] == (n if prefix[a] == prefix[b] else -1)


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
