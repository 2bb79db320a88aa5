"""Operators on single documents: language, digests, decontamination, HTML, chats."""

import hashlib
import json
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, decontam, digest, langid, pages
from quire.llm.queries import op4_language, op10_chat

SF = "/root/testdata/sf0.001"


def test_suffix_automaton_knows_all_substrings():
    r = random.Random(1)
    text = [r.randrange(3, 6) for _ in range(60)]
    go = langid.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(2000):
        s = tuple(r.randrange(3, 6) for _ in range(r.randint(1, 8)))
        at = 0
        for c in s:
            at = go[at].get(c, 0)
            if not at:
                break
        assert (at != 0) == (s in subs)


def test_phrases_are_longest_matches():
    m = langid.Model({"a": ["abcabd xyz"], "b": ["zzz"]})
    sample = "abcabd xyz "
    for t in ("abcabd", "abdabc", "xyzabc", "qqq", "zab"):
        n, i = 0, 0
        while i < len(t):
            k = 1
            while i + k <= len(t) and t[i : i + k] in sample:
                k += 1
            i += max(k - 1, 1)
            n += 1
        got = int(m.phrases([langid.squeezed(langid.code_points(t))])[0][0])
        assert got in (n, n + 1)  # a symbol no sample has ends a phrase and is one


def test_predictions_against_plain_parsing():
    """Whole predictions, by the longest substrings of each sample."""
    r = random.Random(21)
    words = {"a": ["ka", "kato", "mi", "sol", "ré"], "b": ["ka", "kata", "mu", "sul", "ro"], "c": ["zz", "mi", "kot", "ré"]}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    samples = {k: [text(k, 40), text(k, 15)] for k in words}
    m = langid.Model(samples)
    texts = [text(r.choice("abc"), r.randint(1, 40)) + r.choice(["", " ñu", " w"]) for _ in range(200)]
    squeezed = lambda t: "".join(map(chr, langid.squeezed(langid.code_points(t))))

    def phrases(t, sample):
        n, have = 1, ""
        for c in t:  # a symbol ends the phrase if none in the sample goes on with it
            if have + c in sample:
                have += c
            else:
                n += 1
                have = c if c in sample else ""
        return n

    joined = {k: "".join(squeezed(t) + " " for t in v) for k, v in samples.items()}
    langs, scores = m.predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        n = {k: phrases(squeezed(t), joined[k]) for k in joined}
        low = sorted(n.values())
        assert len(squeezed(t)) <= langid.PIECE and lang == min(n, key=lambda k: (n[k], k))
        assert score == pytest.approx(1 - low[0] / low[1])


def plain_phrases(t, sample):
    n, have = 1, ""
    for c in t:
        if have + c in sample:
            have += c
        else:
            n += 1
            have = c if c in sample else ""
    return n


def test_phrases_run_on_over_pieces(monkeypatch):
    """Counts of long texts are those of a plain parser, whatever the pieces and blocks."""
    r = random.Random(5)
    words = ["ka", "kato", "mi", "sol", "ré", "katomi"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    samples = {"a": [text(900)], "b": [text(100), "ab" * 700], "c": ["x"]}
    m = langid.Model(samples)
    squeezed = lambda t: langid.squeezed(langid.code_points(t))
    joined = {k: "".join("".join(map(chr, squeezed(t))) + " " for t in v) for k, v in samples.items()}
    texts = ["".join(r.choice("kami soltré") for _ in range(n)) for n in (1, 255, 256, 257, 511, 513, 700)]
    texts += [text(n) for n in (60, 400, 1200)] + [samples["a"][0], samples["a"][0][300:], "ab" * 650, "ba" * 600 + "q" + "ab" * 600, "ñ" * 900, samples["a"][0] * 2]
    points = [squeezed(t) for t in texts]
    want = [[plain_phrases("".join(map(chr, p)), joined[k]) for p in points] for k in "abc"]
    assert m.phrases(points).tolist() == want and want[0][10] == 1
    monkeypatch.setattr(langid, "BLOCK", 2 * langid.PIECE)
    assert m.phrases(points).tolist() == want


def test_cells_follow_transitions_not_the_alphabet():
    r = random.Random(2)
    many = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(20_000))
    m = langid.Model({"zh": [many], "en": ["the cat and the dog " * 50]})
    assert m.cells.nbytes < 8 * 12 * 20_000 * 2
    assert m.predict([many[500:700], "the dog and"])[0] == ["zh", "en"]


def test_language_of_odd_texts(spark):
    m = langid.Model({"en": ["the cat and the dog"], "de": ["der hund und die katze"]})
    docs = [(1, "the dog"), (2, None), (3, ""), (4, "12 $$ !"), (5, "und der hund " * 500), (1, "the dog")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.language["lang"], r.language["score"]) for r in langid.identify(df, m).collect()]
    assert [g[1] for g in got] == ["en", "und", "und", "und", "de", "en"]
    assert all(0 <= g[2] <= 1 for g in got) and got[1][2] == 0
    assert langid.identify(df.limit(0), m).collect() == []
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.language["lang"] for r in langid.identify(df, none).collect()} == {"und"}


def test_language_of_long_texts_only(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze " * 9, "de"), (3, "", "de"), (4, "il cane e il gatto " * 9, "it"), (5, "un gatto e un cane " * 8, "it")]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=60)
    assert m.predict(["the dog", "und der hund", "il gatto e il cane"])[0] == ["en", "de", "it"]


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op4_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) >= 0.97


def test_digest_is_for_the_text_alone():
    r = random.Random(3)
    texts = ["", "a", "ab", "abc", "äöü", "x" * 5000] + ["".join(r.choice("abcdef ghi") for _ in range(r.randint(1, 900))) for _ in range(20)]
    for t in texts:
        assert digest.digest(t) == digest.digest(t) and digest.likeness(digest.digest(t), digest.digest(t)) == 1.0
        for u in texts:
            assert 0 <= digest.likeness(digest.digest(t), digest.digest(u)) == digest.likeness(digest.digest(u), digest.digest(t)) <= 1
    base = texts[-1] * 3
    near, far = base[:-20] + "y" * 20, "".join(r.choice("qrstuv wxy") for _ in range(len(base)))
    assert digest.likeness(digest.digest(base), digest.digest(near)) > digest.likeness(digest.digest(base), digest.digest(far))


@pytest.mark.parametrize("ids", [list(range(30)), [5], [None, 3, 1, None], [2, 2, 7]])
def test_next_document(spark, ids):
    r = random.Random(len(ids))
    docs = [(i, "".join(r.choice("abc é") for _ in range(r.randint(0, 12))) or None) for i in ids]
    df = spark.createDataFrame([(i, t, "p") for i, t in docs], "doc_id long, text string, part string").repartition(3)
    got = sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in digest.compare_edited(df).collect()), key=str)
    order = sorted(((i is not None, i or 0, t or "") for i, t in docs))
    want = []
    for k, (known, i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def plain_digest(text):
    """The digest, triplet by triplet."""
    raw, counts, m = text.encode(), [0] * 256, 0xFFFFFFFF
    for (a, b, c), salt in zip(((0, 1, 2), (0, 1, 3), (0, 2, 3)), (0x165667B1, 0x27D4EB2F, 0x2545F491)):
        for i in range(len(raw) - c):
            h = (raw[i + a] + salt) * 0x9E3779B1 & m
            h ^= (raw[i + b] * 0x85EBCA77 & m) ^ (h >> 15)
            h = (h + raw[i + c] * 0xC2B2AE3D) & m
            h = (h ^ (h >> 13)) * 0x9E3779B1 & m
            counts[h >> 24] += 1
    marks = sorted(counts)
    quartiles = [sum(n > marks[64 * k - 1] for k in (1, 2, 3)) for n in counts]
    bits = "".join(f"{q:02b}" for q in quartiles)
    return f"{min(255, round(8 * math.log2(1 + len(raw)))):02x}{int(bits, 2):0128x}", quartiles


def test_digest_against_a_plain_one():
    r = random.Random(12)
    texts = ["", "abc", "abcd", "ä" * 40] + ["".join(r.choice("abcdé fg.") for _ in range(n)) for n in (5, 60, 900, 4000)]
    for t in texts:
        assert digest.digest(t) == plain_digest(t)[0]
        for u in texts:
            steps = sum((0, 1, 2, 4)[abs(x - y)] for x, y in zip(plain_digest(t)[1], plain_digest(u)[1]))
            length = abs(int(digest.digest(t)[:2], 16) - int(digest.digest(u)[:2], 16))
            assert digest.likeness(digest.digest(t), digest.digest(u)) == pytest.approx(1 - (min(32, length) + steps) / (32 + 4 * 256))


def test_next_document_of_one_id(spark):
    """One id for most rows is cut into ranges, in the order of texts."""
    docs = [(7 if i % 10 else i, f"{i * 7919 % 1000:04d} text") for i in range(300)]
    got = sorted((x.doc_id, x.edited_sha256) for x in digest.compare_edited(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect())
    order = sorted(docs)
    want = [(i, hashlib.sha256((t[:-4] + order[(k + 1) % len(order)][1][:4]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert got == sorted(want)


def test_next_document_of_nothing(spark):
    assert digest.compare_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    vocab = ["a1", "B2", "çé", "Dd", "e", "f", "g"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([3, 10, 14])))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "lone")]
    docs = [(i, "; ".join(text(r.randint(0, 40)) + (r.choice(items[:12])[1].split() if r.random() < 0.6 else []))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x LONE-y"), (103, "lonely")]
    docs += [(104, " ".join(["zz", *text(2000), items[0][1].replace(" ", "--"), *text(700)])), (105, "a1" * 50_000)]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, hits string")
    built = []
    made = decontam.Automaton.__init__
    monkeypatch.setattr(decontam.Automaton, "__init__", lambda self, *a: (built.append(len(a[0])), made(self, *a))[1])
    for limit in (decontam.BLOCK_WINDOWS, 3):
        built.clear()
        got = {x.doc_id: x.hits for x in decontam.decontaminate(df, bench, block_windows=limit).collect()}
        assert len(built) == 1 if limit > 3 else len(built) >= 6
        for i, t in docs:
            w = decontam.normalised(t).split()
            hit, found = [False] * len(w), set()
            for j, u in items:
                p = decontam.normalised(u).split()
                for s in range(max(len(p) - 9, 1) if p else 0):
                    g = p[s : s + 10]
                    for k in range(len(w) - len(g) + 1):
                        if w[k : k + len(g)] == g:
                            hit[k : k + len(g)] = [True] * len(g)
                            found.add(str(j))
            h = got[i]
            assert (h["n_words"], h["n_hit"], h["items"]) == (len(w), sum(hit), sorted(found))
            inside = [decontam.normalised(t[s["start"] : s["end"]]).split() for s in h["spans"]]
            assert sum(map(len, inside)) == sum(hit)
            assert sum((w[s["start"] : s["end"]] for s in h["words"]), []) == sum(inside, [])
    assert {x.hits["n_hit"] for x in decontam.decontaminate(df, bench.limit(0)).collect()} == {0}
    assert decontam.decontaminate(df.limit(0), bench).collect() == []


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar">
<header class="site-header"><h2>Site, name.</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Do accept.</div>
<div id="wrap"><main><article><header><h1>The&nbsp;title &amp; more</h1></header><p>First <b>bold</b>,
   text.<br>After.<p>Second.<table><tr><td>A<td>B</table><div class="share-buttons">Share!</div>
<ul><li>one<li>two</ul><aside>Aside.</aside><script>var x = "</p>";</script><p>x &lt; y &am</article>
<section id="comments"><p>Nice post, thanks. I read it.</p></section></main><div class="sidebar"><p>Links, here.</p></div></div>
<form><input><p>Sign up</p></form><!-- c --><footer>&copy; x</footer></body></html>"""


PROSE = "<p>It was, as they said, a long and rather cold winter; nobody in the valley, young or old, had seen one like it before.</p>" * 4
TEXT = "\n".join(["It was, as they said, a long and rather cold winter; nobody in the valley, young or old, had seen one like it before."] * 4)


@pytest.mark.parametrize(
    "body, want",
    [
        # names inside an article that only look like boilerplate
        (f"<article>{PROSE}<p>Code: <span class='comment'># note</span></p><section id='related-work'><p>Others, too.</p></section><p class='notice-of-intent'>Meant so.</p></article>", TEXT + "\nCode: # note\nOthers, too.\nMeant so."),
        # teasers behind the article
        (f"<article>{PROSE}</article><article class='card'><h3>One more</h3><p>Read this, too.</p></article><article class='card'><h3>Another</h3><p>And this.</p></article>", TEXT),
        # the body in main, a reader's comment in an article of its own
        (f"<main>{PROSE}<article class='comment'><p>Nice, thanks. I read it twice.</p></article></main>", TEXT),
        # neither article nor main, and names that say nothing
        (f"<div class='k1'><p>We use cookies, as all do. Fine?</p></div><div class='k2'><h1>Winter</h1>{PROSE}<ul><li>snow<li>ice</ul></div><div class='k3'><div class='k4'><p>Great post, thank you!</p></div><div class='k4'><p>I don't agree, sorry.</p></div></div>", "Winter\n" + TEXT + "\nsnow\nice"),
        # paragraphs right in the body
        (f"<div class='k1'>We use cookies. Fine?</div><h1>Winter</h1>{PROSE}<div class='k3'><a href=/>One</a> <a href=/>Two</a></div>", "Winter\n" + TEXT),
        # links and named boxes inside the article's own element
        (f"<div class='k2'>{PROSE}<div class='k5'><a href=/>One</a> <a href=/>Two</a></div><div class='share-buttons'>Share, please!</div><pre>x = 1\n  y</pre>{PROSE}</div>", TEXT + "\nx = 1 y\n" + TEXT),
        # the whole page in a form
        (f"<form><div class='k1'>Menu</div><div class='k2'>{PROSE}</div><input></form>", TEXT),
    ],
)
def test_html_of_unnamed_and_misnamed_parts(body, want):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{body}<footer>(c) x, y.</footer></body></html>"
    assert pages.main_text(page) == want


def built_page(r):
    """A page of random layout and names, and its article's text."""
    word = lambda: "".join(r.choice("aeioubcdfgmnrst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize() + "."
    name = lambda: f' class="{word()}-{r.randint(0, 99)}"' if r.random() < 0.8 else ""
    blocks, text = [], []
    for i in range(r.randint(4, 12)):
        kind = r.choice(["p"] * 6 + ["h2", "ul", "pre", "table", "quote"]) if i else "h1"
        if kind in ("p", "pre", "h2", "h1"):
            x = prose(r.randint(3, 8) if kind in ("h1", "h2") else r.randint(25, 110))
            blocks.append(f"<{kind}>{x}</{kind}>")
            text.append(x)
        elif kind == "ul":
            items = [prose(r.randint(1, 6)) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            text += items
        elif kind == "table":
            items = [word() for _ in range(4)]
            blocks.append("<table><tr>" + "</tr><tr>".join(f"<td>{a}</td><td>{b}</td>" for a, b in zip(items[::2], items[1::2])) + "</tr></table>")
            text += items
        else:
            x = prose(30)
            blocks.append(f"<blockquote><p>{x}</p></blockquote>")
            text.append(x)
    blocks.append(f"<p>{(x := prose(60))}</p>")
    text.append(x)
    tag = r.choice(["article", "main", "div", "section", "div"])
    body = f"<{tag}{name()}>" + "".join(blocks) + f"</{tag}>"
    links = lambda n: "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(n))
    before = r.sample([f"<nav><ul>{links(6)}</ul></nav>", f"<header><h2>{word()}</h2></header>", f"<div{name()}>{prose(6)}</div>", f"<div{name()}><ul>{links(9)}</ul></div>", f"<script>var x='<p>{word()}</p>'</script>"], r.randint(1, 4))
    after = r.sample([f"<aside><p>{prose(12)}</p></aside>", f"<footer><p>{prose(20)}</p></footer>", f"<div{name()}>" + "".join(f"<div{name()}><p>{prose(r.randint(3, 9))}</p></div>" for _ in range(3)) + "</div>", f"<div{name()}><ul>{links(7)}</ul></div>", f"<form><p>{prose(7)}</p><input></form>"], r.randint(1, 4))
    wrap = r.choice(["{}", "<div id=w>{}</div>", "<div id=w><div id=v>{}</div></div>"])
    return "<html><body>" + wrap.format("".join(before) + body + "".join(after)) + "</body></html>", "\n".join(text)


BODY = "<p>The first paragraph of the article, with a clause, and another one.</p><p>The second paragraph goes on, as it must, for a while.</p>"
SAID = "<p>I don't agree at all, as a reader, with what is said here.</p><p>Me neither, and I say so at length, with commas.</p>"
PLAIN = "The first paragraph of the article, with a clause, and another one.\nThe second paragraph goes on, as it must, for a while."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{BODY}<section><h2>Comments</h2><div class='c'><b>Bob</b>{SAID}</div></section></article>",
        f"<article>{BODY}<div class='user-feedback'>{SAID}</div></article>",
        f"<article>{BODY}<div><header><h3>3 Comments</h3></header><div><h4>Bob</h4>{SAID}</div></div></article>",
        f"<main>{BODY}<h2>Leave a reply</h2>{SAID}</main>",
        f"<div class='post'>{BODY}</div><div><h2>Kommentare (2)</h2>{SAID}</div>",
    ],
)
def test_html_without_what_readers_say(page):
    assert pages.main_text(f"<html><body>{page}</body></html>") == PLAIN


def test_html_after_and_without_comments():
    page = f"<article>{BODY}<h2>Comments</h2>{SAID}<h2>Sources</h2><p>The sources are named here, one by one, in full.</p></article>"
    assert pages.main_text(page) == PLAIN + "\nSources\nThe sources are named here, one by one, in full."
    assert pages.main_text(f"<article><h1>Comments</h1>{BODY}</article>") == "Comments\n" + PLAIN


def test_html_of_quotes_that_never_close():
    page = "<article><p>Some text here, long enough.</p><p>A {} here.</p></article>"
    for link in ('<a href="x>link</a>', "<a href='x>link</a>", '<a title="a" href="x>link</a>'):
        assert pages.main_text(page.format(link)) == "Some text here, long enough.\nA link here."


@pytest.mark.parametrize("unit", ["<div>x, y. ", "<div><li>x</b> y", "<b><i>x y ", "<p><span>x</div> y", "<table><tr><td>x "])
def test_html_of_very_deep_pages(unit):
    """Time grows with the page, not with its depth."""
    n = 20_000
    began = time.process_time()
    text = pages.main_text(unit * n)
    assert time.process_time() - began < 6 and text.count("x") > 0.9 * n


def test_html_of_built_pages(monkeypatch):
    """Articles of pages that are built here, so that their text is known: short blocks of
    furniture without any name that tells what it is."""
    r = random.Random(7)
    made = [built_page(r) for _ in range(400)]
    whole = sum(pages.main_text(page) == text for page, text in made)
    assert whole >= 0.97 * len(made)
    ratios = pages.ratios
    for other in (lambda blocks: np.ones(len(blocks)), lambda blocks: -ratios(blocks)):  # the ratios decide
        monkeypatch.setattr(pages, "ratios", other)
        assert sum(pages.main_text(page) == text for page, text in made) < 0.75 * len(made)


def test_html_of_long_pages_and_clashing_columns(spark):
    page = "<body><div>" + PROSE * 2000 + "</div><div>Ad</div></body>"
    rows = [(1, page, "x", 7)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, html string, main_text string, text int")).collect()
    assert got[0].main_text == "\n".join([TEXT] * 2000) and got[0].text == 7


def test_html_keeps_the_article_and_nothing_else(spark):
    want = "The title & more\nFirst bold, text. After.\nSecond.\nA\nB\none\ntwo\nx < y &am"
    assert pages.main_text(HTML) == want
    no_article = HTML.replace("<article>", "<div class=post>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert pages.main_text(no_article) == want
    rows = [(1, HTML), (2, None), (3, ""), (4, "plain text"), (5, "<p>"), (6, "<nav>x</nav>"), (1, HTML)]
    got = [r.main_text for r in pages.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()]
    assert got == [want, "", "", "plain text", "", "", want]
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_html_ratios_choose_beside_and_inside_marked_elements():
    long = "A sentence of the story, and then some more of it, with a clause. " * 6
    beside = f"<body><article><p>{long}</p></article><div><p>{long}</p></div></body>"
    assert pages.main_text(beside) == long.strip()
    parts = f"<body><div class='part'><p>{long}</p></div><div class='part'><p>{long}</p></div></body>"
    assert pages.main_text(parts) == "\n".join([long.strip()] * 2)
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    assert pages.main_text(f"<body><main><div><p>{long}</p><p>{long}</p></div><div><ul>{links}</ul></div></main></body>") == "\n".join([long.strip()] * 2)


def test_html_main_with_other_articles():
    long = "A sentence of the story, and then some more of it, with a clause. " * 6
    body = "\n".join([long.strip()] * 2)
    main = f"<p>{long}</p><p>{long}</p>"
    assert pages.main_text(f"<body><main>{main}<article class='comment'><p>{long}</p></article></main></body>") == body
    assert pages.main_text(f"<body><main>{main}<article><p>Read this.</p></article></main></body>") == body
    assert pages.main_text(f"<body><main>{main}</main><article><p>Read this.</p></article></body>") == body
    assert pages.main_text(f"<body><main><article class='post category-social'>{main}</article></main></body>") == body
    assert pages.main_text(f"<article><p>{long} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></article>") == long + "x=1"


def test_html_of_all_pages(spark):
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        a = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub("<(?:b|br)>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", a)]
        assert pages.main_text(r.html) == "\n".join(x for x in parts if x)


NASTY = ["", "a", "<|im_start|>user\nx<|im_end|>\n", "\\", "\\1", "\\0\\", "[INST] \\2", "</s>[INST] ok [/INST]", "é\n <", "\\\\<<[["]


def test_chat_round_trip(spark):
    turns = [[("user", a), ("assistant", b), ("odd\nrole<", a)] for a in NASTY for b in NASTY] + [[]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, turns array<struct<role:string,text:string>>")
    out = df.select("turns", chat.formatted(F.col("turns")).alias("f")).select("turns", "f", chat.parsed(F.col("f")).alias("back")).collect()
    for r in out:
        assert r.turns == r.back
        assert r.f.count(chat.OPEN) == len(r.turns) and "</s>" not in r.f and "[INST]" not in r.f


def test_chat_layouts(spark):
    def chats(*t):
        return [{"role": r, "text": x} for r, x in t]

    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", chats(("user", "q"), ("assistant", "a"))),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "sharegpt", chats(("user", "q"), ("assistant", ""))),
        ({"prompt": "q", "completion": "a"}, "completion", chats(("user", "q"), ("assistant", "a"))),
        ({"output": "a", "instruction": "q", "input": "i"}, "instruction_input", chats(("user", "q\n\ni"), ("assistant", "a"))),
        ({"output": "a", "instruction": "q", "input": ""}, "instruction_input", chats(("user", "q"), ("assistant", "a"))),
        ({"system": "s", "instruction": "q", "output": "a"}, "system_instruction", chats(("system", "s"), ("user", "q"), ("assistant", "a"))),
        ({"prompt": None, "response": 5}, "response", chats(("user", ""), ("assistant", "5"))),
        ({"prompt": "q", "other": "a"}, None, None),
        ([1], None, None),
    ]
    rows = [(json.dumps(c[0]), i) for i, c in enumerate(cases)] + [(None, 90), ("{broken", 91)]
    got = {r.turns0: r for r in chat.format_chat(spark.createDataFrame(rows, "record string, turns0 int")).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        r = got[i]
        assert r.layout == layout
        assert (r.turns and [t.asDict() for t in r.turns]) == turns
    assert got[90].formatted is None and got[91].layout is None
    assert chat.format_chat(spark.createDataFrame([], "record string")).collect() == []


def test_chat_of_more_fields_and_empty_lists(spark):
    records = [
        ('{"id": 4, "messages": [{"role": "user", "content": "a", "weight": 1}, {"role": "assistant", "content": "[b] <c>", "tag": {"x": 1}}], "meta": {"y": [1]}}', [("user", "a"), ("assistant", "[b] <c>")]),
        ('{"messages": [{"role": "user", "content": "a", "x": {"y": {"z": {"u": {"v": [{"w": [[1]]}]}}}}}, {"role": "assistant", "content": "b", "tool_calls": [{"id": 1, "fn": {"args": [{"k": []}]}}], "tags": [["t"]]}], "m": [[{"a": 1}]], "n": [{"b": {"c": [{}]}}]}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt": "p", "completion": "c", "deep": ' + '{"d": ' * 40 + "1" + "}" * 40 + "}", [("user", "p"), ("assistant", "c")]),
        ('{"messages": []}', []),
        ('{"messages": [], "id": 3}', []),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": ""}, {"from": "gpt", "value": "z\\\\"}]}', [("user", "q"), ("assistant", ""), ("assistant", "z\\")]),
        ('{"prompt": "a", "completion": "b", "messages": []}', None),
        ('{"id": 1}', None),
    ]
    df = spark.createDataFrame([(i, r, "x", 1) for i, (r, _) in enumerate(records)], "id int, record string, print string, loss int")
    for r in chat.format_chat(df).collect():
        want = records[r.id][1]
        assert (r.turns if r.turns is None else [tuple(t) for t in r.turns]) == want and r["print"] == "x"
        if want is None:
            assert r.loss is None and r.formatted is None
            continue
        own = [(i, t) for i, (role, t) in enumerate(want) if role == "assistant"]
        assert [(s.turn, r.formatted[s.start : s.end].replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\")) for s in r.loss] == own
    assert chat.format_chat(df.limit(0)).collect() == []


def test_what_is_under_the_mask_is_cut_from_the_text(spark):
    """By its code points: another mask gives another text."""
    turns = [{"role": r, "content": c} for r, c in (("system", "é<|im_start|>"), ("assistant", "a[b]\\\n<"), ("user", "日本"), ("assistant", ""), ("assistant", "𝒳y"))]
    out = chat.format_chat(spark.createDataFrame([(json.dumps({"messages": turns}),)], "record string"))
    moved = F.transform("loss", lambda x: F.struct(x["turn"].alias("turn"), (x["start"] + 1).alias("start"), x["end"].alias("end")))
    r = out.select("formatted", "loss", chat.under_mask(F.col("formatted"), F.col("loss")).alias("own"), chat.under_mask(F.col("formatted"), moved).alias("other")).first()
    assert r.own == "a[b]\\\n<𝒳y" and r.other != r.own
    assert r.own == "".join(r.formatted[x.start : x.end].replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\") for x in r.loss)


def test_chat_mask_of_many_turns(spark):
    """Over several chunks of sums."""
    turns = [{"role": ("user", "assistant")[i % 2], "content": "x<" * (i % 7)} for i in range(1100)]
    r = chat.format_chat(spark.createDataFrame([(json.dumps({"messages": turns}),)], "record string")).first()
    assert [r.formatted[s.start : s.end] for s in r.loss] == [t["content"].replace("<", "\\1") for t in turns if t["role"] == "assistant"]


def test_chat_of_long_texts(spark):
    long = F.concat(F.lit('\\\\\\" é<'), F.repeat(F.lit("x, : {y} "), 2_400_000), F.lit('\\"\\\\'))  # JSON's escapes
    q = F.lit('"')
    text = F.concat(q, long, q)
    records = [
        F.concat(F.lit('{"prompt": 5, "completion" : '), text, F.lit("}")),
        F.concat(F.lit('{"messages": [{"role": "user", "content": null}, {"content": '), text, F.lit(', "role": "assistant"}]}')),
        F.concat(F.lit('{"prompt": "q", "completion": '), text, F.lit(', "other": 1}')),
        F.concat(F.lit('{"prompt": "q", "completion": '), text),
        F.concat(F.lit('{"prompt\\"": "q", "completion": '), text, F.lit("}")),
    ]
    df = spark.range(len(records)).select("id", F.element_at(F.array(*records), F.col("id").cast("int") + 1).alias("record"))
    out = chat.format_chat(df)
    got = {r.id: r for r in out.select("id", "layout", "loss", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]), F.substring(t["text"], 1, 3))).alias("t"), F.length("formatted").alias("n")).collect()}
    n = 2_400_000 * 9 + 7
    assert [(tuple(x) for x in got[i].t) and [tuple(x) for x in got[i].t] for i in (0, 1)] == [[("user", 1, "5"), ("assistant", n, '\\" ')], [("user", 0, ""), ("assistant", n, '\\" ')]]
    assert [got[i].layout for i in range(5)] == ["completion", "messages", "completion", None, None]
    assert got[0].n > n and [(x.turn, x.end - x.start > n) for x in got[0].loss] == [(1, True)] and got[2].n > n and got[3].n is None


def test_chat_query_covers_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 5, None, "x"), (2, 5, None, "x"), (None, 0, "user", "n"), (3, 0, "human", "h"), (3, 1, "gpt", "g"), (4, 1, "assistant", "<b>"), (4, 0, "system", "[s]")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op10_chat(spark, str(tmp_path)).collect()}
    conv = {1: [("user", "q"), ("assistant", "")], 2: [("", "x"), ("", "x")], None: [("user", "n")], 3: [("human", "h"), ("gpt", "g")], 4: [("system", "[s]"), ("assistant", "<b>")], -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == set(conv)
    for k, turns in conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
