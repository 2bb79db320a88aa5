"""Expectations of single functions, gates, headings and trees, on inputs of our own."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.entities import unescape
from quire.operators import diff, lint, structure
from quire.plans import render


def ask(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def table(*rows, head="<table>", tail="</table>"):
    return head + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + tail


def test_gates(spark):
    ok = table("ab", "cd")
    cases = {
        ok: "ok",
        ok[:-8]: "unbalanced",
        ok.replace("<td>a", '<td ROWSPAN="2">a'): "merged",
        ok.replace("</table>", "x</table>"): "impure",
        "<table><tr class='x'><td>1</td></tr></table>": "empty",
        table("ab", "c"): "ragged",
        table("a", "b"): "cols=1",
        table("a" * 9, "b" * 9): "cols=9",
        table("ab"): "rows=1",
        table(*["ab"] * 21): "rows=21",
        table(["x" * 301, "b"], "cd"): "cell_too_long",
        table(["x" * 300, "b"], "cd"): "ok",
        ok.replace("<tr>", "<tr><th>h</th>", 1): "impure",
    }
    assert ask(spark, T.table_gate, list(cases)) == list(cases.values())


def test_numerals(spark):
    cases = {"一": 1, "十": 10, "十二": 12, "二十": 20, "三十五": 35, "百": 0, "一百": 100, "一百二十": 120, "一百零五": 100, "7": 7, " 12 ": 12, "": 0, "零": 0, "x": 0}
    assert ask(spark, T.cn_to_int, list(cases)) == list(cases.values())


def test_headings(spark):
    cases = {
        "# 第一章 绪论": (1, "第一章 绪论", False, ""),
        "· 第 3 章 x": (1, "第 3 章 x", False, ""),
        "# 1 概论": (1, "1 概论", False, "ar"),
        "1 概论": None,
        "# 3 400～2 400(s)": None,
        "第2节 b": (2, "第2节 b", False, "jie"),
        "2.1 c": (2, "2.1 c", False, "dot"),
        "2.1.3 d": (3, "2.1.3 d", False, ""),
        "一、e": (2, "一、e", False, "cn"),
        "（一）f": (3, "（一）f", False, ""),
        "( 2 ) g": (3, "( 2 ) g", False, ""),
        "## 习题 三": (0, "习题 三", True, ""),
        "目　录": (0, "目　录", True, ""),
        "plain": None,
        "##": None,
    }
    got = ask(spark, lambda v: T.heading(v), list(cases))
    assert [g and (g.level, g.title, g.board, g.kind) for g in got] == list(cases.values())


def test_contents_lines(spark):
    cases = {"第五章 大数定律……129": True, "1.1 评价 (1)": True, "2024": False, "1. x = 30": False, "12.3 a 7": True, "# 第一章 x 3": False, "第一章 x": False, "": False, "1.2 ![](images/a.png) 3": True}
    got = dict(zip(cases, ask(spark, T.is_toc_line, list(cases))))
    assert got["第五章 大数定律……129"] and got["1.1 评价 (1)"] and got["12.3 a 7"]
    assert not got["# 第一章 x 3"] and not got["第一章 x"] and not got[""]
    assert ask(spark, T.toc_title, ["第五章 大数定律……129", "1.1 评价 …… (1)", "x 3"]) == ["大数定律", "评价", None]


def test_math(spark):
    cases = {"$ x $": "$x$", "$a$   $b$": "$a$ $b$", "$$ x $$": "$$\nx\n$$", "a $$x$$ $ y $": "a $$\nx\n$$ $y$", "\\(x\\)": "(x)", "$": "$", "$$": "$$", "$$$": "$$$", "no": "no", "$ a\nb $": "$a\nb$"}
    assert ask(spark, T.normalize_math, list(cases)) == list(cases.values())


def test_markup(spark):
    assert ask(spark, T.html_images, ['<img src="images/a.png"/>x', "<IMG alt='q' src='b.gif'>", '<img src="https://h/a.png">']) == ["![](images/a.png)x", "![](b.gif)", '<img src="https://h/a.png">']
    assert ask(spark, lambda v: T.clean_markdown(v, unescape), ["&amp;gt; <DEL>x</del>&eacute;", None, "a\n\n\n\nb"]) == ["> xé", "", "a\n\nb"]
    assert ask(spark, T.image_refs, ["![x](images/a.png) <img class=q src='images/b.png'> ![](images/a.png)", "![](http://x/y.png)"]) == [["images/a.png", "images/b.png", "images/a.png"], []]
    assert ask(spark, T.escape_pipes, ["a|b $p|q$ $", "$|$"]) == ["a\\|b $p\\vert q$ $", "$\\vert $"]
    assert ask(spark, T.table_md, [table(["a|b", "$ x $"], ["<eq>1&lt;2</eq>", ""])]) == ["\n| a\\|b | $x$ |\n| --- | --- | --- |\n| $1<2$ |  |\n"]
    assert ask(spark, T.md_columns, ["| a | b |", "a|b\\|c", "|x|"]) == [2, 2, 1]


def test_names(spark):
    assert ask(spark, T.safe_stem, ["../a:b.c.pdf", "x\\y.md", "...", "plain"]) == ["a_b.c", "y", "unnamed", "plain"]
    assert ask(spark, T.safe_title, ["a/b.c", "?"]) == ["b.c", "未命名"]
    assert ask(spark, T.sanitize_filename, [' .a<b>"c. ']) == ["a_b__c"]
    assert ask(spark, T.mime, ["a.PNG", "b", "c.svg"]) == ["image/png", "image/jpeg", "image/svg+xml"]
    assert ask(spark, T.page_start, ["p12-20", "p7", "", None]) == [12, 7, 1, 1]


def books(spark, *texts):
    return spark.createDataFrame([(b, i + 1, i * 10 + 1, i * 10 + 10, t) for b, parts in enumerate(texts) for i, t in enumerate(parts)], structure_schema())


def structure_schema():
    return "book_id long, batch_idx int, page_start int, page_end int, text string"


def outline(spark, *parts, version=2):
    t = structure.nodes(structure.marked_lines(books(spark, parts), version)).orderBy("node_id").collect()
    title = {n.node_id: n.title for n in t}
    return [(n.level, n.title, title.get(n.parent_id)) for n in t]


def test_fold(spark):
    rows = structure.fold_lines(books(spark, ["a\r\n<table>\nb\n</table>\nc\n<table><tr></table>\n\n<table>\nd", "e"])).orderBy("batch_idx", "pos").collect()
    assert [r.line for r in rows] == ["a", "<table>\nb\n</table>", "c", "<table><tr></table>", "", "<table>\nd", "e"]


def test_nesting(spark):
    text = "front\n# 第一章 a\nx\n第一节 b\n## 一、c\n### （一）d\n一、not a heading\n## 2.1 e\n## 一、f\n习题 1\n### （二）g\n# 第二章 h"
    assert outline(spark, text) == [(1, "第一章 a", None), (2, "第一节 b", "第一章 a"), (3, "一、c", "第一节 b"), (4, "（一）d", "一、c"), (2, "2.1 e", "第一章 a"), (2, "一、f", "第一章 a"), (0, "习题 1", "第一章 a"), (1, "第二章 h", None)]
    flat = outline(spark, text, version=1)
    assert (3, "一、not a heading", "第一章 a") in flat


def test_contents_drive_chapters(spark):
    toc = "## 目录\n第一章 甲\n第二章 乙\n第三章 丙\n"
    text = toc + "# 第一章 甲\nx\n# 第九章 丁\n# 第三章 丙\n# 第二章 乙\n# 第三章 丙"
    assert [t[1] for t in outline(spark, text)] == ["第一章 甲", "第三章 丙"]
    assert [t[1] for t in outline(spark, text.replace("## 目录", "x"))][-4:] == ["第九章 丁", "第三章 丙", "第二章 乙", "第三章 丙"]
    twice = toc + "第一章 甲\n# 第一章 甲\n# 第二章 乙\n# 第一章 甲"
    assert [t[1] for t in outline(spark, twice)] == ["第一章 甲", "第二章 乙", "第一章 甲"]


def test_hash_style_and_contents_pages(spark):
    # a batch of contents only is left out of the tree, but its titles vouch for chapters
    assert [t[1] for t in outline(spark, "1.1 Alpha 3\n1.2 Beta 9", "# Alpha\nx\n# Cover\n# Beta\ny")] == ["Alpha", "Beta"]


def test_counts_and_warnings(spark):
    b = books(spark, ["第1章 a\n![](images/x.png) ![](images/y.png)\n<table>\n</table>\n第1节 b\n第3节 c\n### （一）d\n# 第2章 e\n### （一）f"])
    m = structure.marked_lines(b)
    t = structure.nodes(m)
    top = t.where("title = '第1章 a'").first()
    assert (top.image_count, top.table_count) == (1, 1) and top.char_count == len("第1章 a") + len("![](images/x.png) ![](images/y.png)") + len("<table>\n</table>")
    assert [r.warning for r in structure.continuity(t).collect()] == ["第1章 a: 节编号不连续 [1, 3]（可能漏识别标题）"]
    s = structure.structures(b, m, t).first()
    assert (s.pages_covered, s.chapter_count, s.warnings) == ("p1-10", 2, ["（一）f: 层级跳变（1 -> 3）"])


def test_empty_books(spark):
    b = books(spark, [""], ["no heading"])
    m = structure.marked_lines(b)
    s = {r.book_id: r for r in structure.structures(b, m, structure.nodes(m)).collect()}
    assert s[0].chapter_count == 0 and s[1].pre_matter_chars == len("no heading")
    assert structure.nodes(structure.marked_lines(b.limit(0))).collect() == []
    ch = render.with_fallback(render.chapters_md(render.rendered_lines(m)), b).collect()
    assert {(r.book_id, r.title) for r in ch} == {(0, "全文"), (1, "全文")}


def test_render(spark):
    b = books(spark, ["第1章 a\n$ x $ &amp;\n" + table("ab", "cd") + "\n习题"])
    lines = structure.marked_lines(b)
    html = render.chapters_md(render.rendered_lines(lines)).first().md
    assert html == "\n# 第1章 a\n\n$x$ &\n\n" + table("ab", "cd").replace("><", ">\n<") + "\n\n## [板块] 习题\n"
    assert "| a | b |\n| --- | --- |\n| c | d |" in render.chapters_md(render.rendered_lines(lines, "md")).first().md
    with pytest.raises(ValueError):
        render.rendered_lines(lines, "x")


LINT = {
    "a\n\n\n\nb": [("blank_run", 4)],
    "a\n\n\nb": [],
    "a\n\n<table>\n\n\n</table>\n\n\nb": [],
    "<table>\n</table>\nx": [("table_touch", 3)],
    "<table>\n</table>\n\nx": [],
    "<table><img><del>$\n</table>": [],
    "<IMG x>": [("unexpected_img_tag", 1)],
    "a </del>": [("unexpected_del_tag", 1)],
    "$a$ \\$": [],
    "$a": [("math_unclosed", 1)],
    "|a|b|\n|-|-|\n|c|": [("md_table_ragged", 1)],
    "|a|b|\n|-|": [],
    "|a|\n|b|\n<table>\n</table>\n\n|c|d|": [],
    "<table>\n<tr><td></tr>\n<tr><td><td></tr>\n</table>": [("html_table_ragged", 2)],
    "<table>\n<tr><td></tr>\n<tr><td><td></tr>": [],
    "![](images/no.png)": [("missing_image", 1)],
    "![](images/yes.png)": [],
}


def test_lint(spark):
    docs = spark.createDataFrame(list(enumerate(LINT)), "book_id long, md string")
    files = spark.createDataFrame([(i, "images/yes.png") for i in range(len(LINT))], "book_id long, rel string")
    got = {i: [] for i in range(len(LINT))}
    for r in lint.scan(docs, files).collect():
        got[r.book_id].append((r.rule, r.line))
    assert [sorted(got[i]) for i in range(len(LINT))] == [sorted(v) for v in LINT.values()]


def test_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nx\nc\ny\nd"), (2, None, "n"), (3, "same", "same")], "k int, raw string, rebuilt string")
    got = {}
    for r in diff.diff(pairs, "k").orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.t, r.n or r.a or r.b))
    assert got == {1: [("eq", 1), ("del", "b"), ("add", "x"), ("eq", 1), ("add", "y"), ("eq", 1)], 2: [("add", "n")], 3: [("eq", 1)]}
