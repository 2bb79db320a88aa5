"""Column functions on lines, titles, tables and file names.  All are built-in expressions.

Patterns get the flags (?dU): Unicode classes for \\s and \\d, and only \\n ends a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed

U = "(?dU)"


def p(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags}){pattern}"


def sub(c: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(c, F.lit(p(pattern, flags)), F.lit(by))


def has(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(c, F.lit(p(pattern, flags)))


def strip(c: Column) -> Column:
    return sub(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def group(c: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(c, p(pattern, flags), n)


def split_lines(c: Column) -> Column:
    """Lines as universal line breaks cut them; no empty one at the end."""
    parts = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it; without this,
    nested patterns multiply into code too large to compile."""
    return F.element_at(F.transform(F.array(value), f), 1)


# --- headings and contents --------------------------------------------------------------------


def starts_hash(line: Column) -> Column:
    return has(line, r"^\s*#")


def bare(line: Column) -> Column:
    """The line without its heading marks."""
    return strip(sub(line, fixed.HASHES, ""))


def is_toc_line(line: Column) -> Column:
    def relaxed(s: Column) -> Column:
        short = lambda body: (F.length(body) <= fixed.TOC_BODY_CHARS) & ~has(body, fixed.IMAGE_MD) & ~F.contains(body, F.lit("<table"))
        return has(s, fixed.TOC_NUMBERED) & has(s, fixed.TOC_PAGE_TAIL) & let(sub(s, fixed.TOC_PAGE_TAIL, ""), short)

    return let(strip(line), lambda s: (s != "") & (has(s, fixed.TOC_STRICT) | relaxed(s)))


def strip_page_no(line: Column) -> Column:
    return strip(sub(sub(strip(line), fixed.TOC_PAGE_TAIL, ""), r"[….]{2,}\s*$", ""))


def toc_title(line: Column) -> Column:
    """The title in a line of contents, without number and page; null if there is none."""
    chapter, dotted = rf"^第\s*{fixed.CN_OR_AR}\s*章\s+(.+)$", r"^\d+(?:\.\d+)*\s+(.+)$"
    return let(strip_page_no(line), lambda body: F.when(has(body, chapter), strip(group(body, chapter))).when(has(body, dotted), strip(group(body, dotted))))


def norm_title(title: Column) -> Column:
    return F.translate(title, "—－：；，（）“”$\\ 　", '--:;,()""')


def unnumbered(title: Column) -> Column:
    """The title without any leading number, for a second look-up."""
    t = sub(title, rf"^第\s*{fixed.CN_OR_AR}\s*[章节]\s*", "")
    t = sub(t, r"^\d+(?:\.\d+)*\s*", "")
    t = sub(t, rf"^{fixed.CN_NUM}、\s*", "")
    return sub(t, rf"^[（(]\s*{fixed.CN_OR_AR}\s*[）)]\s*", "")


def heading(line: Column, s: Column | None = None) -> Column:
    """struct(level, title, board, kind) of a heading line, else null; the first rule that
    fits decides.  s: the line without its marks, if there is a column of it."""

    def h(level: int, title: Column, kind: str = "", board: bool = False) -> Column:
        return F.struct(F.lit(level).alias("level"), title.alias("title"), F.lit(board).alias("board"), F.lit(kind).alias("kind"))

    def rules(s: Column) -> Column:
        return (
            F.when(s == "", None)
            .when(has(s, fixed.BOARD), h(0, s, board=True))
            .when(has(s, fixed.CHAPTER), h(1, strip(sub(s, "^[·•]+", ""))))
            .when(has(s, fixed.CHAPTER_BARE) & starts_hash(line), h(1, s, "ar"))
            .when(has(s, fixed.SECTION), h(2, s, "jie"))
            .when(has(s, fixed.DOTTED), F.when(group(s, fixed.DOTTED, 3) == "", h(2, s, "dot")).otherwise(h(3, s)))
            .when(has(s, fixed.LISTED), h(2, s, "cn"))
            .when(has(s, fixed.BRACKETED), h(3, s))
        )

    return let(bare(line) if s is None else s, rules)


def cn_to_int(text: Column) -> Column:
    """Chinese or Arabic numeral to a number; what isn't known counts 0."""
    digit = F.create_map(*[F.lit(x) for kv in fixed.CN_DIGITS.items() for x in kv])
    of = lambda c, other=0: F.coalesce(F.try_element_at(digit, c), F.lit(other))
    second = lambda parts: F.coalesce(F.get(parts, F.lit(1)), F.lit(""))

    def tens(c: Column) -> Column:
        whole = lambda p: F.when(p[0] == "", 1).otherwise(of(p[0], 1)) * 10 + F.when(second(p) == "", 0).otherwise(of(second(p)))
        return F.when(F.contains(c, F.lit("十")), let(F.split(c, "十"), whole)).otherwise(of(c))

    def number(c: Column) -> Column:
        return F.when(c == "", 0).when(has(c, r"^\d+$"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(tens(c))

    def hundreds(s: Column) -> Column:
        return F.when(F.contains(s, F.lit("百")), let(F.split(s, "百"), lambda p: of(p[0]) * 100 + let(second(p), number))).otherwise(number(s))

    return let(strip(text), hundreds).cast("int")


# --- tables -----------------------------------------------------------------------------------


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))


def row_cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))


def max_cell_len(html: Column) -> Column:
    cells = F.flatten(F.transform(table_rows(html), row_cells))
    return F.coalesce(F.array_max(F.transform(cells, F.length)), F.lit(0))


def table_gate(html: Column) -> Column:
    """Why a table can't become Markdown, or ok: the first gate that it fails."""
    left = strip(F.regexp_replace(F.regexp_replace(html, r"(?s)<td[^>]*>.*?</td>", ""), r"<[^>]+>", ""))

    def sizes(rows: Column) -> Column:
        def columns(counts: Column) -> Column:
            n = F.element_at(counts, 1)
            return (
                F.when(F.size(counts) != 1, F.lit("ragged"))
                .when(~n.between(*fixed.TABLE_COLS), F.concat(F.lit("cols="), n.cast("string")))
                .when(~F.size(rows).between(*fixed.TABLE_ROWS), F.concat(F.lit("rows="), F.size(rows).cast("string")))
                .when(max_cell_len(html) > fixed.TABLE_CELL_CHARS, F.lit("cell_too_long"))
                .otherwise(F.lit("ok"))
            )

        return F.when(F.size(rows) == 0, F.lit("empty")).otherwise(let(F.array_distinct(F.transform(rows, lambda r: F.regexp_count(r, F.lit("<td")))), columns))

    return (
        F.when(F.regexp_count(html, F.lit("<table")) != F.regexp_count(html, F.lit("</table>")), F.lit("unbalanced"))
        .when(has(html, "colspan|rowspan", "i"), F.lit("merged"))
        .when(left != "", F.lit("impure"))
        .otherwise(let(table_rows(html), sizes))
    )


def is_math_table(html: Column) -> Column:
    dollars = F.regexp_count(html, F.lit(r"(?<!\\)\$"))
    return F.contains(F.lower(html), F.lit("<eq>")) | (dollars >= 2) | F.rlike(html, F.lit(r"\\[a-zA-Z]{2,}"))


def break_table(html: Column) -> Column:
    return F.replace(html, F.lit("><"), F.lit(">\n<"))


def escape_pipes(text: Column) -> Column:
    """Pipes inside $...$ become \\vert, others \\|."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\$[^$]*\$|[^$]+|\$"), F.lit(0))
    inside = lambda x: x.startswith("$") & x.endswith("$") & (F.length(x) > 2)
    return F.array_join(F.transform(parts, lambda x: F.when(inside(x), F.replace(x, F.lit("|"), F.lit("\\vert "))).otherwise(F.replace(x, F.lit("|"), F.lit("\\|")))), "")


def table_md(html: Column, decoding=None) -> Column:
    """An HTML table as Markdown rows between empty lines; the ruler has as many columns as
    the first row has pipes, less one.  decoding: a Decoding; BASIC if there is none."""
    decode = decoding or BASIC
    parts = F.regexp_extract_all(html, F.lit(r"(?s)<eq>.*?</eq>|(?:(?!<eq>.*?</eq>).)+"), F.lit(0))
    inner = decode.list(F.transform(parts, lambda x: F.regexp_extract(x, r"(?s)^<eq>(.*)</eq>$", 1)))
    formula = lambda x: F.when(x["part"].startswith("<eq>"), F.concat(F.lit("$"), x["inner"], F.lit("$"))).otherwise(x["part"])
    latex = F.array_join(F.transform(F.arrays_zip(parts.alias("part"), inner.alias("inner")), formula), "")
    cell = lambda c: escape_pipes(normalize_math(html_images(sub(c, r"\$\s{2,}\$", r"\$ \$"))))
    flat = lambda r: F.transform(row_cells(r), lambda c: F.replace(strip(c), F.lit("\n"), F.lit(" ")))
    rows = decode.lists(F.filter(F.transform(table_rows(latex), flat), lambda r: F.size(r) > 0))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    n = F.regexp_count(lines[0], F.lit(r"\|")) - 1
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    whole = F.when(F.size(lines) >= 2, F.concat(F.slice(lines, 1, 1), F.array(ruler), F.slice(lines, 2, 1 << 20))).otherwise(lines)
    return F.concat(F.lit("\n"), F.array_join(whole, "\n"), F.lit("\n"))


def md_columns(line: Column) -> Column:
    """Columns of a Markdown table line; escaped pipes don't count."""
    t = strip(F.replace(line, F.lit("\\|"), F.lit("\u0001")))
    return F.size(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"))


# --- markup and math --------------------------------------------------------------------------

ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&gt;", ">"), ("&lt;", "<"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape_basic(text: Column) -> Column:
    """Character references of a closed set, decoded once; quire.functions.entities has all."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


class Decoding(NamedTuple):
    """How character references are decoded: in a text, a list of texts, a list of lists."""

    text: Callable[[Column], Column]
    list: Callable[[Column], Column]
    lists: Callable[[Column], Column]


BASIC = Decoding(unescape_basic, lambda c: F.transform(c, unescape_basic), lambda c: F.transform(c, lambda r: F.transform(r, unescape_basic)))


def clean_markdown(text: Column, unescape=None) -> Column:
    decode = unescape or unescape_basic
    t = decode(decode(F.coalesce(text, F.lit(""))))
    t = F.replace(F.replace(F.replace(t, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(t, "(?i)</?del>", ""), "\n{3,}", "\n\n")


def html_images(text: Column) -> Column:
    return sub(text, r"""<img\b[^>]*?\bsrc=(["'])(?!https?://)(.*?)\1[^>]*>""", r"![]($2)", "i")


def normalize_math(text: Column) -> Column:
    """Block formulas on lines of their own, inline ones without inner blanks, \\( \\) as
    plain brackets.  Formulas are found from the left, blocks before inline ones."""
    t = sub(text, r"(?<!\$)\$\s{2,}\$(?!\$)", r"\$ \$")
    parts = F.regexp_extract_all(t, F.lit(r"(?s)\$\$.+?\$\$|\$.+?\$|[^$]+|\$"), F.lit(0))

    def fix(x: Column) -> Column:
        block = (F.length(x) > 4) & x.startswith("$$") & x.endswith("$$")
        inline = (F.length(x) > 2) & x.startswith("$") & x.endswith("$")
        inner = lambda k: strip(F.substr(x, F.lit(k + 1), F.length(x) - 2 * k))
        return F.when(block, F.concat(F.lit("$$\n"), inner(2), F.lit("\n$$"))).when(inline, F.concat(F.lit("$"), inner(1), F.lit("$"))).otherwise(x)

    t = F.array_join(F.transform(parts, fix), "")
    return F.replace(F.replace(t, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))


def display_math(text: Column) -> Column:
    """$$...$$ inside a line on lines of its own, for previews."""
    return F.regexp_replace(text, r"\$\$([^$\n]+)\$\$", "\n\\$\\$\n$1\n\\$\\$\n")


def dollars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<!\\)\$"))


def image_refs(text: Column) -> Column:
    """Relative paths of all images referred to, in order, with repeats."""
    md = F.regexp_extract_all(text, F.lit(f"(?i){fixed.IMAGE_REF}"), F.lit(0))
    return F.transform(md, lambda x: F.when(x.startswith("!"), F.regexp_extract(x, rf"(?i){fixed.IMAGE_REF}", 1)).otherwise(F.regexp_extract(x, rf"(?i){fixed.IMAGE_REF}", 2)))


# --- names ------------------------------------------------------------------------------------

ILLEGAL = r'[<>:"/\\|?*]'


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, ILLEGAL, "_"), r"^[ .]+|[ .]+$", "")


def _base(name: Column) -> Column:
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)


def _safe(base: Column, other: str) -> Column:
    t = F.regexp_replace(F.regexp_replace(base, ILLEGAL, "_"), r"^[ ._]+|[ ._]+$", "")
    return F.when(t == "", F.lit(other)).otherwise(t)


def safe_stem(name: Column, other: str = "unnamed") -> Column:
    base = _base(name)
    return _safe(F.when(F.contains(base, F.lit(".")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base), other)


def safe_title(name: Column, other: str = "未命名") -> Column:
    return _safe(_base(name), other)


def heading_md(level: Column, title: Column, board: Column) -> Column:
    marks = F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)))
    return F.when(board, F.concat(F.lit("## [板块] "), title)).otherwise(F.concat(marks, F.lit(" "), title))


def quote_key(key: Column) -> Column:
    """Percent-encoding of an object key; slashes stay."""
    q = F.url_encode(key)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def mime(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.MIME.items() for x in kv]), suffix), F.lit(fixed.MIME_OTHER))


def session_token(password: Column, salt: Column) -> Column:
    return F.concat(F.lit("web_"), F.substr(F.sha2(F.concat(password, salt), 256), F.lit(1), F.lit(48)))


def page_start(page_range: Column) -> Column:
    return F.coalesce(F.regexp_extract(page_range, r"p(\d+)", 1).try_cast("int"), F.lit(1))


def dir_name(id: Column, title: Column) -> Column:
    return F.concat(F.lit("b"), id.cast("string"), F.lit("_"), title)


def dir_prefix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(b\d+)_", 1), F.lit(""))
