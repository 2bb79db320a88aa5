"""HTML extraction by tag-path ratios.

Every text node has a root-to-leaf tag path, of tags with their class words.  Text length
(outside links) and punctuation are averaged over the nodes of a path and fused into one
ratio; ratios are smoothed along the page, the more the nearer two nodes stand in the tree,
and weighed by what a path's elements say of themselves.  Paths whose ratio passes a
threshold, the standard deviation on the page, are content.

The path with the most text among them leads: the smallest element around its nodes is the
article.  There all is kept but subtrees without content that are links, that name
themselves boilerplate, or that stand at the edges of an unnamed element.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

#: Of the standard deviation of the fused ratios.
THRESHOLD = 1.0
#: Share of the leading path's weight that the article's element must hold.
COVER = 0.9
#: What a ratio is multiplied by inside an article or main element, and inside one that names
#: itself boilerplate.
ARTICLE_WEIGHT, MARKED_WEIGHT = 2.0, 0.1
#: Of a smoothed ratio: what a node counts, and its neighbours at most.
OWN, NEAR = 0.5, 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label maction mark math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
#: Never part of an article's text; so are forms, unless most of the page is in one.
NEVER = frozenset("script style head title noscript template textarea select option button input iframe noembed noframes nav aside footer object applet embed svg canvas annotation annotation-xml menu dialog xmp audio video map datalist fieldset search".split())
#: Elements whose class, id and role are read; a paragraph, list item or inline element isn't
#: named boilerplate by them.
CONTAINERS = frozenset("article center details div dl fieldset figure header main ol section table ul".split())
#: What a container calls itself when it is no article: one of these words, with none besides
#: but those that only say what kind of box it is.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar comment comments commentlist disqus respond reply replies feedback "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright skiplink".split()
)
BOXES = frozenset("user users reader readers visitor visitors main site page top bottom left right primary secondary global header box bar list lists area section sections wrapper wrap container content inner outer block blocks item items group links link buttons button text widget widgets body thread form title row col column panel region slot unit post posts article articles blog entry news js ui the".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Parts of an article that stay beside its content nodes, and elements of no meaning.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure math details hr".split())
PAGE = frozenset(("#page", "html", "body"))
ARTICLE = frozenset(("article", "main"))
#: An open element of the value ends where an element of the key begins, inside the same parent.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tr td th thead tbody", "tbody": "tr td th thead tbody", "tfoot": "tr td th thead tbody", "option": "option", "optgroup": "option optgroup"}.items()}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}
#: Where these begin, an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A quote that never closes is a character as others, so that its tag ends at the next >.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|\"(?=[^\"]*\Z)|'(?=[^']*\Z))*)>?", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Headings over what readers say.
COMMENTS = re.compile(r"(?:\d+ )?(?:all |(?:reader|user|visitor)(?:s|'s|s')? )?comments?(?: ?\(\d+\))?:?|(?:leave|post|add|write) (?:a|your) (?:comment|reply)|\d+ (?:responses?|repl(?:y|ies))|(?:\d+ )?(?:kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
SPACE = re.compile(r"\s+")


#: Levels of a page, as browsers have them: deeper elements stand beside each other.
DEEPEST = 512


class Element:
    """n: its number on the page, parents before children.  path: the number of its tag path.
    dead: never part of the text.  form: the form that it is in, link: whether it is in a
    link, inside: in an article, marked: the outermost element that names itself boilerplate."""

    __slots__ = ("tag", "parent", "n", "paths", "path", "depth", "dead", "inside", "link", "form", "marked")

    def __init__(self, tag: str, parent: Element | None, n: int = 0, dead: bool = False, names: list[str] | None = None, marked: bool = False):
        self.tag, self.parent, self.n, self.dead = tag, parent, n, dead
        self.paths: dict[tuple, int] = parent.paths if parent else {}
        step = (parent.path if parent else -1, tag, *(names or []))
        self.path = self.paths.setdefault(step, len(self.paths))
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ARTICLE or (parent is not None and parent.inside)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.form = (parent.form if parent else None) or (self if tag == "form" else None)
        self.marked = (parent.marked if parent else None) or (self if marked else None)


def named(tag: str, attrs: str) -> tuple[list[str], bool, bool]:
    """Class words of an element, without digits; whether it names itself boilerplate, and
    whether it is hidden."""
    words, marked, hidden = [], False, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
        elif name == "role":
            marked |= value in ROLES
        elif name in ("class", "id"):
            for word in re.sub(r"\d+", "", value).replace("_", "-").split():
                if name == "class":
                    words.append(word)
                parts = {x for x in word.split("-") if x}
                marked |= bool(parts & MARKED) and parts <= MARKED | BOXES
    return sorted(words), marked and tag in CONTAINERS, hidden


def blocks_of(source: str) -> list[tuple[Element, str, int]]:
    """Text blocks in page order: the block element, its text, with references decoded and
    white space made single, and how many characters are in links; without dead elements."""
    root = Element("#page", None)
    top, made = root, 0
    out: list[tuple[Element, list[str], list[int]]] = []
    holder: Element | None = None  # the block element of the text gathered last
    at, n = 0, len(source)

    def text(part: str) -> None:
        nonlocal holder
        if not part or top.dead:
            return
        block = top
        while block.tag in INLINE and block.parent is not None:
            block = block.parent
        if holder is not block or not out:
            out.append((block, [], [0]))
            holder = block
        out[-1][1].append(part)
        if top.link:
            out[-1][2][0] += len(part.strip())

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" or tag not in INLINE:
                holder = None
            e = top
            while e.parent is not None and e.tag != tag:
                if e.tag in ("article", "body", "table") and tag in INLINE:
                    e = root
                    break
                e = e.parent
            if e.parent is not None:
                top = e.parent
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                text(" ")
            continue
        if tag not in INLINE:
            holder = None
        if tag in ENDS_P:
            e = top
            while e.parent is not None and e.tag in INLINE:
                e = e.parent
            if e.tag == "p" or (e.tag in HEADINGS and tag in HEADINGS):
                top = e.parent
        if tag in CLOSES:
            e = top
            while e.parent is not None and e.tag not in SCOPE[tag]:
                if e.tag in CLOSES[tag]:
                    top = e.parent
                e = e.parent
        if tag == "body":
            e = top
            while e.parent is not None and e.tag != "head":
                e = e.parent
            if e.tag == "head":
                top = e.parent
        names, marked, hidden = named(tag, m[3]) if m[3] and tag not in ("html", "body") else ([], False, False)
        if tag == "article" and not top.inside or tag == "main":
            marked = marked and tag != "main" and names == ["comment"]  # an article's class may be its subject
        dead = top.dead or hidden or tag in NEVER or (tag == "header" and not top.inside)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path", "use", "rect", "circle"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            if not (dead or top.dead):
                text(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        made += 1
        top = Element(tag, top if top.depth < DEEPEST else top.parent, made, dead, names, marked)
    done = []
    for e, parts, linked in out:
        t = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if t:
            done.append((e, t, min(linked[0], len(t))))
    forms: dict[int, int] = defaultdict(int)
    for e, t, _ in done:
        forms[id(e.form) if e.form else 0] += len(t)
    most = sum(forms.values()) / 2
    return [b for b in done if b[0].form is None or forms[id(b[0].form)] > most]


def without_comments(blocks: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """Blocks but those under a heading that announces readers' comments: up to the end of
    the element that it stands in (with more than itself), or a heading as high."""
    if not any(e.tag in HEADINGS and COMMENTS.fullmatch(t) for e, t, _ in blocks[1:]):
        return blocks
    count = gathered(elements_of(blocks), Counter(e.n for e, _, _ in blocks))
    out, shut, rank = [], None, ""
    for e, t, linked in blocks:
        if shut is not None:
            x = e
            while x is not None and x is not shut:
                x = x.parent
            if x is None or e.tag in HEADINGS and e.tag <= rank and not COMMENTS.fullmatch(t):
                shut = None
        if shut is None and out and e.tag in HEADINGS and COMMENTS.fullmatch(t):
            shut, rank = e, e.tag
            while shut.parent is not None and count[shut.n] == 1:
                shut = shut.parent
        if shut is None:
            out.append((e, t, linked))
    return out


def nearness(a: Element, b: Element) -> float:
    """How much of the two chains up to the root is common, squared."""
    x, y = (a, b) if a.depth > b.depth else (b, a)
    while x.depth > y.depth:
        x = x.parent
    while x is not y:
        x, y = x.parent, y.parent
    return ((x.depth + 1) / (max(a.depth, b.depth) + 1)) ** 2


def elements_of(blocks: list[tuple[Element, str, int]]) -> list[Element]:
    """All elements around the blocks, parents before children."""
    seen: dict[int, Element] = {}
    for e, _, _ in blocks:
        while e is not None and e.n not in seen:
            seen[e.n] = e
            e = e.parent
    return [seen[n] for n in sorted(seen)]


def gathered(elements: list[Element], of: dict[int, float]) -> dict[int, float]:
    """Sums (of numbers by element) over each element and all that is in it."""
    out = defaultdict(float, of)
    for e in reversed(elements):
        if e.parent is not None and out[e.n]:
            out[e.parent.n] += out[e.n]
    return out


def ratios(blocks: list[tuple[Element, str, int]]) -> np.ndarray:
    """For each block the smoothed, fused and weighed ratio of its tag path: characters a
    node times (one and) punctuation a node."""
    nodes, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)  # by path
    for e, t, linked in blocks:
        nodes[e.path] += 1
        chars[e.path] += len(t) - linked
        marks[e.path] += len(PUNCTUATION.findall(t)) * (len(t) - linked) / len(t)
    fused = {p: math.sqrt(chars[p] / n * (1 + marks[p] / n)) for p, n in nodes.items()}
    near = [NEAR * nearness(a[0], b[0]) for a, b in zip(blocks, blocks[1:])]
    smooth: dict[int, float] = defaultdict(float)
    for i, (e, _, _) in enumerate(blocks):
        before, after = (near[i - 1] if i else 0.0), (near[i] if i < len(near) else 0.0)
        total = OWN * fused[e.path]
        total += before * fused[blocks[i - 1][0].path] if i else 0.0
        total += after * fused[blocks[i + 1][0].path] if i < len(near) else 0.0
        smooth[e.path] += total / (OWN + before + after) / nodes[e.path]
    weight = lambda e: (MARKED_WEIGHT if e.marked else 1.0) * (ARTICLE_WEIGHT if e.inside else 1.0)
    return np.array([smooth[e.path] * weight(e) for e, _, _ in blocks])


def article_of(blocks: list[tuple[Element, str, int]], elements: list[Element], content: np.ndarray) -> tuple[Element, int]:
    """The article's element and its leading path.  A node weighs the square of its length,
    so that many short ones elsewhere on the page weigh little."""
    total: dict[int, int] = defaultdict(int)
    for (e, t, linked), keep in zip(blocks, content):
        total[e.path] += (len(t) - linked + 1) * int(keep)
    lead = max(total, key=lambda p: total[p])
    own: dict[int, int] = defaultdict(int)
    for e, t, _ in blocks:
        if e.path == lead:
            own[e.n] += len(t) ** 2
    weight = gathered(elements, own)
    region = max((x for x in elements if weight[x.n] >= COVER * weight[elements[0].n]), key=lambda x: x.depth)
    while region.parent is not None and (region.tag in INLINE or region.tag in ("p", "li", "td", "th", "tr", "tbody", "pre", "dd", "dt", "blockquote", *HEADINGS)):
        region = region.parent
    around = region
    while around is not None and not (around.tag in ARTICLE and around.marked is None):
        around = around.parent
    return around or region, lead


def main_text(source: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if there is none.

    What is asked of elements is gathered once from the leaves up, or once from the root down,
    so a page takes time in proportion to its length, however deep it is."""
    blocks = without_comments(blocks_of(source or ""))
    if not blocks:
        return ""
    fused = ratios(blocks)
    content = fused >= min(THRESHOLD * float(fused.std()), float(fused.max()))
    elements = elements_of(blocks)
    region, lead = article_of(blocks, elements, content)
    own = [defaultdict(int) for _ in range(4)]
    for (e, t, linked), keep in zip(blocks, content):
        for d, value in zip(own, (len(t), linked, int(keep), int(e.path == lead))):
            d[e.n] += value
    chars, links, with_content, leads = (gathered(elements, d) for d in own)
    below_flow: set[int] = set()  # elements with some of FLOW, but not only paragraphs, in them
    for e in reversed(elements):
        if e.parent is not None and (e.n in below_flow or e.tag in FLOW and e.tag != "p"):
            below_flow.add(e.parent.n)
    around, child, other = set(), {}, set()  # in the region's parent; the region's child that one is in; in another article
    within: set[int] = set()
    for e in elements:
        up = e.parent.n if e.parent is not None else None
        if e is region or up in within:
            within.add(e.n)
        if e is region.parent or up in around:
            around.add(e.n)
        if up in within:
            child[e.n] = child.get(up, e)
            if up in other or e.tag == "article" and not leads[e.n]:
                other.add(e.n)
    inside = [e.n in within for e, _, _ in blocks]
    at = np.flatnonzero(content & np.array(inside))
    first, last = int(at[0]), int(at[-1])
    page_level = region.tag in PAGE
    titled = any(e.tag == "h1" and i for (e, _, _), i in zip(blocks, inside))

    def stays(i: int) -> bool:
        e = blocks[i][0]
        if not inside[i]:  # the title, and content before the article in the same element
            return i < first and e.marked is None and (e.tag == "h1" and not titled or bool(content[i]) and e.n in around and region.parent.tag not in PAGE)
        if e.n in other:
            return False
        if content[i]:
            return True
        if e.marked is not None and e.marked.n in child:
            return False
        c = child.get(e.n, e)
        if with_content[c.n] or e.n not in child:
            return True
        if links[c.n] > chars[c.n] / 2 and c.tag not in HEADINGS and c.tag != "p":
            return False
        edge = i < first or i > last
        if c.tag in FLOW:
            return not (page_level and edge and c.tag not in HEADINGS)
        if region.tag in ARTICLE:
            return True
        return not page_level and (not edge or c.n in below_flow)

    return "\n".join(t for i, (_, t, _) in enumerate(blocks) if stays(i))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``main_text``.

    Null and empty html: an empty text.  Whole pages are parsed, however long.  Of paths
    with equal text, and of elements with equal weight, the first counts.  Other columns
    stay (one named ``main_text`` is replaced); repeated rows are each parsed.  An empty
    table gives an empty one.
    """
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return pages.withColumn("main_text", run(F.col(html_col)))
