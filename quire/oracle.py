"""SQL for DuckDB that gives the rows of quire.queries; inputs are made by the same rules."""

from __future__ import annotations

from quire import fixed

N = fixed.CN_OR_AR
CHAPTER, BARE, SECTION, DOTTED, LISTED, BRACKETED, BOARD = fixed.CHAPTER, fixed.CHAPTER_BARE, fixed.SECTION, fixed.DOTTED, fixed.LISTED, fixed.BRACKETED, fixed.BOARD

#: body(book_id, batch_idx, ln, line)
BODY = """
d0 as (select doc_id, string_split(text, chr(10)) as t from documents where text is not null),
d1 as (select doc_id, t, unnest(range(1, len(t) + 1)) as ln from d0),
d2 as (select doc_id, ln, t[ln] as raw, (ln - 1) // 12 + 1 as ch, (ln - 1) % 12 as k from d1),
body as (select doc_id as book_id, (ln - 1) // 25 + 1 as batch_idx, ln,
  case when k = 0 and doc_id % 16 = 9 then raw
       when k = 0 and doc_id % 8 = 2 then '# T' || ch || 'x'
       when k = 0 then '# 第' || ch || '章 T' || ch || 'x'
       when k = 2 then '# 第' || case when doc_id % 5 = 0 and ch % 2 = 0 then '3' else '1' end || '节 A'
       when k = 7 then '# 第2节 D'
       when k = 3 then case when doc_id % 2 = 0 then '## 一、B' else '一、B' end
       when k = 4 then '### （一）C'
       when k = 9 and doc_id % 3 = 0 then '习题'
       when k = 9 then raw || ' ![](images/' || doc_id || '_' || ln || '.jpg)'
       when k = 10 then ln || '.' || k || ' e ' || ln
       when k = 5 and doc_id % 4 = 1 then '<table><tr><td>p' || ln || '</td><td>2</td></tr>'
       when k = 6 and doc_id % 4 = 1 then '<tr><td>1</td><td>$x$</td></tr></table>'
       else raw end as line from d2)"""

#: lines: body with the contents of every second book
LINES = BODY + """,
h0 as (select doc_id, unnest(range(0, (len(t) - 1) // 12 + 2)) as i from d0 where doc_id % 2 = 0),
lines as (select * from body union all
  select doc_id, case when doc_id % 8 = 0 then 0 else 1 end, i - 1000, case when i = 0 then '## 目录' when doc_id % 8 = 2 then i || ' T' || i || 'x …… ' || (i * 3)
    else '第' || i || '章 T' || i || 'x' || case when doc_id % 8 = 0 then ' …… ' || (i * 3) else '' end end from h0 where i = 0 or i % 4 <> 0)"""


def fold(source: str) -> str:
    """folded(book_id, batch_idx, pos, line) of a relation of raw lines."""
    return f"""
f0 as (select *, case when contains(line, '</table>') then 0 when contains(line, '<table') then 1 end as ev from {source}),
f1 as (select *, coalesce(last_value(ev ignore nulls) over (partition by book_id, batch_idx order by ln rows between unbounded preceding and 1 preceding), 0) as op from f0),
f2 as (select *, sum(case when op = 0 then 1 else 0 end) over (partition by book_id, batch_idx order by ln rows unbounded preceding) as pos from f1),
folded as (select book_id, batch_idx, pos::bigint as pos, string_agg(line, chr(10) order by ln) as line from f2 group by book_id, batch_idx, pos)"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def bare(c: str) -> str:
    return strip(f"regexp_replace({c}, '^#{{1,6}}\\s*', '')")


def m(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def toc(s: str) -> str:
    """s is stripped already."""
    tail = fixed.TOC_PAGE_TAIL
    body = f"regexp_replace({s}, '{tail}', '')"
    relaxed = rf"{m(s, fixed.TOC_NUMBERED)} and {m(s, tail)} and length({body}) <= 60 and not {m(body, fixed.IMAGE_MD)} and not contains({body}, '<table')"
    return f"({s} <> '' and ({m(s, fixed.TOC_STRICT)} or ({relaxed})))"


def page_cut(s: str) -> str:
    tail = fixed.TOC_PAGE_TAIL
    return strip(rf"regexp_replace(regexp_replace({strip(s)}, '{tail}', ''), '[….]{{2,}}\s*$', '')")


def toc_title(s: str) -> str:
    b = page_cut(s)
    a1, a2 = rf"^第\s*{N}\s*章\s+(.+)$", r"^\d+(?:\.\d+)*\s+(.+)$"
    take = lambda a: strip(f"regexp_extract({b}, '{a}', 1)")
    return f"case when {m(b, a1)} then {take(a1)} when {m(b, a2)} then {take(a2)} end"


def norm(c: str) -> str:
    return f"""replace(replace(replace(replace(translate({c}, '—－：；，（）“”', '--:;,()""'), '$', ''), chr(92), ''), ' ', ''), '　', '')"""


def unnumbered(c: str) -> str:
    t = rf"regexp_replace({c}, '^第\s*{N}\s*[章节]\s*', '')"
    t = rf"regexp_replace({t}, '^\d+(?:\.\d+)*\s*', '')"
    t = rf"regexp_replace({t}, '^{fixed.CN_NUM}、\s*', '')"
    return rf"regexp_replace({t}, '^[（(]\s*{N}\s*[）)]\s*', '')"


def heading(s: str, line: str) -> str:
    """struct of level, title, board, kind; s: the bare line."""
    h = lambda level, title, kind="", board="false": "{'level': %s, 'title': %s, 'board': %s, 'kind': '%s'}" % (level, title, board, kind)
    return f"""case when {s} = '' then null when {m(s, BOARD)} then {h(0, s, board='true')}
      when {m(s, CHAPTER)} then {h(1, f"trim(ltrim({s}, '·•'))")}
      when {m(s, BARE)} and {m(line, '^ *#')} then {h(1, s, 'ar')}
      when {m(s, SECTION)} then {h(2, s, 'jie')}
      when {m(s, DOTTED)} then case when regexp_extract({s}, '{DOTTED}', 3) = '' then {h(2, s, 'dot')} else {h(3, s)} end
      when {m(s, LISTED)} then {h(2, s, 'cn')} when {m(s, BRACKETED)} then {h(3, s)} end"""


#: tables(k, html)
TABLES = """
t0 as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as rn, l_orderkey as k from lineitem),
t1 as (select k, rn, '<tr>' || case when k % 11 = 0 and rn = 1 then '<td colspan="2">' else '<td>' end || 'p' || l_partkey || '</td><td>' ||
  case when k % 7 = 0 and rn = 1 then '$q_' || rn || '$' when k % 29 = 0 and rn = 1 then repeat('x', 301) else 's' || l_suppkey end || '</td>' ||
  case when k % 13 = 0 and rn = 2 then '<td>z</td>' else '' end || case when k % 17 = 0 then repeat('<td>w</td>', 7) else '' end || '</tr>' as r from t0),
tables as (select k, '<table>' || case when k % 31 = 0 then '' else string_agg(r, '' order by rn) end || case when k % 37 = 0 then repeat('<tr><td>a</td><td>b</td></tr>', 21) else '' end || case when k % 19 = 0 then 'stray' else '' end || case when k % 23 = 0 then '' else '</table>' end as html from t1 group by k)"""

_ROWS = r"regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1)"
_CELLS = rf"list_transform({_ROWS}, lambda r: list_transform(regexp_extract_all(r, '(?s)<td[^>]*>(.*?)</td>', 1), lambda c: length(c)))"
MAX_CELL = f"coalesce(list_max(flatten({_CELLS})), 0)"
_COUNT = lambda x, s: f"((length({x}) - length(replace({x}, '{s}', ''))) // {len(s)})"
GRADED = TABLES + rf""",
g0 as (select k, html, list_distinct(list_transform({_ROWS}, lambda r: {_COUNT('r', '<td')})) as c, len({_ROWS}) as n, {MAX_CELL} as max_cell,
  regexp_replace(regexp_replace(html, '(?s)<td[^>]*>.*?</td>', '', 'g'), '<[^>]+>', '', 'g') as rest from tables),
graded as (select k, html, max_cell,
  case when {_COUNT('html', '<table')} <> {_COUNT('html', '</table>')} then 'unbalanced' when regexp_matches(html, '(?i)colspan|rowspan') then 'merged'
       when trim(rest) <> '' then 'impure' when n = 0 then 'empty' when len(c) <> 1 then 'ragged' when c[1] not between 2 and 8 then 'cols=' || c[1]
       when n not between 2 and 20 then 'rows=' || n when max_cell > 300 then 'cell_too_long' else 'ok' end as gate,
  contains(lower(html), '<eq>') or {_COUNT('html', '$')} >= 2 or regexp_matches(html, '\\[a-zA-Z]{{2,}}') as is_math from g0)"""

BOOKS = """
books as (select o_orderkey as id, 'T' || o_orderkey as title, 1 + o_orderkey % 120 as page_count,
  ['pending', 'parsing', 'parsed', 'structure_ok', 'failed'][o_orderkey % 5 + 1] as parse_status,
  case when o_orderkey % 3 = 0 then (o_orderkey % 10) || '/' || (o_orderkey % 10 + o_orderkey % 4) end as parse_progress,
  case when o_orderkey % 5 = 4 then 'e' || (o_orderkey % 13) end as parse_error from orders)"""

FILES = """
files0 as (select book_id, regexp_extract(line, 'images/[0-9_]+[.]jpg') as rel, ln from body),
files as (select book_id, rel, length(rel) * 1000 as bytes from files0 where rel <> '' and (book_id + ln) % 5 <> 0
  union all select doc_id, 'images/orphan_' || doc_id || '.jpg', length('images/orphan_' || doc_id || '.jpg') * 1000 from documents where doc_id % 7 = 0)"""
REFS = r"""
refs as (select book_id, batch_idx, ln, line, unnest(regexp_extract_all(line, '!\[[^\]]*\]\((images/[^)\s]+)\)', 1)) as rel from body)"""

#: batches(book_id, batch_idx, page_start, page_end, text) of body or lines
def batches(source: str) -> str:
    return f"""
batches as (select book_id, batch_idx, greatest((batch_idx - 1) * 25 + 1, 0) as page_start, batch_idx * 25 as page_end, string_agg(line, chr(10) order by ln) as text from {source} group by book_id, batch_idx)"""


MD = BODY + r""",
md0 as (select book_id, ln, (case when (ln - 1) % 12 = 5 and book_id % 4 = 0 then '| a | b |' when (ln - 1) % 12 = 6 and book_id % 4 = 0 then '| c |'
  when (ln - 1) % 12 = 7 and book_id % 8 = 0 then '| e | f |' when (ln - 1) % 12 = 11 and book_id % 6 = 0 then '<del>x</del>'
  when (ln - 1) % 12 = 8 and book_id % 9 = 0 then '<IMG src="u.png">' else line end) || case when ln % 10 = 8 then '$' else '' end || case when ln % 15 = 14 then chr(10) || chr(10) || chr(10) else '' end as line from body),
md as (select book_id, string_agg(line, chr(10) order by ln) as md from md0 group by book_id)"""

LINT = MD + r""",
l0 as (select book_id, string_split(md, chr(10)) as t from md),
l1 as (select book_id, t, unnest(range(1, len(t) + 1)) as i from l0),
l2 as (select book_id, i, trim(t[i]) as s from l1),
l3 as (select *, starts_with(s, '<table') as b, contains(s, '</table>') as e, coalesce(last_value(case when contains(s, '</table>') then 0 when starts_with(s, '<table') then 1 end ignore nulls)
  over (partition by book_id order by i rows between unbounded preceding and 1 preceding), 0) as before from l2),
l4 as (select *, not (before = 1 or b) as free from l3),
l5 as (select *, sum(b::int) over w as tno, sum((free and not starts_with(s, '|'))::int) over w as blk, sum(((free and s <> '') or b)::int) over w as run,
  last_value(case when free or e then s end ignore nulls) over (partition by book_id order by i rows between unbounded preceding and 1 preceding) as prev from l4 window w as (partition by book_id order by i rows unbounded preceding)),
l6 as (select *, sum((free and s = '')::int) over (partition by book_id, run order by i rows unbounded preceding) as blanks from l5),
issues as (
  select book_id, 'blank_run' as rule, i as line from l6 where free and s = '' and blanks = 3
  union all select book_id, 'table_touch', i from l6 where free and s <> '' and starts_with(prev, '</table')
  union all select book_id, 'unexpected_img_tag', i from l6 where free and regexp_matches(s, '(?i)<img\b')
  union all select book_id, 'unexpected_del_tag', i from l6 where free and regexp_matches(s, '(?i)</?del\b')
  union all select book_id, 'math_unclosed', i from l6 where free and (length(replace(s, '\$', '')) - length(replace(replace(s, '\$', ''), '$', ''))) % 2 = 1
  union all select book_id, 'md_table_ragged', min(i) from l6 where free and starts_with(s, '|') group by book_id, blk having count(*) >= 3 and count(distinct len(string_split(trim(s, '|'), '|'))) > 1
  union all select book_id, 'html_table_ragged', min(i) filter (where contains(s, '<tr')) from l6 where not free group by book_id, tno
    having count(distinct case when contains(s, '<tr') then len(regexp_extract_all(s, '<td\b')) end) > 1 and bool_or(e))"""


def tree(version: int, source: str = "lines") -> str:
    """x7: lines with roles; nodes: the tree; of a relation of raw lines."""
    drop = "(ratio <= 0.5 and not toc)" if version == 2 else "(ratio <= 0.5 and not strict)"
    driven = "style = 'numbered' and coalesce(len(entries), 0) >= 3" if version == 2 else "false"
    enter = f"(line in ('目录', '目 录', '目　录') or trim(ltrim(line, '#')) = '目录')"
    leave = f"({m('line', '^#')} and ({m('bare', CHAPTER)} or {m('bare', BARE)}))"
    entry_no = rf"^第\s*({N})\s*[章篇]\s*(.*)$"
    num = lambda c: f"coalesce(try_cast({c} as int), case {c} when '一' then 1 else 0 end)"
    known = lambda c: f"list_contains(coalesce(titles, []), {norm(c)})"
    chapter_title = rf"^第\s*({N})\s*章\s*(.*)$"
    weak = f"(h.kind = 'cn' or (h.kind = '' and h.level = 3 and {m('h.title', BRACKETED)}))"
    take = f"(h is not null and (not {weak} or {m('line', '^#')} or {known('h.title')} or {known(unnumbered('h.title'))}))" if version == 2 else "(h is not null)"
    prev = "(partition by book_id order by o rows between unbounded preceding and 1 preceding)"
    upto = "(partition by book_id order by o rows unbounded preceding)"
    within = "(partition by book_id, chapter_no order by o rows between unbounded preceding and 1 preceding)"
    parents = "case when level = 2 then p2 when level = 3 then p3 when level = 4 then p4 end" if version == 2 else "null"
    rest = strip(f"regexp_extract(line, '{entry_no}', 2)")
    page = r"(?:[（(]?\s*(\d+)\s*[）)]?|\.{2,}\s*(\d+))\s*$"
    entry_title = strip(f"regexp_replace({strip(f"regexp_replace(rest, '{page}', '')")}, '[….·\\-—\\s]+$', '')")
    by_hash = f"style = 'hash' and {m('line', '^ *#')} and bare <> '' and not {m('bare', BOARD)} and not {m('bare', BARE)} and not {m('bare', SECTION)} and {known('bare')}"
    stranger = f"style = 'hash' and h0.level = 1 and len(coalesce(titles, [])) > 0 and not {known("trim(ltrim(h0.title, '·•'))")}"
    return "with recursive " + LINES + "," + fold(source) + rf""",
x0 as (select book_id, batch_idx, row_number() over (partition by book_id order by batch_idx, pos) as o, {strip('line')} as line from folded),
x1 as (select *, {toc('line')} as toc, {m('line', fixed.TOC_STRICT)} as strict, {bare('line')} as bare from x0),
x2 as (select *, avg(toc::int) over (partition by book_id, batch_idx) as ratio from x1),
x3 as (select *, count(*) filter (where line <> '' and not strict and {m('bare', CHAPTER)}) over (partition by book_id) as numbered,
  count(*) filter (where line <> '' and not strict and bare <> '' and not {m('bare', CHAPTER)} and {m('line', '^#')} and not {m('bare', BOARD)}) over (partition by book_id) as hashed,
  min(case when {enter} then o end) over (partition by book_id) as anchor from x2),
titles as (select book_id, list(distinct t) as titles from (select book_id, {norm(toc_title('line'))} as t from x1 where toc) where t <> '' group by book_id),
stops as (select book_id, min(o) as stop from x3 where o > anchor and {m('line', rf'^#+\s*第\s*{N}\s*章')} group by book_id),
en0 as (select book_id, o, {num(f"regexp_extract(line, '{entry_no}', 1)")} as no, {rest} as rest
  from x3 left join stops using (book_id) where o > anchor and o < coalesce(stop, 1000000000) and {m('line', entry_no)}),
en1 as (select book_id, o, no, {entry_title} as title, case when {m('rest', page)} then coalesce(try_cast(regexp_extract(rest, '{page}', 1) as int), try_cast(regexp_extract(rest, '{page}', 2) as int)) end as page from en0),
en as (select book_id, row_number() over (partition by book_id order by o) as pos, no, {norm('title')} as title, page from en1 where title <> ''),
es as (select book_id, list({{'pos': pos, 'no': no, 'title': title, 'page': page}} order by pos) as entries from en group by book_id),
x4 as (select x3.*, titles, entries, case when numbered > 0 then 'numbered' when hashed >= 3 then 'hash' else 'numbered' end as style
  from x3 left join titles using (book_id) left join es using (book_id) where line <> ''),
x5 as (select *, {driven} as driven, coalesce(last_value(case when {enter} then 1 when {leave} then 0 end ignore nulls) over {prev}, 0) as region from x4 where {drop}),
x60 as (select *, coalesce({heading('bare', 'line')}, case when {by_hash} then {{'level': 1, 'title': trim(ltrim(bare, '#')), 'board': false, 'kind': 'hash'}} end) as h0 from x5 where not driven or (case when region = 1 then {leave} else not {enter} end)),
x6 as (select *, case when not coalesce({stranger}, false) then h0 end as h from x60),
x7 as (select *, coalesce(h.board, false) as board, coalesce(h.level = 1 and not h.board, false) as first, {num(f"regexp_extract(h.title, '{chapter_title}', 1)")} as cno, {norm(f"trim(regexp_extract(h.title, '{chapter_title}', 2))")} as cbody from x6),
cand as (select book_id, o, list_filter(entries, lambda e: e.no = cno and e.title = cbody and cbody <> '')[1] as e from x7 where first and driven),
okay as (select book_id, o, e.page as page, e.pos > coalesce(max(e.pos) over {prev}, 0) as confirmed from cand),
y0 as (select x7.*, page, first and (not driven or coalesce(confirmed, false)) as opens from x7 left join okay using (book_id, o)),
y1 as (select *, sum(opens::int) over {upto} as chapter_no, coalesce(sum(opens::int) over {prev}, 0) > 0 as in_book from y0),
y2 as (select *, coalesce(last_value(case when board and in_book then 1 when first then 0 end ignore nulls) over {prev}, 0) = 1 and not first as in_board from y1),
y3 as (select *, {take} and not board and not first and not in_board as sub from y2),
y4 as (select *, last_value(case when opens then '' when sub and h.kind in ('jie', 'dot') then h.kind end ignore nulls) over {prev} as base,
  max(case when opens or (sub and h.kind in ('jie', 'dot')) then o end) over {prev} as base_o, max(case when sub and h.kind = 'cn' then o end) over {prev} as cn_o from y3),
y5 as (select *, case when board then 0 when sub and h.kind = 'cn' then case when base = 'jie' then 3 else 2 end
    when sub and h.kind = '' and h.level = 3 then case when base = 'jie' and cn_o > base_o then 4 else 3 end else h.level end as level,
  case when opens then 'chapter' when board and in_book then 'board' when board then 'dropped' when in_board then 'content' when first then case when in_book then 'content' else 'dropped' end
    when sub then case when in_book then 'sub' else 'dropped' end when in_book then 'content' else 'front' end as role from y4),
y6 as (select *, role in ('chapter', 'board', 'sub') as node, max(case when role in ('chapter', 'board', 'sub') then o end) over {upto} as node_id from y5),
y7 as (select *, max(case when node and level < 2 then o end) over {within} as p2, max(case when node and level < 3 then o end) over {within} as p3, max(case when node and level < 4 then o end) over {within} as p4,
  max(case when opens then o end) over {within} as pc from y6),
marked as (select *, case when role in ('sub', 'board') then coalesce(case when role = 'sub' then {parents} end, pc) end as parent_id from y7),
nodes as (select book_id, chapter_no::bigint as chapter_no, node_id, max(case when node then parent_id end) as parent_id, max(case when node then level end)::bigint as level, bool_or(role = 'board') as board,
  max(case when node then h.title end) as title, max(case when node and opens and coalesce(page, 0) <> 0 then 'p' || page when node then 'p' || greatest((batch_idx - 1) * 25 + 1, 0) || '-' || (batch_idx * 25) end) as page_range,
  sum(length(case when node then h.title else line end))::bigint as char_count, count(*) filter (where role = 'content' and {m('line', fixed.IMAGE_MD)}) as image_count,
  count(*) filter (where role = 'content' and contains(line, '<table')) as table_count
  from marked where role in ('chapter', 'board', 'sub', 'content') group by book_id, chapter_no, node_id)"""


TREE = tree(2)
NODES = "select book_id, chapter_no, node_id, parent_id, level, board, title, page_range, char_count, image_count, table_count from nodes"
DEAD = "dead as (select book_id, node_id from nodes where board union select n.book_id, n.node_id from nodes n join dead d on n.book_id = d.book_id and n.parent_id = d.node_id)"
SECTIONS = rf"""
sec as (select n.book_id, p.chapter_no, p.title, list(try_cast(regexp_extract(n.title, '^第\s*({N})\s*节', 1) as int) order by n.node_id) as nums
  from nodes n join nodes p on n.book_id = p.book_id and n.parent_id = p.node_id and p.level = 1 where not n.board and {m('n.title', rf'^第\s*{N}\s*节')} group by n.book_id, p.chapter_no, p.title),
cont as (select book_id, chapter_no, title || ': 节编号不连续 [' || array_to_string(nums, ', ') || ']（可能漏识别标题）' as warning from sec
  where len(nums) > 1 and nums <> range(list_min(nums), list_max(nums) + 1))"""

_IMG_MD = r"""regexp_replace({0}, '(?i)<img\b[^>]*?\bsrc=["'']([^"'']*)["''][^>]*>', '![](\1)', 'g')"""

#: md of content lines: the inputs have no entities, blocks or brackets but these.
_CONTENT = r"case when starts_with(line, '<table') then chr(10) || replace(line, '><', '>' || chr(10) || '<') || chr(10) else mathed end"


def _math(c: str) -> str:
    """Formulas in a text of known inputs, by a list of tokens."""
    t = rf"regexp_replace({c}, '([^$]|^)\$\s{{2,}}\$([^$]|$)', '\1$ $\2', 'g')"
    tokens = rf"regexp_extract_all({t}, '(?s)\$\$.+?\$\$|\$.+?\$|[^$]+|\$')"
    fix = f"case when length(x) > 4 and starts_with(x, '$$') and ends_with(x, '$$') then '$$' || chr(10) || {strip('x[3:length(x)-2]')} || chr(10) || '$$' when length(x) > 2 and starts_with(x, '$') and ends_with(x, '$') then '$' || {strip('x[2:length(x)-1]')} || '$' else x end"
    return rf"replace(replace(array_to_string(list_transform({tokens}, lambda x: {fix}), ''), '\(', '('), '\)', ')')"


#: A table of the inputs as Markdown.
_TABLE_MD = r"chr(10) || '| ' || regexp_extract(line, '<td>(p\d+)</td>', 1) || ' | 2 |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | $x$ |' || chr(10)"
_WHOLE = r"regexp_matches(line, '^<table><tr><td>p\d+</td><td>2</td></tr>\n<tr><td>1</td><td>\$x\$</td></tr></table>$')"


def rendered(source: str = "lines", md: bool = False) -> str:
    """chapters(book_id, chapter_no, title, md) and their lines r0."""
    as_md = f"when role = 'content' and {_WHOLE} then {_TABLE_MD}" if md else ""
    return tree(2, source) + rf""",
r0 as (select book_id, chapter_no, o, case {as_md} when role = 'content' and starts_with(line, '<table') then chr(10) || replace(line, '><', '>' || chr(10) || '<') || chr(10)
  when role = 'content' then replace(replace(replace(regexp_replace({_math('line')}, '(?i)</?del>', '', 'g'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')
  when role = 'board' then chr(10) || '## [板块] ' || h.title || chr(10) else chr(10) || repeat('#', greatest(level, 1)) || ' ' || h.title || chr(10) end as md, case when role = 'chapter' then h.title end as title
  from marked where role in ('chapter', 'board', 'sub', 'content')),
chapters as (select book_id, chapter_no::bigint as chapter_no, max(title) as title, regexp_replace(string_agg(md, chr(10) order by o), '\n{{3,}}', chr(10) || chr(10), 'g') as md from r0 group by book_id, chapter_no)"""


RENDERED = rendered()

DIRS = BOOKS + """,
disk as (select case when id % 2 = 0 then 'md' else 'build' end as kind, 'b' || id || '_' || case when id % 7 = 0 then 'renamed' else title end as name from books where id % 4 <> 0),
cat as (select 'b' || id || '_' || title as name from books where id % 3 <> 0)"""

_DIGITS = "一二三四五六七八九"

SQL = {
    "p1_fold_tables": f"with {BODY}, {fold('body')} select * from folded",
    "p2_toc_lines": f"with {LINES} select book_id, ln, line from lines where {toc(strip('line'))}",
    "p3_toc_titles": f"with {LINES} select book_id, ln, {page_cut('line')} as body, {toc_title('line')} as title from lines where {toc(strip('line'))}",
    "p4_headings": f"with {LINES}, a as (select book_id, ln, {heading(bare('line'), 'line')} as h from lines) select book_id, ln, h.level::bigint as level, h.title as title, h.board as board, h.kind as kind from a where h is not null",
    "p5_norm_titles": f"with {LINES} select book_id, ln, {norm(chr(39) + '（' + chr(39) + ' || line || ' + chr(39) + '）：$ ' + chr(92) + '—，“' + chr(39))} as title from lines",
    "p9_math_tables": f"with {GRADED} select k from graded where is_math",
    "p10_table_gates": f"with {GRADED} select gate, count(*) as n from graded group by gate",
    "p11_max_cell": f"with {GRADED} select k, max_cell::bigint as max_cell from graded",
    "p13_status_filters": f"with {BOOKS} select case when parse_status in ('pending', 'failed') then 'actionable' when parse_status in ('parsed', 'structure_ok') then 'ready' else 'busy' end as side, count(*) as n, min(id) as first_id from books group by 1",
    "p16_progress": f"with {BOOKS} select id, coalesce(floor(try_cast(split_part(parse_progress, '/', 1) as double) * 100 / nullif(try_cast(split_part(parse_progress, '/', 2) as double), 0) + 0.5), 0)::bigint as percent from books",
    "f1_numerals": f"""with a as (select doc_id, len(string_split(text, ' '))::bigint as n, [{', '.join(repr(x) for x in _DIGITS)}] as z from documents)
select doc_id, case n % 4 when 0 then n::varchar when 1 then z[n % 9 + 1] when 2 then z[n % 9 + 1] || '十' || z[(n + 3) % 9 + 1] else z[n % 9 + 1] || '百' || z[(n + 1) % 9 + 1] || '十' || z[(n + 2) % 9 + 1] end as numeral,
(case n % 4 when 0 then n when 1 then n % 9 + 1 when 2 then (n % 9 + 1) * 10 + (n + 3) % 9 + 1 else (n % 9 + 1) * 100 + ((n + 1) % 9 + 1) * 10 + (n + 2) % 9 + 1 end)::bigint as n from a""",
    "f2_clean_markdown": r"""with a as (select doc_id, '<del>x</DEL>&amp;lt; &quot;' || text || repeat(chr(10), 4) || '&amp;&middot;&copy;' as t from documents),
b as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&gt;', '>'), '&lt;', '<'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') as t from a)
select doc_id, regexp_replace(regexp_replace(replace(replace(replace(t, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '(?i)</?del>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from b""",
    "f2_unescape_pages": "select page_id, md5(replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) as md5 from pages",
    "f3_html_images": """select doc_id, 'a ![](images/' || doc_id || '.png) b ![](images/q.gif) c <img src="https://h/x.png">' as t from documents""",
    "f4_normalize_math": r"""select doc_id, '$x' || doc_id || '$ $y$ $$' || chr(10) || 'z' || chr(10) || '$$ (q) ' || replace(replace(replace(text, '$', ''), '\(', '('), '\)', ')') as t from documents""",
    "f5_break_tables": f"with {TABLES} select k, md5(replace(html, '><', '>' || chr(10) || '<')) as md5 from tables",
    "f6_table_markdown": f"""with {GRADED}, r as (select k, list_transform({_ROWS}, lambda r: '| ' || array_to_string(regexp_extract_all(r, '<td>(.*?)</td>', 1), ' | ') || ' |') as r from graded where gate = 'ok')
select k, chr(10) || r[1] || chr(10) || '| --- | --- |' || chr(10) || array_to_string(r[2:], chr(10)) || chr(10) as md from r""",
    "f7_escape_pipes": r"""with a as (select doc_id, 'a|b $P(A|B)$ | ' || text || ' $c|d$' as t from documents)
select doc_id, array_to_string(list_transform(regexp_extract_all(t, '(?s)\$[^$]*\$|[^$]+|\$'), lambda x: case when length(x) > 2 and starts_with(x, '$') then replace(x, '|', '\vert ') else replace(x, '|', '\|') end), '') as t from a""",
    "f8_image_refs": f"with {LINES}, {REFS.replace('from body', 'from lines')} select book_id, ln, rel from refs union all select book_id, ln, 'images/h' || ln || '.png' from lines",
    "f9_file_names": r"""select doc_id, rtrim(ltrim(regexp_replace(' .a:b*' || text || '|c?. ', '[<>:"/\\|?*]', '_', 'g'), ' .'), ' .') as file, doc_id || '_a.b' as stem, doc_id || '_a.b.pdf' as title from documents""",
    "f11_heading_markdown": f"with {LINES}, a as (select book_id, ln, {heading(bare('line'), 'line')} as h from lines) select book_id, ln, case when h.board then '## [板块] ' || h.title else repeat('#', least(greatest(h.level, 1), 6)::int) || ' ' || h.title end as md from a where h is not null",
    "f12_object_urls": f"with {LINES} select book_id, ln, 'B%20~%2A' || replace(url_encode(line), '%2F', '/') || '/images/a%2Bb.PNG' as url, 'image/png' as mime from lines",
    "f13_line_md5": f"with {LINES} select book_id, ln, md5(line) as md5 from lines",
    "f14_session_tokens": "select doc_id, 'web_' || left(sha256(doc_id || 'salt'), 48) as token from documents",
    "f16_display_math": r"""select doc_id, regexp_replace('a$$x$$' || text || 'b $$y$$', '\$\$([^$\n]+)\$\$', chr(10) || '$$' || chr(10) || '\1' || chr(10) || '$$' || chr(10), 'g') as t from documents""",
    "f17_dollar_parity": r"""with a as (select doc_id, replace(text, '\$', '') as t from documents) select doc_id, (length(t) - length(replace(t, '$', '')))::bigint as n, (length(t) - length(replace(t, '$', ''))) % 2 = 1 as open from a""",
    "f18_md_columns": rf"""with {LINES}, a as (select book_id, ln, trim(trim(replace('| a\|b |' || line || '|', '\|', chr(1))), '|') as t from lines) select book_id, ln, (length(t) - length(replace(t, '|', '')) + 1)::bigint as n from a""",
    "f19_json": "select event_id, array_to_string(list_sort(json_keys(props)), ',') as keys, len(json_keys(props))::bigint as n from events",
    "f21_plan_batches": f"with {BOOKS}, a as (select id, page_count, case when id % 2 = 0 then 25 else 20 end as size from books), b as (select *, unnest(range(1, page_count + 1, size)) as page_start from a) select id, (page_start // size + 1)::bigint as batch_idx, page_start::bigint as page_start, least(page_start + size - 1, page_count)::bigint as page_end from b",
    "f22_dir_names": f"with {BOOKS} select id, 'b' || id || '_' || title as name, 'b' || id as prefix, null::varchar as \"none\" from books",
    "src3_catalog_scan": f"with {BOOKS} select id, title, page_count::bigint as page_count, parse_status from books",
    "src7_quota_ledger": """with e as (select ts::date::varchar as day, floor(value)::bigint as pages, user_id as book from events where value is not null),
f as (select day, count(*) as n from (select book, min(day) as day from e group by book) group by day)
select e.day, sum(pages)::bigint as pages_used, coalesce(any_value(n), 0)::bigint as files_used, greatest(100000 - sum(pages), 0)::bigint as pages_left, greatest(50 - coalesce(any_value(n), 0), 0)::bigint as files_left from e left join f using (day) group by e.day""",
    "snk3_raw_export": f"with {BODY}, {batches('body')}, a as (select book_id, string_agg(chr(10) || '<!-- batch ' || batch_idx || ': p' || page_start || '-' || page_end || ' -->' || chr(10) || chr(10) || text, chr(10) order by batch_idx) as md from batches group by book_id) select book_id, md5(md) as md5, length(md)::bigint as n from a",
    "snk7_upload_plan": f"with {BODY}, {FILES}, {REFS} select distinct r.book_id, r.rel, case when f.rel is null then 'failed' when r.book_id % 3 = 0 then 'skip' else 'upload' end as action from refs r left join files f using (book_id, rel)",
    "snk10_cascade_delete": f"with {BODY}, {FILES} select book_id, count(*) as n, sum(bytes)::bigint as bytes from files where book_id not in (select o_orderkey from orders where o_orderkey % 5 = 4) group by book_id",
    "snk12_catalog_log": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
    "c15_recover_stale": f"with {BOOKS} select case when parse_status = 'parsing' then 'pending' else parse_status end as parse_status, count(*) as n from books group by 1",
    "a1_toc_ratios": f"with {LINES}, {fold('lines')} select book_id, batch_idx::bigint as batch_idx, round(avg({toc(strip('line'))}::int), 6) as ratio from folded group by book_id, batch_idx",
    "a2_chapter_style": f"{TREE} select distinct book_id, numbered, hashed, case when numbered > 0 then 'numbered' when hashed >= 3 then 'hash' else 'numbered' end as style from x3",
    "c1_toc_title_sets": f"{TREE} select book_id, unnest(titles) as title from titles",
    "c2_toc_entries": f"{TREE} select book_id, pos, no::bigint as no, title, page::bigint as page from en",
    "j3_headings_in_contents": f"{TREE}, q as (select book_id, ln, {heading(bare('line'), 'line')} as h from lines) select q.book_id, ln, h.title as title from q join titles using (book_id) where h is not null and not h.board and list_contains(titles, {norm(unnumbered('h.title'))})",
    "c3_rebuild": f"{TREE} {NODES}",
    "c4_rebuild_flat": f"{tree(1)} {NODES}",
    "a7_structures": f"""{TREE} select b.book_id, 'p' || greatest((min(batch_idx) - 1) * 25 + 1, 0) || '-' || (max(batch_idx) * 25) as pages_covered, coalesce(any_value(c), 0)::bigint as chapter_count, coalesce(any_value(f), 0)::bigint as pre_matter_chars, coalesce(any_value(j), 0)::bigint as n_warnings
from lines b left join (select book_id, count(*) filter (where role = 'chapter') as c, sum(length(line)) filter (where role = 'front') as f from marked group by book_id) m on b.book_id = m.book_id
left join (select n.book_id, count(*) as j from nodes n join nodes p on n.book_id = p.book_id and n.parent_id = p.node_id where not n.board and n.level - p.level > 1 group by n.book_id) w on w.book_id = b.book_id group by b.book_id""",
    "a8_pages_covered": f"with {LINES} select book_id, 'p' || greatest((min(batch_idx) - 1) * 25 + 1, 0) || '-' || (max(batch_idx) * 25) as pages_covered from lines group by book_id",
    "a9_continuity": f"{TREE}, {SECTIONS} select book_id, chapter_no, warning from cont",
    "a11_outline_totals": f"{TREE}, {DEAD} select book_id, sum(char_count)::bigint as chars, sum(image_count)::bigint as images, sum(table_count)::bigint as tables from nodes where (book_id, node_id) not in (select (book_id, node_id) from dead) group by book_id",
    "c5_outlines": f"""{TREE}, {DEAD} select book_id, string_agg(case when level = 1 then '- **' || title || '**（' || page_range || '，' || char_count || '字，图' || image_count || ' 表' || table_count || '）' else repeat('  ', (level - 1)::int) || '- ' || title || '（' || page_range || '，' || char_count || '字）' end, chr(10) order by node_id) as outline from nodes where (book_id, node_id) not in (select (book_id, node_id) from dead) group by book_id""",
    "p14_chapter_titles": f"{TREE} select book_id, chapter_no, title from nodes where level = 1",
    "a4_table_stats": f"""with {GRADED} select k % 10 as g, count(*) filter (where gate = 'ok') as converted, count(*) filter (where gate <> 'ok') as kept, count(*) filter (where is_math) as math_total, count(*) filter (where is_math and gate = 'ok') as math_converted,
count(*) filter (where is_math and gate <> 'ok') as math_kept, count(*) filter (where is_math and gate <> 'ok' and regexp_matches(html, '(?i)colspan|rowspan')) as math_kept_merged, count(*) filter (where is_math and gate <> 'ok' and max_cell > 300) as math_kept_cell_too_long from graded group by 1""",
    "a4_kept_reasons": f"with {GRADED}, a as (select k % 10 as g, gate, count(*) as n from graded where gate <> 'ok' group by 1, 2) select g, string_agg(gate || '=' || n, ';' order by gate) as reasons from a group by g",
    "a5_image_stats": f"with {BODY}, {FILES}, {REFS} select book_id, count(*) as referenced, count(distinct case when f.rel is null then r.rel end) as missing from refs r left join files f using (book_id, rel) group by book_id",
    "a6_report": f"""{TREE}, t as (select book_id, chapter_no::bigint as chapter_no, count(*) as converted, count(*) filter (where (length(line) - length(replace(line, '$', ''))) >= 2) as math_total from marked where role = 'content' and starts_with(line, '<table')
  and {_COUNT('line', '<table')} = {_COUNT('line', '</table>')} group by 1, 2),
t2 as (select book_id, chapter_no::bigint as chapter_no, count(*) as kept from marked where role = 'content' and starts_with(line, '<table') and {_COUNT('line', '<table')} <> {_COUNT('line', '</table>')} group by 1, 2),
c as (select book_id, chapter_no, sum(char_count) as chars, sum(image_count) as images from nodes group by 1, 2)
select book_id, chapter_no, grouping(book_id, chapter_no)::bigint as depth, sum(chars)::bigint as chars, sum(images)::bigint as images, sum(coalesce(converted, 0))::bigint as converted, sum(coalesce(kept, 0))::bigint as kept, sum(coalesce(math_total, 0))::bigint as math_total
from c left join t using (book_id, chapter_no) left join t2 using (book_id, chapter_no) group by rollup (book_id, chapter_no)""",
    "a10_table_audit": f"with {GRADED}, a as (select count(*) as total, count(*) filter (where gate = 'ok') as converted, count(*) filter (where gate <> 'ok') as kept, count(*) filter (where is_math) as math_total, count(*) filter (where is_math and gate = 'ok') as mc from graded) select total, converted, kept, math_total, round(converted / total, 4) as converted_ratio, round(math_total / total, 4) as math_ratio, round(mc / math_total, 4) as math_converted_ratio from a",
    "a13_orphan_bytes": f"with {BODY}, {FILES}, {REFS} select book_id % 5 as g, count(*) as n, sum(bytes)::bigint as bytes from files f anti join refs r using (book_id, rel) group by 1",
    "a15_quota_admission": "with f as (select user_id as book, min({'day': ts::date::varchar, 'ts': ts}) as f from events group by 1), n as (select f.day as day, book, row_number() over (partition by f.day order by f.ts, book) as n from f) select day, book, n from n where n <= 20",
    "a17_error_summary": f"with {BOOKS}, e as (select id % 200 as book_id, list(parse_error order by id) as e from books where parse_error is not null group by 1) select book_id, array_to_string(e[1:5], '；') || case when len(e) > 5 then '；共 ' || len(e) || ' 个' else '' end as summary, len(e)::bigint as n from e",
    "w15_parse_progress": f"with {BOOKS}, b as (select id, (page_count + 24) // 25 as n, unnest(range(1, (page_count + 24) // 25 + 1)) as i from books) select id, i || '/' || n as progress from b",
    "j1_overlapping_batches": f"with {BODY}, {batches('body')}, s as (select book_id, batch_idx * 2 - 1 as chapter_no, page_start - 5 as lo, page_start + 30 as hi from batches) select s.book_id, chapter_no::bigint as chapter_no, count(*) as n, sum(length(text))::bigint as chars from s join batches b on s.book_id = b.book_id and b.page_start <= hi and b.page_end >= lo group by 1, 2",
    "j2_until_next_chapter": f"with {BODY}, {batches('body')}, s as (select book_id, batch_idx * 2 - 1 as chapter_no, page_start - 5 as lo, lead(page_start - 5) over (partition by book_id order by batch_idx) as nlo from batches) select s.book_id, chapter_no::bigint as chapter_no, count(*) as n, sum(length(text))::bigint as chars from s join batches b on s.book_id = b.book_id and b.page_end >= lo and (nlo is null or b.page_start < nlo) group by 1, 2",
    "j5_missing_images": f"with {BODY}, {FILES}, {REFS} select distinct book_id, rel from refs anti join files using (book_id, rel)",
    "j6_orphan_images": f"with {BODY}, {FILES}, {REFS} select book_id, rel from files anti join refs using (book_id, rel)",
    "j7_orphan_dirs": f"with {DIRS} select kind, name from disk where regexp_extract(name, '^(b\\d+)_', 1) not in (select regexp_extract(name, '^(b\\d+)_', 1) from cat)",
    "u3_missing_dirs": f"with {DIRS} select kind, c.name from cat c, (select unnest(['build', 'md']) as kind) k where not exists (select 1 from disk d where d.kind = k.kind and d.name = c.name)",
    "j8_golden": f"""{TREE}, c as (select book_id, list(title order by node_id) as t from nodes where level = 1 group by 1) select case when book_id % 10 = 0 then 'new' when book_id % 9 = 0 then 'count' when book_id % 8 = 0 then 'titles' else 'ok' end as verdict, count(*) as n from c group by 1""",
    "j9_vault_folders": f"with {DIRS} select title || ' notes' as dir, min(name) as name from books join cat on contains(title || ' notes', regexp_replace(name, '^[^_]*_', '')) where id % 5 = 0 group by 1",
    "j10_link_rewrite": f"""with {BODY}, {FILES}, known as (select book_id, list(distinct rel) as rels from files group by book_id)
select book_id, ln, list_reduce(list_prepend(line, coalesce(rels, [])), lambda acc, r: replace(acc, '(' || r || ')', '(https://cdn/' || r || ')')) as line from body left join known using (book_id)""",
    "j11_incomplete_batches": f"with {BODY}, {FILES}, {REFS} select book_id, batch_idx::bigint as batch_idx, count(distinct rel) as missing from refs anti join files using (book_id, rel) group by 1, 2",
    "c10_lint": f"with {LINT}, {FILES}, lr as (select book_id, i, unnest(regexp_extract_all(s, '!\\[[^\\]]*\\]\\((images/[^)\\s]+)\\)', 1)) as rel from l6 where free), al as (select * from issues union all select book_id, 'missing_image', i from lr anti join files using (book_id, rel)) select book_id, rule, case when rule = 'html_table_ragged' then 'warning' else 'error' end as severity, line::bigint as line from al",
    "a12_lint_counts": f"with {LINT} select rule, case when rule = 'html_table_ragged' then 'warning' else 'error' end as severity, count(*) as n from issues group by 1, 2",
    "c11_vault_health": rf"""with {MD} select book_id, len(list_filter(regexp_extract_all(md, '!\[[^\]]*\]\(([^)]+)\)', 1), lambda u: not regexp_matches(u, '^https?://')))::bigint as image_non_remote,
len(regexp_extract_all(md, '(?i)</?(table|div|span|p|br|img|tr|td|th)[^>]*>'))::bigint as html_tag, len(regexp_extract_all(md, '&[a-z]+;|&#\d+;'))::bigint as html_entity, len(regexp_extract_all(md, '\\\(|\\\)'))::bigint as bad_math, len(regexp_extract_all(md, '\n{{3,}}'))::bigint as blank_run from md""",
    "c6_rebuilt_chapters": f"{RENDERED} select book_id, chapter_no, title, length(md)::bigint as n, md5(md) as md5 from chapters",
    "c6_rebuilt_chapters_md": f"{rendered(md=True)} select book_id, chapter_no, title, length(md)::bigint as n, md5(md) as md5 from chapters",
    "snk2_rebuilt_books": rf"""{rendered(md=True)}, b as (select book_id, string_agg(md, chr(10) order by o) as body from r0 group by book_id),
p as (select book_id, 'p' || greatest((min(batch_idx) - 1) * 25 + 1, 0) || '-' || (max(batch_idx) * 25) as pages from lines group by book_id),
w as (select book_id, regexp_replace('# 《B' || book_id || '》' || chr(10) || chr(10) || '> structure export (' || pages || ')' || chr(10) || coalesce(chr(10) || body, ''), '\n{{3,}}', chr(10) || chr(10), 'g') as md from p left join b using (book_id))
select book_id, length(md)::bigint as n, md5(md) as md5 from w""",
    "snk6_fallback": f"""{rendered('body')}, {batches('body')}, a as (select title, md from chapters
  union all select '全文', string_agg(chr(10) || '<!-- batch ' || batch_idx || ': p' || page_start || '-' || page_end || ' -->' || chr(10) || chr(10) || text, chr(10) order by batch_idx) from batches where book_id not in (select book_id from chapters) group by book_id)
select title, count(*) as n, sum(length(md))::bigint as chars from a group by title""",
    "c8_diff_totals": f"with {BODY} select book_id, count(*) as left_lines, count(*) filter (where ln % 6 <> 0) as right_lines from body group by book_id",
    "snk5_vault_files": rf"""{RENDERED}, v as (select *, rtrim(ltrim(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), ' .'), ' .') as f, 'B' || book_id as b, case when chapter_no < 10 then '0' else '' end || chapter_no as c from chapters)
select book_id, b || '/' || c || '_' || f || '/' || f || '.md' as path, md5(md) as md5 from v union all select book_id, any_value(b) || '/00_总览.md', md5(string_agg('- [[' || c || '_' || f || '/' || f || ']]', chr(10) order by chapter_no)) from v group by book_id""",
    "s5_retention": f"with {BODY}, {FILES} select bytes, count(*) as n from (select bytes, row_number() over (order by bytes desc, book_id, rel) as k from files) where k > 3 group by bytes",
    "s6_head_of_each": f"with {BODY}, {FILES} select book_id, rel from (select *, row_number() over (partition by book_id order by rel) as k from files) where k <= 2",
    "u1_union_of_titles": f"{TREE} select unnest(titles) as title from titles union select {norm(bare('line'))} from lines where ({heading(bare('line'), 'line')}) is not null",
    "u5_all_warnings": f"""{TREE}, {SECTIONS} select book_id, warning from cont union all select n.book_id, n.title || ': 层级跳变（' || p.level || ' -> ' || n.level || '）' from nodes n join nodes p on n.book_id = p.book_id and n.parent_id = p.node_id where not n.board and n.level - p.level > 1""",
}

_VAULT = rf"""v as (select *, rtrim(ltrim(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), ' .'), ' .') as f, 'B' || book_id as b, case when chapter_no < 10 then '0' else '' end || chapter_no as c from chapters),
vf as (select book_id, f || '.md' as name, md as content from v union all select book_id, '00_总览.md', string_agg('- [[' || c || '_' || f || '/' || f || ']]', chr(10) order by chapter_no) from v group by book_id)"""
_VAULT_REPORTS = rf"""{RENDERED}, {_VAULT}, vr as (select book_id, sum(len(list_filter(regexp_extract_all(content, '!\[[^\]]*\]\(([^)]+)\)', 1), lambda u: not regexp_matches(u, '^https?://'))))::bigint as image_non_remote,
sum(len(regexp_extract_all(content, '(?i)</?(table|div|span|p|br|img|tr|td|th)[^>]*>')))::bigint as html_tag, sum(len(regexp_extract_all(content, '&[a-z]+;|&#\d+;')))::bigint as html_entity, sum(len(regexp_extract_all(content, '\\\(|\\\)')))::bigint as bad_math,
sum(len(regexp_extract_all(content, '\n{{3,}}')))::bigint as blank_run, count(*) filter (where not starts_with(name, '00_') and not starts_with(name, '第'))::bigint as orphan_md, true as moc_ok from vf group by book_id)"""
_USAGE = """with e as (select ts::date::varchar as day, floor(value)::bigint as pages, user_id as book from events where value is not null),
f as (select day, count(*) as n from (select book, min(day) as day from e group by book) group by day),
u as (select e.day, sum(pages)::bigint as pages, coalesce(any_value(n), 0)::bigint as files from e left join f using (day) group by e.day)"""
_LINES_OF = lambda x: f"coalesce(list_transform({x}, lambda w: '- ' || w), [])"

SQL["f15_page_start"] = rf"{TREE} select book_id, node_id, coalesce(try_cast(regexp_extract(page_range, 'p(\d+)', 1) as bigint), 1) as page, coalesce(try_cast(regexp_extract(title, 'p(\d+)', 1) as bigint), 1) as none from nodes"
SQL |= {
    "a14_vault_reports": f"{_VAULT_REPORTS} select * from vr",
    "a14_vault_summary": f"{_VAULT_REPORTS}, t as (select count(*) as books, sum(image_non_remote + html_tag + html_entity + bad_math + blank_run + orphan_md)::bigint as issues from vr) select books, issues, issues = 0 as healthy from t",
    "a16_quota_status": f"{_USAGE} select 1000::bigint as daily_priority_pages, pages as priority_used, greatest(1000 - pages, 0)::bigint as priority_remaining, pages >= 1000 as priority_exhausted, 5000::bigint as daily_file_limit, files as files_used, greatest(5000 - files, 0)::bigint as files_remaining, day as date, true as has_api_key, 1000::bigint as daily_limit, pages as used, greatest(1000 - pages, 0)::bigint as remaining from u",
    "src7_quota_today": f"{_USAGE} select day, pages, case when day(day::date) % 2 = 0 then 0 else files end::bigint as files from u union all select '1999-01-01', 0, 0",
    "p12_guards": f"with {BOOKS}, r as (select event_id, event_id * 3 as book_id, case when event_id % 5 = 0 then 'pdf' when event_id % 2 = 0 then 'html' else 'md' end as mode from events) select case when id is null then 404 when mode = 'pdf' then 400 when parse_status not in ('parsed', 'structure_ok') then 409 else 200 end as code, count(*) as n, min(event_id) as first_id from r left join books on book_id = id group by 1",
    "c16_operations": f"with {BOOKS} select id, unnest([1, 2, 3])::bigint as step, unnest(['rebuild', 'export', 'import']) as command, unnest(['build/b' || id || '_' || title, 'export/' || title || '.md', 'vault/' || title]) as target from books",
    "c12_cleanup_plan": f"with {BODY}, {FILES}, {REFS}, {DIRS.strip()} select 'delete_dir' as action, kind, name, 0::bigint as bytes from disk where regexp_extract(name, '^(b\\d+)_', 1) not in (select regexp_extract(name, '^(b\\d+)_', 1) from cat) union all select 'missing_dir', kind, c.name, 0 from cat c, (select unnest(['build', 'md']) as kind) k where not exists (select 1 from disk d where d.kind = k.kind and d.name = c.name) union all select 'delete_image', 'md', 'b' || book_id || '/' || rel, bytes from files anti join refs using (book_id, rel)",
    "snk12_replayed_log": """with l as (select user_id, event_id as seq, case when event_id % 7 = 3 then 'delete' when event_id % 7 < 2 then 'insert' else 'update' end as op, case when event_id % 2 = 0 then event_type end as status, case when event_id % 5 = 0 then event_id end as added from events),
d as (select user_id, max(seq) filter (where op = 'delete') as gone from l group by user_id), a as (select l.* from l join d using (user_id) where gone is null or seq > gone), i as (select user_id, min(seq) as begun from a where op = 'insert' group by user_id)
select user_id, max_by(status, seq) filter (where status is not null) as status, max_by(added, seq) filter (where added is not null) as added from a join i using (user_id) where seq >= begun group by user_id""",
    "snk11_stale_diffs": f"with {BODY} select book_id, count(*) as raw_lines, count(*) filter (where ln % 6 <> 0) as rebuilt_lines, book_id % 5 <> 0 and (book_id % 7 <> 0 or count(*) filter (where ln % 6 <> 0) = 0) as cached from body group by book_id",
    "w14_first_seen_refs": rf"""with {BODY}, r as (select book_id, ln, unnest(regexp_extract_all(line || ' ![](images/logo.png)', '!\[[^\]]*\]\((images/[^)\s]+)\)', 1)) as rel from body) select book_id, rel, min(ln) as ln from r group by 1, 2""",
    "f19_json_kept": f"""with {BOOKS} select id, '{{"id":' || id || ',"title":"《题》' || title || '"}}' as json from books""",
    "snk1_written_trees": f"{TREE} {NODES}",
    "snk8_replaced_trees": f"{TREE} select book_id, node_id, case when book_id % 3 = 0 then '* ' || title else title end as title from nodes where book_id % 3 <> 0 or level = 1",
    "snk4_bundles": f"with {BODY}, {FILES}, {REFS} select book_id, 'book.md' as path, md5(string_agg(line, chr(10) order by ln)) as md5 from body group by book_id union all select distinct book_id, rel, md5(rel) from refs join files using (book_id, rel)",
    "c5_outline_reports": rf"""{TREE}, {DEAD}, {SECTIONS}, live as (select * from nodes where (book_id, node_id) not in (select (book_id, node_id) from dead)),
o as (select book_id, list(case when level = 1 then '- **' || title || '**（' || page_range || '，' || char_count || '字，图' || image_count || ' 表' || table_count || '）' else repeat('  ', (level - 1)::int) || '- ' || title || '（' || page_range || '，' || char_count || '字）' end order by node_id) as tree,
  sum(char_count) as chars, sum(image_count) as images, sum(table_count) as tables from live group by book_id),
w as (select n.book_id, list(n.title || ': 层级跳变（' || p.level || ' -> ' || n.level || '）' order by n.node_id) as jumps from nodes n join nodes p on n.book_id = p.book_id and n.parent_id = p.node_id where not n.board and n.level - p.level > 1 group by n.book_id),
g as (select book_id, list(warning order by chapter_no) as gaps from cont group by book_id), b as (select book_id, list(title order by node_id) as boards from nodes where board group by book_id),
f as (select book_id, count(*) filter (where role = 'chapter') as chapters, coalesce(sum(length(line)) filter (where role = 'front'), 0) as front from marked group by book_id),
p as (select book_id, 'p' || greatest((min(batch_idx) - 1) * 25 + 1, 0) || '-' || (max(batch_idx) * 25) as pages from lines group by book_id),
a as (select p.book_id, ['# 《B' || p.book_id || '》结构大纲（P0-2 真树化重建）', '', '- 覆盖页数：' || pages, '- 章节数：' || coalesce(chapters, 0), '- 前置部分字符（已丢弃）：' || coalesce(front, 0), '- 孤儿标题（无法归入章节）：0', '', '## 章节树', ''] as head, coalesce(tree, []) as tree,
  ['', '## 统计', '', '- 正文字符总数：' || coalesce(chars, 0), '- 图片总数：' || coalesce(images, 0), '- 表格总数：' || coalesce(tables, 0)] as sums, list_concat({_LINES_OF('jumps')}, {_LINES_OF('gaps')}) as warns, {_LINES_OF('boards')} as boards
  from p left join o using (book_id) left join w using (book_id) left join g using (book_id) left join b using (book_id) left join f using (book_id)),
r as (select book_id, array_to_string(list_concat(head, list_concat(tree, list_concat(sums, list_concat(case when len(warns) > 0 then list_concat(['', '## ⚠ 质检警告', ''], warns) else [] end, case when len(boards) > 0 then list_concat(['', '## 特殊板块（不入大纲，保留文本）'], boards) else [] end)))), chr(10)) as report from a)
select book_id, length(report)::bigint as n, md5(report) as md5 from r""",
}
