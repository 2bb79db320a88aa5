"""Queries of files, documents, page ranges and links, each with the SQL of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import oracle
from quire.functions import text as T
from quire.operators import documents, evolving, incremental, intervals, links, segments, structure
from quire.plans import render
from quire.queries import LONG, TREE, _flat, _marked
from quire.sources import adapters as A
from quire.sources import files, tree

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- links ------------------------------------------------------------------------------------

_LINKED = oracle.BODY + r""",
linked as (select book_id, ln, line || case when ln % 7 = 3 then ' ![a](images/' || book_id || '_' || ((ln - 1) // 12 * 12 + 10) || '.jpg) <img class="c" src="images/' || book_id || '_' || ((ln - 1) // 12 * 12 + 10) || '.jpg"> [see](images/' || book_id || '_' || ((ln - 1) // 12 * 12 + 10) || '.jpg) ![](images/none.jpg)' else '' end as line from body)"""


def fx_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of which some refer to images several times, in all syntaxes, also to absent ones."""
    lines = A.fx_lines(spark, sf, toc=False).select("book_id", "ln", "line")
    rel = F.concat(F.lit("images/"), F.col("book_id").cast("string"), F.lit("_"), (F.floor((F.col("ln") - 1) / 12) * 12 + 10).cast("string"), F.lit(".jpg"))
    more = F.concat(F.lit(" ![a]("), rel, F.lit(') <img class="c" src="'), rel, F.lit('"> [see]('), rel, F.lit(") ![](images/none.jpg)"))
    return lines.withColumn("line", F.when(F.col("ln") % 7 == 3, F.concat("line", more)).otherwise(F.col("line")))


@query(
    f"""with {_LINKED}, {oracle.FILES}, known as (select book_id, list(distinct rel) as rels from files group by book_id)
select book_id, ln, list_reduce(list_prepend(line, coalesce(rels, [])), lambda acc, r: replace(replace(acc, '(' || r || ')', '(https://cdn/' || r || ')'), 'src="' || r || '"', 'src="https://cdn/' || r || '"')) as line
from linked left join known using (book_id)"""
)
def j10_links_in_lines(spark, sf):
    urls = A.fx_image_files(spark, sf).select("book_id", "rel", F.concat(F.lit("https://cdn/"), T.quote_key(F.col("rel"))).alias("url"))
    return links.rewritten(fx_linked(spark, sf), urls)


# --- page ranges ------------------------------------------------------------------------------

_PAGES = rf"""{oracle.TREE}, {oracle.batches('lines')},
ch as (select book_id, chapter_no, try_cast(regexp_extract(page_range, '^p(\d+)-(\d+)', 1) as int) as lo, try_cast(regexp_extract(page_range, '^p(\d+)-(\d+)', 2) as int) as hi from nodes where level = 1)"""
_RAW = "count(*) as n, md5(string_agg(text, chr(10) order by page_start, batch_idx)) as md5, sum(length(text))::bigint as chars"


def _chapters(spark, sf):
    b = A.fx_batches(spark, sf)
    return intervals.chapter_pages(structure.nodes(structure.marked_lines(b))), b


def _raw(pairs):
    out = intervals.joined_text(pairs, "book_id", "chapter_no")
    return out.select("book_id", "chapter_no", "n", F.md5("text").alias("md5"), (F.length("text") - F.col("n") + 1).cast(LONG).alias("chars"))


@query(f"{_PAGES} select ch.book_id, chapter_no, {_RAW} from ch join batches b on ch.book_id = b.book_id and b.page_start <= hi and b.page_end >= lo group by 1, 2")
def j1_chapter_raw_texts(spark, sf):
    """Each chapter's batches by its page range."""
    chapters, batches = _chapters(spark, sf)
    return _raw(intervals.overlapping(chapters, batches, "book_id", ("lo", "hi"), ("page_start", "page_end")))


@query(
    f"""{_PAGES}, nx as (select *, lead(lo) over (partition by book_id order by chapter_no) as nlo from ch)
select nx.book_id, chapter_no, {_RAW} from nx join batches b on nx.book_id = b.book_id and b.page_end >= lo and (nlo is null or b.page_start < nlo) group by 1, 2"""
)
def j2_chapter_raw_texts(spark, sf):
    """Each chapter's batches up to the page where the next chapter begins."""
    chapters, batches = _chapters(spark, sf)
    return _raw(intervals.until_next(chapters, batches, "book_id", "chapter_no", "lo", ("page_start", "page_end")))


# --- files of exact names ---------------------------------------------------------------------


def _vault(spark, sf):
    chapters = files.staged(render.chapters_md(render.rendered_lines(_marked(spark, sf))))
    return render.vault_files(chapters)


def _listed(back):
    return back.select("path", "length", F.md5("content").alias("md5"))


_SAFE = r"""rtrim(ltrim(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), ' .'), ' .')"""
_VAULT = rf"""v as (select *, {_SAFE} as f, 'B' || book_id as b, case when chapter_no < 10 then '0' else '' end || chapter_no as c from chapters),
vf as (select b || '/' || c || '_' || f || '/' || f || '.md' as path, md as content from v union all
  select b || '/00_总览.md', string_agg('- [[' || c || '_' || f || '/' || f || ']]', chr(10) order by chapter_no) from v group by b)"""
_FILES_OF = "path, octet_length(content::blob)::bigint as length, md5(content) as md5"


@query(f"{oracle.RENDERED}, {_VAULT} select {_FILES_OF.replace('content::blob', 'encode(content)')} from vf")
def snk5_vault_on_disk(spark, sf):
    """Chapter files and overviews, written under their names and listed again."""
    root = files.work_dir(spark)
    tree.write_files(_vault(spark, sf).select("path", "content"), root)
    return _listed(tree.read_files(spark, root))


@query(
    f"""{oracle.RENDERED}, {_VAULT}, again as (select b || '/01_全文/全文.md' as path, 'x' || book_id as content from v where book_id % 4 = 0 group by 1, 2)
select {_FILES_OF.replace('content::blob', 'encode(content)')} from (select * from again union all select * from vf where split_part(path, '/', 1) not in (select split_part(path, '/', 1) from again))"""
)
def snk8_replaced_vaults(spark, sf):
    """Vault folders of all books, then those of some again with other files: each of these
    folders is replaced as a whole.  Books with a path that leads out of the vault, or into
    the folder of another, are rejected."""
    root = files.work_dir(spark)
    vault = files.staged(_vault(spark, sf))
    tree.write_files(vault.select("path", "content"), root)
    folders = vault.select("book_id", F.substring_index("path", "/", 1).alias("b")).distinct()
    again = folders.where("book_id % 4 = 0").select("book_id", F.concat("b", F.lit("/01_全文/全文.md")).alias("path"), F.concat(F.lit("x"), F.col("book_id").cast("string")).alias("content"))
    bad = folders.where("book_id % 4 = 1").select("book_id", F.concat(F.col("b"), F.lit("/../../etc/x")).alias("path"), F.lit("bad").alias("content"))
    kept, _ = tree.accepted(files.staged(again.unionByName(bad)), "book_id")
    tree.write_files(kept.select("path", "content"), root)
    return _listed(tree.read_files(spark, root))


def _exports(spark, sf):
    b = A.fx_batches(spark, sf)
    books = render.books_md(render.rendered_lines(structure.marked_lines(b), "md"), structure.pages_covered(b))
    name = F.concat(F.lit("B"), F.col("book_id").cast("string"))
    return books.select(F.concat(F.lit("export/"), name, F.lit(".md")).alias("path"), F.col("md").alias("content")).unionByName(render.raw_md(b).select(F.concat(F.lit("raw/"), name, F.lit(".md")).alias("path"), F.col("md").alias("content")))


_EXPORTS = rf"""{oracle.rendered(md=True)}, {oracle.batches('lines')}, b as (select book_id, string_agg(md, chr(10) order by o) as body from r0 group by book_id),
p as (select book_id, 'p' || greatest((min(batch_idx) - 1) * 25 + 1, 0) || '-' || (max(batch_idx) * 25) as pages from lines group by book_id),
ex as (select 'export/B' || p.book_id || '.md' as path, regexp_replace('# 《B' || p.book_id || '》' || chr(10) || chr(10) || '> structure export (' || pages || ')' || chr(10) || coalesce(chr(10) || body, ''), '\n{{3,}}', chr(10) || chr(10), 'g') as content from p left join b using (book_id)
  union all select 'raw/B' || book_id || '.md', string_agg(chr(10) || '<!-- batch ' || batch_idx || ': p' || page_start || '-' || page_end || ' -->' || chr(10) || chr(10) || text, chr(10) order by page_start, batch_idx) from batches group by book_id)"""


@query(f"{_EXPORTS} select {_FILES_OF.replace('content::blob', 'encode(content)')} from ex")
def snk2_exports_on_disk(spark, sf):
    """Whole books, rebuilt and raw, as files; a folder with half of all files is written by
    many tasks."""
    root = files.work_dir(spark)
    tree.write_files(_exports(spark, sf), root)
    return _listed(tree.read_files(spark, root))


# --- batches by file name ---------------------------------------------------------------------


def _batch_files(spark, sf):
    """Files of batches as a parser leaves them, some with a list of contents, some of other names."""
    b = A.fx_batches(spark, sf, toc=False)
    name = F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit("_T/batch_"), F.format_string("%02d", "batch_idx"), F.lit("_p"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    listed = F.concat(F.lit('[{"type":"text","page_idx":'), F.col("page_start").cast("string"), F.lit("}]"))
    md = b.select(F.concat(name, F.lit(".md")).alias("path"), F.col("text").alias("content"))
    lists = b.where("book_id % 3 = 0").select(F.concat(name, F.lit(".json")).alias("path"), F.when(F.col("book_id") % 2 == 0, listed).otherwise("[{").alias("content"))
    notes = b.where("batch_idx = 1").select(F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit("_T/notes.md")).alias("path"), F.lit("no batch").alias("content"))
    return md.unionByName(lists).unionByName(notes)


def _batches_back(spark, sf):
    root = files.work_dir(spark)
    tree.write_files(_batch_files(spark, sf), root)
    return tree.read_batches(spark, root)


def _batch_rows(back):
    entries = F.from_json("content_json", files.CONTENT, {"mode": "PERMISSIVE"})
    return back.select("book", *[F.col(c).cast(LONG).alias(c) for c in ("batch_idx", "page_start", "page_end")], F.md5("text").alias("md5"), F.get(entries, F.lit(0))["page_idx"].cast(LONG).alias("page_idx"))


_BATCH_ROWS = f"with {oracle.BODY}, {oracle.batches('body')} select 'b' || book_id || '_T' as book, batch_idx, page_start, page_end, md5(text) as md5, case when book_id % 6 = 0 then page_start end as page_idx from batches"


@query(_BATCH_ROWS)
def src1_batches_by_file(spark, sf):
    """Batches by the names of their files, with the lists beside them; a list that isn't JSON is null."""
    return _batch_rows(_batches_back(spark, sf))


@query(f"{_BATCH_ROWS} where page_start > 25 and page_end <= 100")
def src1_batches_of_pages(spark, sf):
    """Those of some pages; only their files are opened."""
    return _batch_rows(_batches_back(spark, sf).where("page_start > 25 and page_end <= 100"))


@query(
    f"""{_EXPORTS} select split_part(path, '/', 1) as folder, count(*) as n, sum(octet_length(encode(content)))::bigint as bytes, min(path) as first_path from ex group by 1"""
)
def src4_listed_folders(spark, sf):
    """A folder listing as a table; no file is opened."""
    root = files.work_dir(spark)
    tree.write_files(_exports(spark, sf), root)
    return tree.read_files(spark, root, content=False).groupBy("folder").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("path").alias("first_path"))


@query(f"{oracle.TREE} select 'b' || book_id as name, count(*) as chapter_count, string_agg(title, '|' order by node_id) as titles from nodes where level = 1 group by book_id")
def src8_baseline_files(spark, sf):
    """Baselines of books, written as a JSON file each and read again."""
    root = files.work_dir(spark)
    t = structure.nodes(_marked(spark, sf)).where("level = 1").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "title"))).alias("t"))
    name = F.concat(F.lit("b"), F.col("book_id").cast("string"))
    sample = F.to_json(F.struct(name.alias("name"), F.col("book_id").cast("string").alias("book_id"), F.size("t").alias("chapter_count"), F.col("t.title").alias("titles")))
    tree.write_files(t.select(F.concat(F.lit("golden/"), name, F.lit(".json")).alias("path"), sample.alias("content")), root)
    back = tree.read_files(spark, root).where("folder = 'golden'").select(F.from_json(F.decode("content", "UTF-8"), files.GOLDEN).alias("s"))
    return back.select("s.name", F.col("s.chapter_count").cast(LONG).alias("chapter_count"), F.array_join("s.titles", "|").alias("titles"))


# --- long books -------------------------------------------------------------------------------


@query(oracle.SQL["c3_rebuild"])
def c3_rebuild_in_segments(spark, sf):
    """The trees of all books by scans over segments of two batches."""
    return _flat(structure.nodes(segments.marked_lines(A.fx_batches(spark, sf), span=50)))


# --- documents --------------------------------------------------------------------------------


def _documents(spark, sf):
    b = A.fx_batches(spark, sf)
    m = files.staged(structure.marked_lines(b))
    nodes = files.staged(structure.nodes(m))
    return documents.documents(structure.structures(b, m, nodes), nodes, documents.node_lines(m))


@query(
    f"""{oracle.TREE}, tx as (select book_id, node_id, md5(string_agg(case when node then h.title else line end, chr(10) order by o)) as lines from marked where role in ('chapter', 'board', 'sub', 'content') group by 1, 2),
ids as (select book_id, node_id, row_number() over (partition by book_id order by node_id) as k from nodes)
select n.book_id, i.k as node_id, p.k as parent_id, n.chapter_no, n.level, n.board, n.title, n.page_range, n.char_count, n.image_count, n.table_count, tx.lines
from nodes n join ids i on i.book_id = n.book_id and i.node_id = n.node_id left join ids p on p.book_id = n.book_id and p.node_id = n.parent_id join tx on tx.book_id = n.book_id and tx.node_id = n.node_id"""
)
def src2_documents_read(spark, sf):
    """Trees as nested documents, written as structure.json of each book, and read back as trees."""
    root = files.work_dir(spark)
    docs = _documents(spark, sf).select(F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit("_T/structure.json")).alias("path"), F.col("document").alias("content"))
    tree.write_files(docs, root)
    back = tree.read_files(spark, root).select(F.regexp_extract("folder", r"^b(\d+)_", 1).cast(LONG).alias("book_id"), F.decode("content", "UTF-8").alias("document"))
    return documents.nodes_of(back).select(*[F.col(c).cast(LONG).alias(c) if c == "level" else c for c in TREE], F.md5(F.array_join("lines", "\n")).alias("lines"))


@query(f"""with o as ({oracle.SQL['c5_outline_reports']}) select 'b' || book_id || '_T/outline.md' as path, md5 from o union all select 'b' || book_id || '_T/structure.json', null from o""")
def snk1_structure_files(spark, sf):
    """structure.json and outline.md of each book; what the former has is src2_documents_read's."""
    root = files.work_dir(spark)
    b = A.fx_batches(spark, sf)
    m = files.staged(structure.marked_lines(b))
    nodes = files.staged(structure.nodes(m))
    s = files.staged(structure.structures(b, m, nodes))
    at = lambda name: F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit(f"_T/{name}")).alias("path")
    docs = documents.documents(s, nodes, documents.node_lines(m)).select(at("structure.json"), F.col("document").alias("content"))
    reports = render.outline_reports(s, nodes).select(at("outline.md"), F.col("report").alias("content"))
    tree.write_files(docs.unionByName(reports), root)
    back = tree.read_files(spark, root)
    return back.select("path", F.when(F.endswith("path", F.lit(".md")), F.md5("content")).alias("md5"))


@query(
    f"""{oracle.TREE}, d as (select book_id, node_id, 0 as depth, [node_id] as p from nodes where parent_id is null union all select n.book_id, n.node_id, depth + 1, list_append(p, n.node_id) from d join nodes n on n.book_id = d.book_id and n.parent_id = d.node_id)
select book_id, node_id, depth::bigint as depth, row_number() over (partition by book_id order by node_id) as pre, array_to_string(p, '/') as path from d"""
)
def c7_walked_trees(spark, sf):
    """Depth-first order of trees whose nodes are read back in any order: that of the lines."""
    nodes = files.staged(_flat(structure.nodes(_marked(spark, sf))).repartition(F.xxhash64("node_id", "title")))
    return documents.walk(nodes).select("book_id", "node_id", F.col("depth").cast(LONG).alias("depth"), "pre", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))




# --- results kept up to date, columns added later, resumed parsing ----------------------------


@query(
    f"""with {oracle.BODY}, {oracle.batches('body')}, b as (select book_id, batch_idx, page_start, page_end, case when book_id % 100 = 7 then text || '!' else text end as text from batches where book_id % 50 <> 3)
select book_id, string_agg(chr(10) || '<!-- batch ' || batch_idx || ': p' || page_start || '-' || page_end || ' -->' || chr(10) || chr(10) || text, chr(10) order by page_start, batch_idx) as md, book_id % 100 <> 7 as cached from b group by book_id"""
)
def snk11_refreshed_exports(spark, sf):
    """Exports of all books, then again after some changed and some went: only the changed
    ones are read and computed, and all rows are those of a full computation."""
    store, at = files.work_dir(spark), files.work_dir(spark)
    batches = A.fx_batches(spark, sf, toc=False)
    incremental.write_inputs(batches, f"{at}/1")
    made = lambda path: lambda books: render.raw_md(incremental.inputs_of(spark, path, books))
    one = spark.read.parquet(f"{at}/1").select("book_id").distinct().withColumn("version", F.lit(1).cast(LONG))
    incremental.refresh(one, made(f"{at}/1"), store)
    changed = F.col("book_id") % 100 == 7
    incremental.write_inputs(batches.withColumn("text", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), f"{at}/2")
    two = one.where("book_id % 50 <> 3").withColumn("version", F.when(changed, 2).otherwise(1).cast(LONG))
    incremental.refresh(two, made(f"{at}/2"), store)
    return incremental.current(spark, store).select("book_id", "md", (F.col("generation") == 1).alias("cached"))


_COLUMNS = {"id": ("long", None), "title": ("string", ""), "parse_status": ("string", "pending"), "parse_progress": ("string", ""), "quota_files": ("int", 0), "parse_error": ("string", "")}


def _changes(spark, sf):
    """Events as changes of the catalogue, of which some set columns to null."""
    e = A.load(spark, sf, "events")
    n = F.col("event_id")
    op = F.when(n % 11 == 5, "delete").when(n % 11 == 6, "insert").otherwise("update")
    sets = F.when(n % 11 == 6, F.array(F.lit("title"), F.lit("parse_status"))).when(n % 3 == 0, F.array(F.lit("parse_status"))).otherwise(F.array(F.lit("parse_progress"), F.lit("quota_files")))
    return e.select(
        F.col("user_id").alias("id"),
        n.alias("seq"),
        op.alias("op"),
        sets.alias("sets"),
        F.concat(F.lit("N"), n.cast("string")).alias("title"),
        F.col("event_type").alias("parse_status"),
        F.when(n % 4 != 0, F.concat(n.cast("string"), F.lit("/9"))).alias("parse_progress"),
        F.lit(1).alias("quota_files"),
        F.lit(None).cast("string").alias("parse_error"),
    )


@query(
    f"""with recursive {oracle.BOOKS.strip()},
t as (select id, title, parse_status, case when id % 2 = 0 then '' else parse_progress end as parse_progress, case when id % 2 = 0 then 0 else 1 end as quota_files, case when id % 2 = 0 then '' else parse_error end as parse_error from books),
ch as (select user_id as id, event_id as n, row_number() over (partition by user_id order by event_id) as k, event_type from events),
r as (select t.id, 0::bigint as k, true as there, t.title, t.parse_status, t.parse_progress, t.quota_files, t.parse_error from t
  union all select distinct ch.id, 0, false, null, null, null, null::int, null from ch where ch.id not in (select id from t)
  union all select r.id, ch.k, case when n % 11 = 5 then false when n % 11 = 6 then true else there end,
    case when n % 11 = 5 then null when n % 11 = 6 then 'N' || n else r.title end,
    case when n % 11 = 5 then null when n % 11 = 6 then event_type when there and n % 3 = 0 then event_type else r.parse_status end,
    case when n % 11 in (5, 6) then null when there and n % 3 <> 0 then case when n % 4 <> 0 then n || '/9' end else r.parse_progress end,
    case when n % 11 in (5, 6) then null when there and n % 3 <> 0 then 1 else r.quota_files end,
    case when n % 11 in (5, 6) then null else r.parse_error end
  from r join ch on ch.id = r.id and ch.k = r.k + 1)
select id, title, parse_status, parse_progress, quota_files, parse_error from (select * from r qualify row_number() over (partition by id order by k desc) = 1) where there"""
)
def snk12_merged_catalog(spark, sf):
    """A catalogue of two generations of files, of which the older lack three columns, and
    changes merged into it row by row."""
    path = files.work_dir(spark)
    books = A.fx_books(spark, sf)
    evolving.write_generation(books.where("id % 2 = 0").select("id", "title", "parse_status"), path, 1)
    evolving.write_generation(books.where("id % 2 = 1").select("title", "parse_error", "parse_status", "id", "parse_progress", "quota_files"), path, 2)
    return evolving.merged(evolving.read_generations(spark, path, _COLUMNS), _changes(spark, sf), "id")


_RESULTS = "book long, seq long, day string, batch_idx long, pages long, error string"


@query(
    """with r as (select user_id as book, event_id as seq, ts::date::varchar as day, event_id % 7 + 1 as batch_idx, coalesce(floor(value), 0)::bigint as pages, case when event_id % 4 = 1 then 'e' end as error from events),
f as (select *, min(case when error is null then seq end) over (partition by book, batch_idx) as done, min(seq) over (partition by book) as begun from r)
select book, seq, day, batch_idx, case when seq > done then 'skipped' when error is not null then 'failed' else 'parsed' end as action, case when seq = done then pages else 0 end as pages, (seq = begun)::bigint as files from f"""
)
def c14_resumed_batches(spark, sf):
    """Results of parsing in three parts as they arrive."""
    from quire.streaming import resume  # needs protobuf, which nothing else does

    at = files.work_dir(spark)
    e = A.load(spark, sf, "events")
    r = e.select(F.col("user_id").alias("book"), F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("day"), (F.col("event_id") % 7 + 1).alias("batch_idx"), F.coalesce(F.floor("value"), F.lit(0)).cast(LONG).alias("pages"), F.when(F.col("event_id") % 4 == 1, "e").alias("error"))
    cuts = r.agg(F.min("seq"), F.max("seq")).first()
    third = F.floor((F.col("seq") - F.lit(cuts[0])) * 3 / F.lit(cuts[1] - cuts[0] + 1))
    for k in range(3):
        r.where(third == k).coalesce(1).write.parquet(f"{at}/in/{k}")
        resume.run(spark, f"{at}/in", _RESULTS, f"{at}/out", f"{at}/state")
    return spark.read.schema(resume.OUT).parquet(f"{at}/out")
