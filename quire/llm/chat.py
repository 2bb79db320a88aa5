"""Chat formatting by schema fingerprints.  DataFrame and SQL functions only.

A record is JSON of any layout.  The hash of its nested field paths, those that any layout
knows, selects a declarative mapping to canonical turns; turns are written with a template whose control strings can't
occur in what is between them, and can be read back.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name

#: Layouts.  paths: fields of a record, [] after lists.  turns: (role, path) in order, or a
#: list's path with the fields of role and text; as_role renames roles.
LAYOUTS = [
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content"), "as_role": {}},
    {"name": "sharegpt", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value"), "as_role": {"human": "user", "gpt": "assistant"}},
    {"name": "completion", "paths": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "response", "paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    {"name": "system_response", "paths": ["system", "prompt", "response"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction", "paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    {"name": "instruction_input", "paths": ["instruction", "input", "output"], "turns": [("user", "instruction\n\ninput"), ("assistant", "output")]},
    {"name": "system_instruction", "paths": ["system", "instruction", "output"], "turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")]},
]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Inside texts and roles; both control strings begin with the first of these characters.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
_TURNS = "array<struct<role:string,text:string>>"

#: Bytes of a record up to which it is parsed as a variant; these hold 128 MiB, and their
#: parser strings of 20 million characters.
VARIANT_BYTES = 16_000_000
#: Bytes of a larger record without its texts; beyond it there is an error.
BARE_BYTES = 64_000_000
JSON_OPTIONS = {"maxStringLen": str((1 << 31) - 1)}


def large(record: Column) -> Column:
    return F.octet_length(record) > VARIANT_BYTES


def bare(record: Column) -> Column:
    """A JSON record with all its string values empty."""
    t = F.replace(F.replace(record, F.lit("\\\\"), F.lit("\ue000")), F.lit('\\"'), F.lit("\ue000"))
    t = F.regexp_replace(t, r'("[^"]*+"\s*+:)|(")[^"]*+"', "$1$2$2")
    return F.when(F.octet_length(t) > BARE_BYTES, F.raise_error(F.lit(f"a chat record has over {BARE_BYTES} bytes without its texts")).cast("string")).otherwise(t)


def paths_of(record: Column) -> Column:
    """Sorted nested field paths of a JSON record, comma-joined; null if it isn't an object.

    They come from the variant schema of the record, or of a large record without its
    texts: types go, names and nesting stay.
    """
    schema = F.schema_of_variant(F.try_parse_json(F.when(large(record), bare(record)).otherwise(record)))
    names = F.regexp_replace(schema, r": (?!ARRAY<|OBJECT<)[A-Z]+(\([0-9, ]*\))?", "")
    # objects in fields, lists of plain values, lists in lists and in messages: no layout looks
    # into them.  From the innermost outwards, as often as there are any at all.
    inner = [(r": OBJECT<[^<>]*>", ""), (r": ARRAY<[^<>]*>", "[]"), (r"<ARRAY<(?:OBJECT<[^<>]*>|[^<>]*)>", "<LIST"), (r"([ <]OBJECT<[^<>]*): ARRAY<OBJECT<[^<>]*>>", "$1[]")]
    once = lambda t: reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), inner, t)
    names = let(names, lambda t: F.aggregate(F.sequence(F.lit(1), F.greatest(F.regexp_count(t, F.lit("<")), F.lit(1))), t, lambda x, _: once(x)))
    flat = F.regexp_replace(F.regexp_replace(names, r": ARRAY<OBJECT<([^<>]*)>>", "[]<$1>"), r"^OBJECT<(.*)>$", "$1")
    item = F.split(F.regexp_replace(flat, r",(?![^<]*>)", "\u0001"), "\u0001")

    def spread(x: Column) -> Column:
        name, inner = F.trim(F.regexp_extract(x, r"^([^<]*)", 1)), F.regexp_extract(x, r"<([^>]*)>", 1)
        return F.when(inner == "", F.array(name)).otherwise(F.transform(F.split(inner, ","), lambda y: F.concat(name, F.lit("."), F.trim(y))))

    return F.when(schema.startswith("OBJECT<"), F.array_join(F.array_sort(F.flatten(F.transform(item, spread))), ","))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def known_paths(layouts: list[dict]) -> list[str]:
    """All paths of the layouts, and those of their lists when these are empty."""
    return sorted({p for x in layouts for p in (*x["paths"], *empty_list(x))})


def empty_list(layout: dict) -> list[str]:
    return [f"{layout['list'][0]}[]"] if "list" in layout else []


def _field(record: Column, name: str, kind: str) -> Column:
    small = F.try_variant_get(F.try_parse_json(record), f"$.{name}", kind)
    return F.when(large(record), F.from_json(record, f"`{name}` {kind}", JSON_OPTIONS)[name]).otherwise(small)


def _text(record: Column, path: str) -> Column:
    got = [F.coalesce(_field(record, p, "string"), F.lit("")) for p in path.split("\n\n")]
    return got[0] if len(got) == 1 else F.when(got[1] == "", got[0]).otherwise(F.concat_ws("\n\n", *got))


def _mapped(layout: dict, record: Column) -> Column:
    if "turns" in layout:
        return F.array(*[F.struct(F.lit(role).alias("role"), _text(record, path).alias("text")) for role, path in layout["turns"]]).cast(_TURNS)
    field, role, text = layout["list"]

    def turn(x: Column) -> Column:
        r = F.coalesce(x[role], F.lit(""))
        name = reduce(lambda out, kv: F.when(r == kv[0], F.lit(kv[1])).otherwise(out), layout["as_role"].items(), r)
        return F.struct(name.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return F.transform(_field(record, field, f"array<struct<`{role}`:string,`{text}`:string>>"), turn).cast(_TURNS)


def canonical(records: DataFrame, record_col: str = "record", layouts: list[dict] = LAYOUTS) -> DataFrame:
    """``records`` with layout and turns (array of role and text).

    Fields that no layout has, of a record or a message, are passed over.  A record with the
    fields of two layouts or of none, a null and what isn't a JSON object have null in both;
    so has one whose texts are lists of parts.  Fields are passed over however deep they are.  Missing and null fields are empty texts; an
    empty list of messages gives no turns.
    """
    mark = free_name(records.columns, "print")
    paths = paths_of(F.col(record_col))
    known = F.array(*[F.lit(x) for x in known_paths(layouts)])
    df = records.withColumn(mark, fingerprint(F.array_join(F.array_intersect(F.split(paths, ","), known), ",")))
    df = df.withColumn(mark, F.when(paths.isNotNull(), F.col(mark)))
    same = lambda x: F.col(mark) == fingerprint(F.lit(",".join(sorted(x))))
    is_ = [same(x["paths"]) | same(empty_list(x)) if "list" in x else same(x["paths"]) for x in layouts]
    name = F.coalesce(*[F.when(c, F.lit(x["name"])) for c, x in zip(is_, layouts)])
    turns = F.coalesce(*[F.when(c, _mapped(x, F.col(record_col))) for c, x in zip(is_, layouts)])
    return df.withColumn("layout", F.when(F.col(mark).isNotNull(), name)).withColumn("turns", turns).drop(mark)


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def marked_role(turn: Column) -> Column:
    return F.replace(escape(turn["role"]), F.lit("\n"), F.lit("\\3"))


def formatted(turns: Column) -> Column:
    """The whole conversation: for each turn OPEN, role, line feed, text, CLOSE."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), marked_role(t), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sums_before(lengths: Column, chunk: int = 256) -> Column:
    """For each of some numbers the sum of those before it, by sums of chunks, so that long
    arrays take little more than linear time."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    count = lambda x: ((F.size(x) + (chunk - 1)) / chunk).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)

    def of_chunks(x: Column, of: Column) -> Column:
        return let(of, lambda s: F.transform(upto(count(x)), lambda k: total(F.slice(s, F.lit(1), k))))

    def every(x: Column) -> Column:
        sums = F.transform(upto(count(x)), lambda k: total(F.slice(x, k * chunk + 1, F.lit(chunk))))
        return let(of_chunks(x, sums), lambda before: F.transform(x, lambda _, i: before[(i / chunk).cast("int")] + total(F.slice(x, (i / chunk).cast("int") * chunk + 1, i % chunk))))

    return F.when(F.size(lengths) == 0, lengths).otherwise(let(lengths, every))


_SPANS = "array<struct<turn:int,start:long,end:long>>"


def loss_mask(turns: Column) -> Column:
    """Spans of the formatted text, in code points, that are learned: for each turn of the
    assistant its escaped text, without the marks; with the number of the turn, from 0."""

    def measured(t: Column) -> Column:
        head = (F.length(marked_role(t)) + (len(OPEN) + 1)).cast("long")
        return F.struct(head.alias("head"), F.length(escape(t["text"])).cast("long").alias("text"), (t["role"] == "assistant").alias("own"))

    def spans(m: Column) -> Column:
        at = sums_before(F.transform(m, lambda x: x["head"] + x["text"] + len(CLOSE)))
        every = F.transform(F.arrays_zip(m.alias("m"), at.alias("at")), lambda x, i: F.struct(i.alias("turn"), (x["at"] + x["m"]["head"]).alias("start"), (x["at"] + x["m"]["head"] + x["m"]["text"]).alias("end"), x["m"]["own"].alias("own")))
        return F.transform(F.filter(every, lambda x: x["own"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["end"].alias("end")))

    return let(F.transform(turns, measured), spans).cast(_SPANS)


def parsed(text: Column) -> Column:
    """The turns of formatted text."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape(F.replace(role, F.lit("\\3"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(F.split(text, re.escape(OPEN)), 2, 1 << 30), turn)


def under_mask(text: Column, loss: Column) -> Column:
    """What is under the loss mask of formatted text: each span cut from it at its code
    points, unescaped, all joined.  Spans are cut from the part between two marks that they
    are in, so that long texts with many spans take linear time."""
    parts = F.slice(F.split(text, re.escape(OPEN)), 2, 1 << 30)

    def cut(p: Column) -> Column:
        # where each part begins in the text, counted in the text
        begins = F.transform(sums_before(F.transform(p, lambda x: (F.length(x) + len(OPEN)).cast("long"))), lambda at: at + len(OPEN))
        span = lambda b: lambda x: unescape(F.substr(p[x["turn"]], (x["start"] - b[x["turn"]] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
        return let(begins, lambda b: F.array_join(F.transform(loss, span(b)), ""))

    return let(parts, cut)


def format_chat(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with layout, turns, formatted and loss (see canonical and loss_mask); null
    where no layout fits.

    Columns of these names are replaced; all others stay.  Turns are in the order of the
    record.  Empty texts are turns with nothing between the marks, and give empty spans.
    Texts are taken whole, up to what a value of Spark's holds.  Repeated rows are each
    formatted; an empty table gives an empty one.
    """
    df = canonical(records, record_col)
    return df.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss", loss_mask(F.col("turns")))
