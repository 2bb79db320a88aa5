"""Files of exact names in folders, as a Spark data source: written aside, listed in a
manifest, then switched in; and read by folder, with filters that open fewer files.

A job writes below ``<root>/.jobs/<job>``: tasks stage files, each attempt in its own folder,
where they are numbered, beside a list of their names (a folder takes a block of the disk, as
a small file does, so staged files have none of their own); and the commit lists the attempts
that count in a manifest.  A failed or lost attempt isn't in it, so nothing of it is ever
seen.  ``publish`` then moves staged files together by folder and puts each folder in the
place of the old one, whole.  Its steps are spread over tasks,
keep to the manifest, and may be run again after a crash: before the manifest the old folders
stay as they are, after it ``recover`` finishes the job.  Files are dealt out by path, so a
folder with a third of all files is written by many tasks.

Paths are those of pyarrow's file systems (local, HDFS, S3), which tasks reach without a JVM.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

JOBS = ".jobs"
#: Bytes of file contents in an Arrow batch that a reader makes; a larger file is alone in one.
READ_BYTES = 4 << 20
#: Names that some systems keep to themselves.
RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root under any system: no empty or dotted
    part, no drive, backslash or control character, no reserved name, no part that ends in a
    space or point, or is longer than 255 characters.  Null isn't safe."""
    parts = F.split(path, "/", -1)
    fine = lambda p: (F.length(p).between(1, 255)) & ~F.rlike(p, F.lit(r'^\.{1,2}$|[<>:"\\|?*\x00-\x1f\x7f]|[ .]$')) & ~F.rlike(p, F.lit(RESERVED))
    return F.coalesce(F.forall(parts, fine) & (F.get(parts, F.lit(0)) != JOBS), F.lit(False))


def is_safe(path: str | None) -> bool:
    """``safe_path`` for one path: the writer's own guard."""
    parts = (path or "").split("/")
    return parts[0] != JOBS and all(0 < len(p) <= 255 and not re.search(r'^\.{1,2}$|[<>:"\\|?*\x00-\x1f\x7f]|[ .]$', p) and not re.match(RESERVED, p) for p in parts)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    at = re.sub("^s3[an]:", "s3:", root)  # one store, by Spark's names for it and by this library's
    fs, base = pafs.FileSystem.from_uri(at) if "://" in at else (pafs.LocalFileSystem(), at.removeprefix("file:"))
    return fs, base.rstrip("/")


def _names(fs: pafs.FileSystem, path: str) -> list[str]:
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)))


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _files(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(path)
    if found.type == pafs.FileType.File:
        return [found]
    return sorted((i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file), key=lambda i: i.path)


# --- writing ----------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    files: int
    size: int


def _refused(fs: pafs.FileSystem, path: str) -> bool:
    """Whether a local disk has no room for a path's name, or that of a part of it."""
    return isinstance(fs, pafs.LocalFileSystem) and (len(path.encode()) > 4095 or any(len(p.encode()) > 255 for p in path.split("/")))


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = _open(self.root)
        attempt, seen, size = uuid.uuid4().hex, {}, 0
        home = f"{base}/{JOBS}/{self.job}/attempts/{attempt}"
        try:
            fs.create_dir(home, recursive=True)
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    if not is_safe(path):
                        raise ValueError(f"not a path below the root: {path!r}")
                    if path in seen:
                        raise ValueError(f"two files of one name: {path!r}")
                    if _refused(fs, f"{base}/{JOBS}/{self.job}/new/{path}"):
                        raise OSError(f"too long a name: {path!r}")
                    with fs.open_output_stream(f"{home}/{len(seen)}") as out:
                        data = content.as_buffer() if content.is_valid else b""
                        out.write(data)
                        size += len(data)
                    seen[path] = None
            for path in seen:
                above = path
                while "/" in above:
                    above = above.rpartition("/")[0]
                    if above in seen:
                        raise ValueError(f"a file and a folder of one name: {above!r}")
            fs.create_dir(f"{base}/{JOBS}/{self.job}/paths", recursive=True)
            with fs.open_output_stream(f"{base}/{JOBS}/{self.job}/paths/{attempt}") as out:
                out.write("\n".join(seen).encode())
        except BaseException:
            fs.delete_dir(home)
            raise
        return Staged(attempt, len(seen), size)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = _open(self.root)
        home = f"{base}/{JOBS}/{self.job}"
        fs.create_dir(home, recursive=True)
        kept = [m for m in messages if m is not None and m.files]
        with fs.open_output_stream(f"{home}/manifest.tmp") as out:
            out.write(json.dumps({"attempts": [m.attempt for m in kept], "files": sum(m.files for m in kept), "bytes": sum(m.size for m in kept)}).encode())
        fs.move(f"{home}/manifest.tmp", f"{home}/manifest")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, base = _open(self.root)
        if _exists(fs, f"{base}/{JOBS}/{self.job}"):
            fs.delete_dir(f"{base}/{JOBS}/{self.job}")


def _each(names: DataFrame, f, schema: str) -> DataFrame:
    """The rows of f(name) for each name (one string column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from f(name)

    return names.mapInArrow(run, schema)


def _paths(fs: pafs.FileSystem, home: str, attempt: str) -> list[str]:
    """The names of an attempt's files, by their numbers."""
    with fs.open_input_stream(f"{home}/paths/{attempt}") as f:
        return f.read().decode().split("\n")


def _tops(root: str, job: str):
    """The top folders of an attempt's files."""

    def tops(attempt: str) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        folders = sorted({p.split("/")[0] for p in _paths(fs, f"{base}/{JOBS}/{job}", attempt)})
        yield pa.RecordBatch.from_pydict({"folder": pa.array(folders, pa.string())})

    return tops


def _gather(root: str, job: str):
    """Moves the staged files of an attempt into the job's new folders; says which."""

    def gather(attempt: str) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        home, new = f"{base}/{JOBS}/{job}/attempts/{attempt}", f"{base}/{JOBS}/{job}/new"
        paths, made = _paths(fs, f"{base}/{JOBS}/{job}", attempt), set()
        for number in sorted(map(int, _names(fs, home))):
            to = f"{new}/{paths[number]}"
            folder = to.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            if _exists(fs, to):
                raise ValueError(f"two files of one name: {paths[number]!r}")
            fs.move(f"{home}/{number}", to)
        yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt])})

    return gather


def _remove(fs: pafs.FileSystem, path: str) -> None:
    kind = fs.get_file_info(path).type
    if kind != pafs.FileType.NotFound:
        (fs.delete_file if kind == pafs.FileType.File else fs.delete_dir)(path)


def _switch(root: str, job: str):
    """Puts a new folder in the place of the old one, which goes."""

    def switch(folder: str) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        new, old, place = f"{base}/{JOBS}/{job}/new/{folder}", f"{base}/{JOBS}/{job}/old/{folder}", f"{base}/{folder}"
        if _exists(fs, new):
            if _exists(fs, place):
                fs.create_dir(old.rpartition("/")[0], recursive=True)
                if not _exists(fs, old):
                    fs.move(place, old)
            fs.move(new, place)
        _remove(fs, old)
        yield pa.RecordBatch.from_pydict({"folder": pa.array([folder])})

    return switch


def publish(spark: SparkSession, root: str, job: str) -> dict:
    """Finishes a committed job: gathers what was staged, switches folders, cleans up.  Gives
    the manifest.  The driver has the names of attempts only."""
    fs, base = _open(root)
    home = f"{base}/{JOBS}/{job}"
    with fs.open_input_stream(f"{home}/manifest") as f:
        manifest = json.loads(f.read())
    if manifest["attempts"]:
        attempts = spark.createDataFrame([(a,) for a in manifest["attempts"]], "attempt string").repartition(len(manifest["attempts"]))
        _each(attempts, _gather(root, job), "attempt string").count()
        # as many tasks as cores at least: a folder is a short name, but several steps on the disk; dealt in
        # turn, as by name Spark takes the partitions of distinct() and joins small ones
        tasks = max(len(manifest["attempts"]), spark.sparkContext.defaultParallelism)
        folders = _each(attempts, _tops(root, job), "folder string").distinct().repartition(tasks)
        _each(folders, _switch(root, job), "folder string").count()
    fs.delete_dir(home)
    return manifest


def recover(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """After a crash, with no writer at work: committed jobs are finished, others undone.
    Gives the names of both."""
    fs, base = _open(root)
    jobs = _names(fs, f"{base}/{JOBS}")
    committed = [j for j in jobs if _exists(fs, f"{base}/{JOBS}/{j}/manifest")]
    for j in committed:
        publish(spark, root, j)
    undone = [j for j in jobs if j not in committed]
    for j in undone:
        fs.delete_dir(f"{base}/{JOBS}/{j}")
    return committed, undone


def stage(files: DataFrame, root: str) -> str:
    """Writes (path, content) aside and commits them; gives the name of the job."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileTree)
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.repartition(F.col("path")).write.format("file_tree").mode("append").option("path", root).option("job", job).save()
    return job


def write_files(files: DataFrame, root: str) -> dict:
    """(path, content) to files below ``root``.  Top folders that ``files`` has are replaced
    as a whole, others stay.  Gives what was written: attempts, files, bytes."""
    return publish(files.sparkSession, root, stage(files, root))


def accepted(files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The files of the keys (books) whose paths are all safe and in one top folder that no
    other key has, and (key, reason) of the others."""
    top = F.substring_index("path", "/", 1)
    books = files.groupBy(key).agg(F.min(safe_path(F.col("path")).cast("int")).alias("safe"), F.min(top).alias("top"), F.count_distinct(top).alias("tops"))
    shared = books.groupBy("top").agg(F.count("*").alias("keys"))
    reason = F.when(F.col("safe") == 0, "unsafe path").when(F.col("tops") > 1, "several folders").when(F.col("keys") > 1, "folder of another")
    judged = books.join(shared, "top", "left").select(key, reason.alias("reason"))
    bad = judged.where("reason is not null")
    return files.join(bad, key, "left_anti"), bad


# --- reading ----------------------------------------------------------------------------------


@dataclass
class Folders(InputPartition):
    names: list[str] = field(default_factory=list)


_COMPARE = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _Reader(DataSourceReader):
    """One partition for each top folder, up to a number of partitions; filters on columns
    that names tell are taken over, and files that can't pass aren't opened."""

    named: tuple[str, ...] = ("folder", "path", "length")
    folder = "folder"

    def __init__(self, options: dict, columns: list[str]):
        self.root, self.most, self.columns = options["path"], int(options.get("partitions", 200)), columns
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in self.named:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, known: dict) -> bool:
        return all(_COMPARE[kind](known[name], value) for name, kind, value in self.tests if name in known)

    def partitions(self) -> list[Folders]:
        fs, base = _open(self.root)
        wanted = [t for t in self.tests if t[0] == self.folder and t[1] in (EqualTo, EqualNullSafe)]
        names = [v for v in {t[2] for t in wanted} if v and _exists(fs, f"{base}/{v}")] if wanted else _names(fs, base)
        names = [n for n in names if not n.startswith(".") and self.passes({self.folder: n})]
        size = -(-len(names) // self.most) if names else 1
        return [Folders(names[i : i + size]) for i in range(0, len(names), size)] or [Folders()]

    def rows(self, fs: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple[dict, int]]:
        """Rows of a folder, and the bytes in each."""
        raise NotImplementedError

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = _open(self.root)
        kept, size = [], 0
        for folder in partition.names:
            for row, more in self.rows(fs, base, folder):
                kept.append(row)
                size += more + 64
                if size >= READ_BYTES:
                    yield self.batch(kept)
                    kept, size = [], 0
        if kept:
            yield self.batch(kept)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], self.kinds[c]) for c in self.columns})


class TreeReader(_Reader):
    kinds = {"folder": pa.string(), "path": pa.string(), "length": pa.int64(), "content": pa.binary()}

    def rows(self, fs, base, folder):
        for info in _files(fs, f"{base}/{folder}"):
            row = {"folder": folder, "path": info.path[len(base) + 1 :], "length": info.size}
            if self.passes(row):
                if "content" in self.columns:
                    with fs.open_input_stream(info.path) as f:
                        row["content"] = f.read()
                yield row, info.size if "content" in self.columns else 0


class BatchReader(_Reader):
    """Batches of books by the names of their files: batch_<i>_p<a>-<b>.md, with the JSON of
    the same name beside it if there is one."""

    named = ("book", "batch_idx", "page_start", "page_end")
    folder = "book"
    kinds = {"book": pa.string(), "batch_idx": pa.int32(), "page_start": pa.int32(), "page_end": pa.int32(), "text": pa.string(), "content_json": pa.string()}

    def rows(self, fs, base, folder):
        names = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}", allow_not_found=True)) if i.is_file}
        for name, info in sorted(names.items()):
            m = re.fullmatch(r"batch_(\d+)_p(\d+)-(\d+)\.md", name)
            if not m:
                continue
            row = {"book": folder, "batch_idx": int(m[1]), "page_start": int(m[2]), "page_end": int(m[3]), "content_json": None}
            if not self.passes(row):
                continue
            with fs.open_input_stream(info.path) as f:
                row["text"] = f.read().decode("utf-8", "replace")
            beside = names.get(name[:-3] + ".json")
            if beside is not None:
                with fs.open_input_stream(beside.path) as f:
                    row["content_json"] = f.read().decode("utf-8", "replace")
            yield row, info.size + (beside.size if beside is not None else 0)


class FileTree(DataSource):
    """format("file_tree"): files below a folder.  Options: path; content (false: names and
    lengths only, no file is opened); partitions, at most so many."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "folder string, path string, length long" + (", content binary" if str(self.options.get("content", "true")).lower() == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


class BatchFiles(DataSource):
    """format("batch_files"): batches of books by the names of their files."""

    @classmethod
    def name(cls) -> str:
        return "batch_files"

    def schema(self) -> str:
        return "book string, batch_idx int, page_start int, page_end int, text string, content_json string"

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options), schema.names)


def _reading(spark: SparkSession, source: type[DataSource], root: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(root)


def read_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(folder, path, length) of all files below ``root``, with content unless it isn't
    wanted.  Filters on these columns are applied to names; one on a folder lists only it."""
    return _reading(spark, FileTree, root, content=str(content).lower())


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """(book, batch_idx, page_start, page_end, text, content_json) of <book>/batch_<i>_p<a>-<b>.md;
    files of other names are skipped.  Filters on book and pages decide which are opened."""
    return _reading(spark, BatchFiles, root)
