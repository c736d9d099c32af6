"""A whole package of files as one table, read in parallel by file and byte range.

``PackageSource`` is a Python data source (``spark.read.format("docloom_package")``).  The driver only lists paths and
sizes; text-like files are cut into byte ranges that end at line ends, notebooks are read cell by cell.  No file is ever one row,
and the suffix decides how a file is read.  Files are opened through ``pyarrow.fs``, so local and mounted folders, object
stores and HDFS are reached alike; a range whose task is lost is simply read again.

Rows are ``path, clase, parte, pos, campo, texto``: ``clase`` is the suffix; ``parte`` a cell's number (0 for text); ``pos`` the byte a
line starts at, or the place within the cell; ``campo`` says what the text is: ``linea``, a cell's ``markdown`` or ``code``, an output's
``text``, ``plain`` or ``markdown_out``, or ``imagen`` for an embedded picture (without text).

Defined cases: an empty file gives no rows; undecodable bytes become replacement marks; a line longer than a range belongs
to the range it starts in; a notebook that is no JSON gives one row with campo ``error``; files of other suffixes give none.
"""

from __future__ import annotations

import codecs
import io
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "docloom_package"
SCHEMA = "path string, clase string, parte long, pos long, campo string, texto string"
TEXT_SUFFIXES = ("md", "txt", "csv", "log", "out", "json", "jsonl")
RANGE = 32 << 20
LOAD = 4 << 20  # bytes that one task gets, in ranges
BATCH = 2048
NOT_INPUT = re.compile(r"(^|/)(\.venv|output|__pycache__)(/|$)")  # fixed value: folders that are not input


def _open(root: str):
    """(file system, path) of a folder given as URI or path."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    return fs.LocalFileSystem(), root


def listing(root: str, only_input: bool = False) -> list[tuple[str, int]]:
    """(path below root, size) of every file, by path."""
    from pyarrow import fs

    system, base = _open(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    rel = [(posixpath.relpath(f.path, base), f.size) for f in found if f.type == fs.FileType.File]
    kept = [(p, n) for p, n in rel if not posixpath.basename(p).startswith(("_", ".")) and not (only_input and NOT_INPUT.search(p))]
    return sorted(kept)


@dataclass
class Piece(InputPartition):
    """Stretches (path, from, to) that one task reads, range by range; to = -1 for a file that is read as a whole stream."""

    stretches: list[tuple[str, int, int]]


class PackageReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.size = int(options.get("range", RANGE))
        self.input = options.get("input", "false") == "true"

    def partitions(self):
        load = max(1, LOAD // self.size) * self.size  # whole ranges, so small ones do not make a task each
        made, held, room = [], [], load
        for path, n in listing(self.root, self.input):
            suffix = path.rsplit(".", 1)[-1]
            cuts = [(path, 0, -1)] if suffix == "ipynb" else [(path, a, min(a + load, n)) for a in range(0, n, load)] if suffix in TEXT_SUFFIXES else []
            for c in cuts:
                cost = n if c[2] < 0 else c[2] - c[1]
                if held and cost > room:
                    made.append(Piece(held))
                    held, room = [], load
                held.append(c)
                room -= cost
        return [*made, Piece(held)] if held or not made else made

    def read(self, partition):
        system, base = _open(self.root)
        rows: list[tuple] = []
        for path, a, b in partition.stretches:
            clase = path.rsplit(".", 1)[-1]
            with io.BufferedReader(system.open_input_file(posixpath.join(base, path)), 1 << 16) as f:
                own = (x for at in range(a, b, self.size) for x in lines(f, at, min(at + self.size, b))) if b >= 0 else cells(f)
                for parte, pos, campo, texto in own:
                    rows.append((path, clase, parte, pos, campo, texto))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class PackageSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PackageReader(self.options)


# ------------------------------------------------------------------ what a file holds
def lines(f, begin: int, stop: int) -> Iterator[tuple[int, int, str, str]]:
    """The lines that start in begin..stop-1; the last one may end beyond."""
    at = begin
    if begin:
        f.seek(begin - 1)
        at += len(f.readline()) - 1  # the line that began before
    else:
        f.seek(0)
    while at < stop:
        raw = f.readline()
        if not raw:
            return
        yield 0, at, "linea", raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
        at += len(raw)


def cells(f, step: int = 1 << 20) -> Iterator[tuple[int, int, str, str | None]]:
    """Sources and outputs of a notebook, decoded one cell at a time from the stream."""
    decoder, number = json.JSONDecoder(), 0
    buffer, done = "", False
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode

    def more() -> bool:
        nonlocal buffer, done
        part = f.read(step)
        done = not part
        buffer += decode(part, done)
        return not done

    opened = re.compile(r'"cells"\s*:\s*\[')
    while not (m := opened.search(buffer)):
        if not more():
            yield 0, 0, "error", "sin celdas"
            return
        if len(buffer) > 2 * step:
            buffer = buffer[-64:]
    buffer = buffer[m.end() :]
    while True:
        buffer = buffer.lstrip(" \t\r\n,")
        if buffer.startswith("]"):
            return
        try:
            cell, end = decoder.raw_decode(buffer)
        except ValueError:
            if not more():
                yield number, 0, "error", "celda ilegible"
                return
            continue
        yield from _fields(cell if isinstance(cell, dict) else {}, number)
        buffer, number = buffer[end:], number + 1


def _joined(v) -> str:
    return "".join(v) if isinstance(v, list) else v if isinstance(v, str) else ""


def _fields(cell: dict, number: int) -> Iterator[tuple[int, int, str, str | None]]:
    kind = cell.get("cell_type", "")
    yield number, 0, kind if kind in ("markdown", "code") else "otra", _joined(cell.get("source"))
    pos = 1
    for o in cell.get("outputs") or []:
        data = o.get("data") or {}
        for key, campo, v in (("text", "text", o.get("text")), ("text/plain", "plain", data.get("text/plain")), ("text/markdown", "markdown_out", data.get("text/markdown"))):
            if v is not None:
                yield number, pos, campo, _joined(v)
                pos += 1
        if "image/png" in data:
            yield number, pos, "imagen", None
            pos += 1


# ------------------------------------------------------------------ tables
def read_package(spark: SparkSession, root: str, input_only: bool = False, byte_range: int = RANGE) -> DataFrame:
    """The rows of every readable file below ``root``; ``input_only`` leaves out folders a run writes to."""
    spark.dataSource.register(PackageSource)
    return spark.read.format(NAME).option("input", str(input_only).lower()).option("range", byte_range).load(root)


def deliverable_lines(rows: DataFrame, with_outputs: bool = True) -> DataFrame:
    """What a deliverable says: lines of texts, Markdown cells and, on request, text outputs of code cells."""
    said = ["linea", "markdown"] + (["text", "plain", "markdown_out"] if with_outputs else [])
    return rows.where(F.col("campo").isin(*said))


def input_lines(rows: DataFrame) -> DataFrame:
    """What a run was given: texts, and the sources of all notebook cells."""
    return rows.where(F.col("campo").isin("linea", "markdown", "code", "otra"))


def deliverables(paths: DataFrame, pattern: str, run: Column) -> DataFrame:
    """``run, path``: of each run the first matching path, those at the top before deeper ones."""
    depth = F.size(F.split("path", "/"))
    found = paths.where(F.regexp_like("path", F.lit(pattern))).select(run.alias("run"), "path").distinct()
    return found.groupBy("run").agg(F.min_by("path", F.struct(depth, F.col("path"))).alias("path"))


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes`` of every file, from the file system's own listing, read in parallel."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)  # the content column is never read
    return f.select(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(re.sub("^file:/+", "/", root).rstrip("/") + "/"), F.lit("")).alias("path"), F.col("length").alias("bytes"))
