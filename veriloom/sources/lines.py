"""Transcripts as lines: a splittable data source that outlives bad files, and one that follows growing files.

A file is read in ranges of bytes.  A line belongs to the range in which it starts, so any
number of tasks can share a file, and a line is whole wherever it is cut.  ``n`` counts
the lines of a range from 1, blank ones too; with the numbers of lines in the ranges
before it, it gives the physical line.  LF, CR LF and CR end a line.

What can't be read makes no job fail: rows before the error are kept, and a row with
``error`` says what happened to the file.  A file that is gone or unreadable gives that
row alone, and one that has become shorter than it was listed is told as cut short.

Paths are read through pyarrow's file systems: local ones, and object stores and HDFS where
its drivers are installed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start long, n long, line string, error string"
#: Bytes of a range; ranges that a task takes have about as many in all, a file counting FILE bytes at least.
RANGE, FILE = 32 << 20, 1 << 20
CHUNK = 1 << 20
BREAK = re.compile(rb"\r\n|\n|\r")


@dataclass
class Ranges(InputPartition):
    """(file, start, end, size as listed) of what one task reads."""

    parts: list[tuple[str, int, int, int]]


def opened(file: str):
    """A random-access file, whatever store its URI names."""
    from pyarrow import fs

    parts = urlsplit(file)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else file)
    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def lines_between(stream, start: int, end: int) -> Iterator[bytes]:
    """Lines that start at ``start`` or later and before ``end``; the last one is read to its end."""
    at = max(0, start - 1)
    stream.seek(at)
    held, skip = b"", start > 0  # before the first line of a range that is not the first lies the rest of another
    while True:
        chunk = stream.read(CHUNK)
        seen = max(0, len(held) - 1)  # what was held has no break, but may end in half of one
        held += chunk
        last, cut = not chunk, 0
        for m in BREAK.finditer(held, seen):
            if m.end() == len(held) and m[0] == b"\r" and not last:
                break  # its LF may come
            if at + cut >= end:
                return
            if not skip:
                yield held[cut : m.start()]
            # a break that ends before the range starts leaves its line to the range before
            skip = skip and at + m.end() < start
            cut = m.end()
        at, held = at + cut, held[cut:]
        if at >= end:
            return
        if last:
            if held and not skip:
                yield held
            return


def read_range(file: str, start: int, end: int, size: int) -> Iterator[tuple]:
    """Rows of SCHEMA."""
    n = 0
    try:
        with opened(file) as stream:
            for raw in lines_between(stream, start, end):
                n += 1
                yield file, start, n, raw.decode("utf-8", "replace"), None
            if stream.size() < min(end, size):
                yield file, start, None, None, f"cut short: {stream.size()} of {size} bytes"
    except (OSError, pa.ArrowInvalid) as why:
        yield file, start, None, None, f"{type(why).__name__}: {why}"


def _batches(rows: Iterator[tuple], bytes_: int = 8 << 20, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[3] or "")
        if size > bytes_ or len(held) >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def cut(files: list[tuple[str, int]], size: int) -> list[tuple[str, int, int, int]]:
    return [(f, a, min(a + size, n), n) for f, n in files for a in range(0, max(n, 1), size)]


def packed(parts: list[tuple[str, int, int, int]], size: int) -> list[Ranges]:
    out, room = [], 0
    for part in parts:
        cost = max(FILE, part[2] - part[1])
        if not out or room + cost > size:
            out.append(Ranges([]))
            room = 0
        out[-1].parts.append(part)
        room += cost
    return out


class LinesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.size, self.tasks = int(options.get("range", RANGE)), int(options.get("tasks", 1))

    def partitions(self) -> list[Ranges]:
        parts = cut(self.files, self.size)
        # small ranges are many; a task takes its share of them, but no more than RANGE
        share = sum(max(FILE, b - a) for _, a, b, _ in parts) // self.tasks
        return packed(parts, max(self.size, FILE, min(RANGE, share))) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(row for part in partition.parts for row in read_range(*part))


class GrowthReader(DataSourceStreamReader):
    """Lines that files below a folder have gained; the offset has each file's bytes read so far.

    Only whole lines are taken: a file's end is its last line break, or its end once it has
    not changed for ``settled`` seconds.  A file that has become shorter is read from its start.
    With ``names`` a grown file gives one row, and is not read.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.settled, self.size = options["path"], float(options.get("settled", 60)), int(options.get("range", RANGE))
        self.names = options.get("names", "false") == "true"

    def initialOffset(self) -> dict:
        return {}

    def _listed(self) -> list[tuple[str, int, float]]:
        from pyarrow import fs

        parts = urlsplit(self.root)
        store, path = (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(self.root)
        prefix = self.root[: len(self.root) - len(path)] if parts.scheme not in ("", "file") else "file://"
        found = store.get_file_info(fs.FileSelector(path.rstrip("/"), recursive=True, allow_not_found=True))
        depth = path.rstrip("/").count("/") + 2
        return [(prefix + x.path, x.size, x.mtime_ns / 1e9) for x in found if x.is_file and x.path.endswith(".jsonl") and x.path.count("/") == depth]

    def latestOffset(self) -> dict:
        import time

        now = time.time()
        return {f: size if now - mtime > self.settled else last_break(f, size) for f, size, mtime in self._listed()}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        grown = [(f, start.get(f, 0) if start.get(f, 0) <= n else 0, n) for f, n in sorted(end.items()) if n != start.get(f, 0)]
        parts = [(f, a, min(a + self.size, n), n) for f, low, n in grown for a in range(low, n, self.size)]
        return packed(parts, max(self.size, FILE)) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if self.names:
            return _batches((f, start, None, None, None) for f, start, _, _ in partition.parts)
        return _batches(row for part in partition.parts for row in read_range(*part))


def last_break(file: str, size: int) -> int:
    """Where the last whole line of a file ends; 0 if it has none or can't be read."""
    try:
        with opened(file) as stream:
            at = size
            while at > 0:
                low = max(0, at - CHUNK)
                stream.seek(low)
                held = stream.read(at - low)
                # a CR at the very end may be half a break
                found = max(held.rfind(b"\n"), held.rfind(b"\r", 0, len(held) - 1) if at == size else held.rfind(b"\r"))
                if found >= 0:
                    return low + found + 1
                at = low
    except (OSError, pa.ArrowInvalid):
        pass
    return 0


class Lines(DataSource):
    """``transcript_lines``: option ``files``, a JSON list of (file, size); as a stream, ``path``, a folder of folders."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> GrowthReader:
        return GrowthReader(self.options)


def read_lines(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE) -> DataFrame:
    """Rows of SCHEMA for listed files."""
    spark.dataSource.register(Lines)
    return spark.read.format("transcript_lines").option("files", json.dumps(files)).option("range", size).option("tasks", spark.sparkContext.defaultParallelism).load()


def numbered(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(file, seq, line) with the physical line number, and (file, error) of files that failed.

    Only files of more than one range are counted first: a row for each range, summed in order.
    """
    rows = read_lines(spark, files, size)
    lines = rows.where("error is null").select("file", "start", "n", "line")
    large = [x for x in files if x[1] > size]
    if large:
        per = read_lines(spark, large, size).where("n is not null").groupBy("file", "start").agg(F.max("n").alias("k"))
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select("file", "start", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
        lines = lines.join(offsets, ["file", "start"], "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0)))
    return lines.select("file", F.col("n").cast("long").alias("seq"), "line"), rows.where("error is not null").select("file", "error")
