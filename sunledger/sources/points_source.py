"""Line protocol and annotated CSV as Spark data sources: planned splits, pushed time filters, streams, and a writer whose commits are whole.

    register(spark)
    spark.read.format("lineprotocol").load(path).filter("time >= ...")
    spark.readStream.format("lineprotocol").load(path)
    points.write.format("lineprotocol").mode("append").save(path)
    spark.read.format("annotatedcsv").schema("_time timestamp, lux double").load(path)

Files are read wherever Arrow's file systems reach. A folder that the writer made has a log, one small file a commit with
the names of its files and their range of times: readers see whole commits only, skip files outside a filter's range, and
streams go from commit to commit. A folder without a log (a dump from elsewhere) is read file by file, and streams
take files in the order in which they were changed.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .annotated_csv import DROPPED

TEXT = T.StringType()
POINTS = T.StructType([T.StructField(n, k) for n, k in (("measurement", TEXT), ("tags", T.MapType(TEXT, TEXT)), ("field", TEXT), ("value", T.DoubleType()), ("value_str", TEXT), ("time", T.TimestampType()))])
CELLS = T.StructType([T.StructField(n, k) for n, k in (("path", TEXT), ("row", T.LongType()), ("column", TEXT), ("value", TEXT))])
#: Nanoseconds a unit.
PRECISION = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1000, "ns": 1}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ROWS = 10_000
#: How many heads, names or texts a task keeps in mind at once.
MEMO = 10_000


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach them."""
    spark.dataSource.register(LineProtocol)
    spark.dataSource.register(AnnotatedCsv)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def micros(t: datetime) -> int:
    """Of a datetime as filters and rows carry it; one without a zone is in the process's own, as Spark's rows are."""
    return (t.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


# -- files and commits ------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """The lines that begin in (start, end] of a file, and for the first piece the one at 0."""

    path: str
    start: int
    end: int


@dataclass
class File:
    path: str
    size: int
    changed: int
    #: The range of its times in microseconds, if known.
    low: int | None = None
    high: int | None = None


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return [f for f in found if f.type == fs.FileType.File]


def commits(path: str) -> list[tuple[int, dict]]:
    """The log of a folder, oldest first."""
    system, folder = place(path)
    found = sorted(f.path for f in _listed(system, f"{folder}/_log") if re.fullmatch(r"\d{12}\.json", f.base_name))
    return [(int(f[-17:-5]), json.loads(system.open_input_stream(f).read())) for f in found]


def _of_commit(folder: str, entry: dict) -> list[File]:
    return [File(f"{folder}/{f['name']}", f["size"], 0, f["low"], f["high"]) for f in entry["files"]]


def files(path: str) -> list[File]:
    """What a reader sees now: the files of whole commits since the last that replaced all, or those of a folder without a log."""
    system, folder = place(path)
    info = system.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [File(folder, info.size, info.mtime_ns or 0)]
    if logged := commits(path):
        last = max((n for n, entry in logged if entry["replaces"]), default=-1)
        return [f for n, entry in logged if n >= last for f in _of_commit(folder, entry)]
    return [File(f.path, f.size, f.mtime_ns or 0) for f in _listed(system, folder) if not re.search(r"(^|/)[._]", f.path[len(folder) :])]


def pieces(found: Sequence[File], each: int) -> list[Piece]:
    return [Piece(f.path, at, min(at + each, f.size)) for f in found for at in range(0, f.size, each)]


def lines(path: str, system: fs.FileSystem, start: int, end: int) -> Iterator[str]:
    """The lines of a piece: pieces next to each other share none and miss none."""
    with system.open_input_file(path) as file:
        file.seek(start)
        source, at = io.BufferedReader(file, 1 << 20), start
        if start:
            at += len(source.readline())  # the piece before has it: it began there, or at this one's first byte
        while at <= end and (raw := source.readline()):
            at += len(raw)
            text = raw.decode("utf-8", "replace").rstrip("\r\n")
            if text:
                yield text


class Between:
    """A range of times that filters leave open."""

    def __init__(self, column: str):
        self.column, self.low, self.high = column, -math.inf, math.inf

    def take(self, f) -> bool:
        """Whether a filter is one on the time that can be used here. (Spark still applies it.)"""
        if getattr(f, "attribute", None) != (self.column,) or not isinstance(getattr(f, "value", None), datetime):
            return False
        at = micros(f.value)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low = max(self.low, at)
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.high = min(self.high, at)
        return True

    def open(self, f: File) -> bool:
        return f.low is None or f.high is None or (f.high >= self.low and f.low <= self.high)

    def holds(self, at: int | None) -> bool:
        """A row without a time passes no comparison."""
        return self.low <= at <= self.high if at is not None else self.low == -math.inf and self.high == math.inf


# -- line protocol ----------------------------------------------------------------------------

_LINE = re.compile(r'((?:[^ \\]++|\\.)*+) ((?:[^ "\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+)(?: (-?\d+))?')
_PART = re.compile(r"(?:[^,\\]++|\\.)++")
_PAIR = re.compile(r"((?:[^=\\]++|\\.)*+)=(.*)", re.S)
_FIELD = re.compile(r'(?:[^,="\\]++|\\.)++=(?:"(?:[^"\\]++|\\.)*+"|[^,"]*+)')
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf(inity)?)", re.I)


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _kept(memo: dict, key, make: Callable):
    """The value of a key, made once while few others are asked for."""
    found = memo.get(key)
    if found is None:
        if len(memo) >= MEMO:
            memo.clear()
        found = memo[key] = make(key)
    return found


def _head(head: str) -> tuple[str | None, list[tuple[str, str]]]:
    parts = _PART.findall(head)
    return (_plain(parts[0]) if parts else None), list({_plain(p[1]): _plain(p[2]) for x in parts[1:] if (p := _PAIR.fullmatch(x))}.items())


def parse(line: str, unit_ns: int, heads: dict, names: dict) -> tuple[str, list[tuple[str, str]], list[tuple[str, float | None, str | None]], int | None] | None:
    """(measurement, tags, [(field, number, text)], time in microseconds) of a line; None if it isn't one.

    A measurement and its tags, and a field's name, come again and again: `heads` and `names` keep what they are.
    """
    m = _LINE.fullmatch(line)
    if not m:
        return None
    head, body, stamp = m.groups()
    measurement, tags = _kept(heads, head, _head)
    if measurement is None:
        return None
    found = []
    for x in _FIELD.findall(body):
        name, raw = _PAIR.fullmatch(x).groups()
        name = _kept(names, name, _plain) if name else ""
        if raw.startswith('"'):
            found.append((name, None, _plain(raw[1:-1]) if "\\" in raw else raw[1:-1]))
        else:
            found.append((name, float(raw) if _NUMBER.fullmatch(raw) else None, None))
    return measurement, tags, found, int(stamp) * unit_ns // 1000 if stamp else None


def _escaped(s: str) -> str:
    return re.sub(r"([\\ ,=])", r"\\\1", re.sub(r"[\r\n]+", " ", s))


def _quoted(text: str) -> str:
    return '"' + re.sub(r'([\\"])', r"\\\1", re.sub(r"[\r\n]+", " ", text)) + '"'


def _start(series: tuple[str, tuple[tuple[str, str | None], ...]]) -> str:
    measurement, tags = series
    return ",".join([_escaped(measurement), *(f"{_escaped(k)}={_escaped(v)}" for k, v in sorted(tags) if v is not None)])


def _tags(column: pa.MapArray) -> list[tuple]:
    """The pairs of each row."""
    at, pairs, live = column.offsets.to_pylist(), list(zip(column.keys.to_pylist(), column.items.to_pylist())), column.is_valid().to_pylist()
    return [tuple(pairs[a:b]) if ok else () for a, b, ok in zip(at, at[1:], live)]


def to_lines(batch: pa.RecordBatch, unit_ns: int, heads: dict, names: dict, texts: dict) -> Iterator[tuple[str, int | None]]:
    """(line, its time in microseconds) of the rows that have a value which a line can hold."""
    by = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    times = by["time"].cast(pa.timestamp("us", by["time"].type.tz)).cast(pa.int64()).to_pylist()
    for measurement, tags, field, value, text, at in zip(by["measurement"].to_pylist(), _tags(by["tags"]), by["field"].to_pylist(), by["value"].to_pylist(), by["value_str"].to_pylist(), times):
        if measurement is None or field is None:
            continue
        if text is not None:
            told = _kept(texts, text, _quoted)
        elif value is not None and math.isfinite(value):
            told = repr(value)
        else:
            continue
        line = f"{_kept(heads, (measurement, tags), _start)} {_kept(names, field, _escaped) if field else ''}={told}"
        yield (line if at is None else f"{line} {at * 1000 // unit_ns}"), at


class PointsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.unit, self.each = options["path"], PRECISION[options.get("precision", "ns")], int(options.get("splitBytes", 32 << 20))
        self.range = Between("time")

    def pushFilters(self, filters):
        for f in filters:
            self.range.take(f)
            yield f  # also Spark's: the range here is inclusive

    def partitions(self) -> Sequence[InputPartition]:
        return pieces([f for f in files(self.path) if self.range.open(f)], self.each) or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        heads, names = {}, {}
        for line in lines(partition.path, place(self.path)[0], partition.start, partition.end):
            if (found := parse(line, self.unit, heads, names)) and self.range.holds(found[3]):
                rows += [(found[0], found[1], *field, found[3]) for field in found[2]]
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = to_arrow_schema(POINTS)
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class PointsStream(DataSourceStreamReader):
    """Offsets are the number of the last commit, and for folders without a log the last file by time of change and name."""

    def __init__(self, options: dict):
        self.inner = PointsReader(options)

    def initialOffset(self) -> dict:
        return {"commit": -1, "changed": "0", "name": ""}

    def latestOffset(self) -> dict:
        if logged := commits(self.inner.path):
            return {"commit": logged[-1][0], "changed": "0", "name": ""}
        last = max(((f.changed, f.path) for f in files(self.inner.path)), default=(0, ""))
        return {"commit": -1, "changed": str(last[0]), "name": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["commit"] >= 0:
            folder = place(self.inner.path)[1]
            found = [f for n, entry in commits(self.inner.path) if start["commit"] < n <= end["commit"] for f in _of_commit(folder, entry)]
        else:
            low, high = (int(start["changed"]), start["name"]), (int(end["changed"]), end["name"])
            found = [f for f in files(self.inner.path) if low < (f.changed, f.path) <= high]
        return pieces(found, self.inner.each)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    low: int | None
    high: int | None


class PointsWriter(DataSourceArrowWriter):
    """A task writes a file of its own; the commit names the files of all tasks that succeeded, so those of failed ones are never seen."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.unit, self.overwrite = options["path"], PRECISION[options.get("precision", "ns")], overwrite

    def write(self, iterator) -> WriterCommitMessage:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        name, low, high, size, sink = f"points-{uuid.uuid4().hex}.lp", None, None, 0, None
        heads, names, texts = {}, {}, {}
        for batch in iterator:
            told = list(to_lines(batch, self.unit, heads, names, texts))
            if not told:
                continue
            if sink is None:
                sink = system.open_output_stream(f"{folder}/{name}")
            raw = "".join([line + "\n" for line, _ in told]).encode()
            sink.write(raw)
            size += len(raw)
            times = [at for _, at in told if at is not None]
            if len(times) < len(told):
                times = [-(1 << 62), 1 << 62]  # a row without a time: no filter may skip the file
            low, high = min(times) if low is None else min(low, *times), max(times) if high is None else max(high, *times)
        if sink is not None:
            sink.close()
        return Written(name if sink is not None else "", size, low, high)

    def commit(self, messages) -> None:
        system, folder = place(self.path)
        system.create_dir(f"{folder}/_log", recursive=True)
        number = max((n for n, _ in commits(self.path)), default=-1) + 1
        entry = {"replaces": self.overwrite, "files": [{"name": m.name, "size": m.size, "low": m.low, "high": m.high} for m in messages if m and m.name]}
        beside = f"{folder}/_log/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as sink:
            sink.write(json.dumps(entry).encode())
        system.move(beside, f"{folder}/_log/{number:012}.json")  # one writer at a time; readers see this commit whole or not at all

    def abort(self, messages) -> None:
        system, folder = place(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{folder}/{m.name}")


class LineProtocol(DataSource):
    """Options: path; precision s, ms, us or ns (the default); splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "lineprotocol"

    def schema(self) -> T.StructType:
        return POINTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PointsReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PointsStream(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PointsWriter(dict(self.options), overwrite)


# -- annotated CSV ----------------------------------------------------------------------------


def _value(text: str, kind: T.DataType):
    """A cell by the type of its column; null if it isn't one."""
    try:
        if isinstance(kind, T.TimestampType):
            t = datetime.fromisoformat(text)
            return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(text[:10])
        if isinstance(kind, T.FractionalType):
            return float(text)
        if isinstance(kind, T.IntegralType):
            return int(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(text.lower())
        return text
    except ValueError:
        return None


class CsvReader(DataSourceReader):
    """A file's header is state that runs through it, so a file is one split, read row by row."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.fields, self.cells = options["path"], schema, schema == CELLS
        self.range = Between("_time")

    def pushFilters(self, filters):
        for f in filters:
            self.range.take(f)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Piece(f.path, 0, f.size) for f in files(self.path)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if not partition.path:
            return
        with place(self.path)[0].open_input_stream(partition.path) as raw:
            header = None
            for number, row in enumerate(csv.reader(io.TextIOWrapper(raw, "utf-8", "replace", newline=""))):
                if not row or row[0].startswith("#"):
                    header = None if row else header
                elif header is None:
                    header = row
                elif self.cells:
                    yield from ((partition.path, number, c, v) for c, v in zip(header, row) if c not in DROPPED and v)
                else:
                    found = {c: v for c, v in zip(header, row) if v}
                    values = [_value(found[f.name], f.dataType) if f.name in found else None for f in self.fields]
                    at = next((v for f, v in zip(self.fields, values) if f.name == "_time" and isinstance(v, datetime)), None)
                    if self.range.holds(at and micros(at)):
                        yield tuple(values)


class AnnotatedCsv(DataSource):
    """Options: path. With a schema, a row a record with the columns that it names; without, a row a cell that isn't empty."""

    @classmethod
    def name(cls) -> str:
        return "annotatedcsv"

    def schema(self) -> T.StructType:
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CsvReader(dict(self.options), schema)
