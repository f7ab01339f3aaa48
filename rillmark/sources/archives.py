"""Zip archives and workbooks as Spark data sources: a partition for each archive, member range or sheet, read as a stream.

Files are opened where tasks run, through any file system that pyarrow knows; only their names, and the directories of large
archives, are read while a query is planned. What can't be read is reported as a row with its `problem`.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

#: Archives over so many bytes are split into ranges of members, so many bytes (packed) each.
SPLIT = 256 << 20
#: Bytes of a table that are parsed at once.
BLOCK = 4 << 20
WAVEFORM = "a int, b int, m int, n int, injection_id string, channel_mn string, time double, current double, voltage double, polarity int"
BROKEN = (zipfile.BadZipFile, pa.ArrowInvalid, zlib.error, NotImplementedError, RuntimeError, EOFError, UnicodeDecodeError)


def opened(path: str):
    """A seekable stream of a file in any store."""
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def listed(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, or of the one file."""
    store, name = fs.FileSystem.from_uri(root)
    scheme = re.match(r"[a-z][a-z0-9+.-]*:(//[^/]*)?", root)
    prefix = scheme[0] if scheme else ""
    one = store.get_file_info(name)
    found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File)


def same_path(path: str) -> str:
    """A path as all of its spellings: file:/a, file:///a and /a are one."""
    return re.sub(r"^file:/+", "/", path)


@dataclass
class Part(InputPartition):
    path: str
    first: int = 0
    last: int | None = None  # of its members; None: all


def parts(path: str, size: int, split: int = SPLIT) -> list[Part]:
    """Ranges of members of a large archive; a smaller or unreadable one is a range of its own."""
    if size <= split:
        return [Part(path)]
    try:
        with opened(path) as f, zipfile.ZipFile(f) as archive:
            out, start, held = [], 0, 0
            for i, info in enumerate(archive.infolist()):
                if held and held + info.compress_size > split:
                    out.append(Part(path, start, i))
                    start, held = i, 0
                held += info.compress_size
            return [*out, Part(path, start, None)]
    except BROKEN:
        return [Part(path)]


class _Reader(DataSourceReader):
    """Members of the archives that end with `suffix` and lack `skip`."""

    def __init__(self, options: dict, suffix: str):
        self.options, self.suffix, self.skip = options, suffix, options.get("skip", "")
        self.only = {same_path(p) for p in json.loads(options["only"])} if options.get("only") else None
        self.names: list[str] = []

    def partitions(self):
        files = [(p, n) for p, n in listed(self.options["path"]) if p.endswith(self.options.get("ending", ".zip")) and (self.only is None or same_path(p) in self.only)]
        return [part for p, n in files for part in parts(p, n, int(self.options.get("split", SPLIT)))] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        try:
            with opened(partition.path) as f, zipfile.ZipFile(f) as archive:
                for info in archive.infolist()[partition.first : partition.last]:
                    if info.filename.endswith(self.suffix) and not info.is_dir() and not (self.skip and self.skip in info.filename):
                        try:
                            yield from self.member(partition.path, archive, info)
                        except BROKEN as error:
                            yield self.problem(partition.path, f"{info.filename}: {error}")
        except BROKEN as error:
            yield self.problem(partition.path, str(error))

    def problem(self, path: str, text: str) -> pa.RecordBatch:
        fields = self.schema_()
        return pa.RecordBatch.from_arrays([pa.array([{"path": path, "problem": text}.get(f.name)], f.type) for f in fields], schema=fields)


class _Waveforms(_Reader):
    """Rows of the tables *_fw.csv; with quads wanted, others are left where they are parsed."""

    def __init__(self, options: dict):
        super().__init__(options, "_fw.csv")
        self.quads = set(json.loads(options["quads"])) if options.get("quads") else None

    def schema_(self) -> pa.Schema:
        kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in WAVEFORM.split(", "))] + [("quad", pa.string()), ("path", pa.string()), ("problem", pa.string())])

    def member(self, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[pa.RecordBatch]:
        fields = self.schema_()
        with archive.open(info) as stream:
            # as text first, so that a cell that is no number is null instead of an error
            head = stream.readline().decode("utf-8-sig").strip()
            names = [c.strip().strip('"') for c in head.split(",")]
            if not head:
                return
            text = pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True)
            try:
                reader = pacsv.open_csv(stream, pacsv.ReadOptions(block_size=BLOCK, column_names=names), convert_options=text)
            except pa.ArrowInvalid as error:
                if "Empty" in str(error):
                    return
                raise
            for batch in reader:
                cells = {n: batch.column(i) for i, n in enumerate(names)}
                columns = [_cast(cells[f.name], f.type) if f.name in cells else pa.nulls(batch.num_rows, f.type) for f in fields]
                parts_ = [pc.cast(columns[i], pa.string()) for i in range(4)]
                columns[-3] = pc.binary_join_element_wise(*parts_, "_")
                columns[-2] = pa.array([path] * batch.num_rows, pa.string())
                out = pa.RecordBatch.from_arrays(columns, schema=fields)
                yield out if self.quads is None else out.filter(pc.is_in(columns[-3], pa.array(sorted(self.quads), pa.string())))


class _PushedWaveforms(_Waveforms):
    """Filters on quad reach the reader where the session allows it (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("quad",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("quad",):
                own = set(f.value)
            else:
                yield f
                continue
            self.quads = own if self.quads is None else self.quads & own


def _cast(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Text as a number, null where it is none."""
    if kind == pa.string():
        return column
    trimmed = pc.utf8_trim_whitespace(column)
    number = pc.match_substring_regex(trimmed, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    plain = pc.if_else(number, pc.utf8_ltrim(trimmed, "+"), None).cast(pa.float64())
    if kind == pa.float64():
        return plain
    whole = pc.and_(pc.equal(plain, pc.trunc(plain)), pc.less(pc.abs(plain), 2.0**31))
    return pc.if_else(whole, plain, None).cast(kind)


class _Members(_Reader):
    """Members as they are."""

    def __init__(self, options: dict):
        super().__init__(options, "")

    def schema_(self) -> pa.Schema:
        return pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("problem", pa.string())])

    def member(self, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, info.filename, archive.read(info), None), self.schema_(), strict=True)], schema=self.schema_())


class WaveformSource(DataSource):
    """spark.read.format("waveforms"): options path, only (JSON list of archives), quads (JSON list), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "waveforms"

    def schema(self) -> str:
        return f"{WAVEFORM}, quad string, path string, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PushedWaveforms if self.options.get("pushdown") == "true" else _Waveforms)(dict(self.options))


class MemberSource(DataSource):
    """spark.read.format("zipmembers"): options path, skip (members that hold it are left out)."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "path string, member string, content binary, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Members(dict(self.options))


# ---- workbooks

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times; fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Workbook:
    """Sheets of an .xlsx file, each read row by row; strings and formats are held, cells aren't."""

    def __init__(self, stream):
        self.archive = zipfile.ZipFile(stream)
        book = ElementTree.fromstring(self.archive.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))}
        target = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): target(links[s.get(LINK)]) for s in book.iter(f"{MAIN}sheet")}
        properties = book.find(f"{MAIN}workbookPr")
        early = properties is not None and properties.get("date1904") in ("1", "true")
        self.origin = dt.datetime(1904, 1, 1) if early else dt.datetime(1899, 12, 30)
        self.strings = ["".join(t.text or "" for t in item.iter(f"{MAIN}t") if t is not None) for item in self._items("xl/sharedStrings.xml", "si")]
        self.dates = self._date_styles()

    def _items(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        if name in self.archive.namelist():
            with self.archive.open(name) as stream:
                for _, item in ElementTree.iterparse(stream):
                    if item.tag == MAIN + tag:
                        yield item
                        item.clear()

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.archive.namelist():
            return set()
        styles = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
        shown = lambda code: re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code), re.IGNORECASE)
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if shown(f.get("formatCode", ""))}
        formats = styles.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", "0")) in own | DATE_FORMATS}

    def _value(self, cell: ElementTree.Element):
        kind, text = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "d":
            return dt.datetime.fromisoformat(text.rstrip("Z"))
        if kind != "n":
            return text
        if int(cell.get("s", "0")) in self.dates:
            return self.origin + dt.timedelta(milliseconds=round(float(text) * 86_400_000))
        return text

    def rows(self, sheet: str) -> Iterator[tuple[int, list]]:
        """(number from 1, cells) of rows that have any; cells are text, times or None."""
        number = 0
        for row in self._items(self.sheets[sheet], "row"):
            number = int(row.get("r", number + 1))
            cells: list = []
            for cell in row.iter(f"{MAIN}c"):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters:
                        at = 26 * at + ord(c) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._value(cell)
            yield number, cells


@dataclass
class Sheet(InputPartition):
    path: str
    name: str


class _Sheets(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], re.compile(options.get("sheets", ".*"), re.IGNORECASE)

    def partitions(self):
        out = []
        for path, _ in listed(self.path):
            with opened(path) as f:
                out += [Sheet(path, name) for name in Workbook(f).sheets if self.pattern.fullmatch(name)]
        return out or [Sheet("", "")]

    def read(self, partition: Sheet):
        if partition.path:
            with opened(partition.path) as f:
                for number, cells in Workbook(f).rows(partition.name):
                    at = cells[0] if cells and isinstance(cells[0], dt.datetime) else None
                    yield partition.path, partition.name, number, at, [x.isoformat(" ") if isinstance(x, dt.datetime) else x for x in cells]


class SheetSource(DataSource):
    """spark.read.format("sheets"): options path (a workbook or a folder of them) and sheets (a pattern of whole names)."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return "path string, sheet string, row int, at timestamp_ntz, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Sheets(dict(self.options))


SOURCES = {s.name(): s for s in (WaveformSource, MemberSource, SheetSource)}


def load(spark: SparkSession, source: str, path: str, **options: str | None) -> DataFrame:
    spark.dataSource.register(SOURCES[source])
    reader = spark.read.format(source).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in options.items():
        reader = reader if value is None else reader.option(name, value)
    return reader.option("path", path).load()
