"""Exports of parameters (csv and xlsx) as a data source of Spark: spark.read.format("parameter_export").

An export is a table below a preamble. It is known by its first 40 rows: a cell of the preamble has the marker, and a row
begins with the header of its key column. One file is one partition; what a query asks of file, part and header reaches
the reader, so that other files aren't opened and other cells aren't made.
"""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from factloom.functions.scalars import norm_part
from factloom.sources.files import sheet_rows

#: The name of the format, and the marks of an export by default (fixed values).
FORMAT = "parameter_export"
KEY_HEADER, MARKER, DATED = "Product or Part number", "Parametric details for", "File generated on"
HEAD = 40
ROWS = "file string, category string, date string, part string, header string, value string"
_OWN = ("file", "category", "date", "part")


def listed(folder: str) -> list[str]:
    """Paths of a folder's csv and xlsx files in order of name; a csv beside an xlsx of its stem is the same export."""
    store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return []
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
    stem = lambda p: posixpath.splitext(p)[0]
    kind = lambda p: posixpath.splitext(p)[1].lower()
    books = {stem(p) for p in names if kind(p) == ".xlsx"}
    return [p for p in names if kind(p) == ".xlsx" or (kind(p) == ".csv" and stem(p) not in books)]


def _rows(folder: str, path: str, most: int | None = None) -> Iterator[list[str]]:
    """Cells of a file's rows; a file that is none of its kind has none. Of a csv file only what is asked for is read."""
    store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    try:
        with store.open_input_stream(path) as f:
            if path.lower().endswith(".xlsx"):
                rows = iter(sheet_rows(f.read()))
            else:
                rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", newline=""))
            for i, row in enumerate(rows):
                if most is not None and i >= most:
                    return
                yield row
    except (ValueError, KeyError, OSError, csv.Error, SyntaxError, zipfile.BadZipFile):
        return


class _Head:
    """What the first rows of a file say of it."""

    def __init__(self, rows: Iterable[list[str]], path: str, key: str, marker: str, dated: str):
        self.category, self.date, self.header, self.at = posixpath.splitext(posixpath.basename(path))[0], "", [], None
        marked = False
        for i, row in enumerate(rows):
            first = row[0] if row else ""
            marked = marked or marker in first
            if self.at is None and first.strip() == key:
                self.at, self.header = i, [h.strip() for h in row]
            elif self.at is None and len(row) > 1:
                self.category = (row[1].strip() or self.category) if marker in first else self.category
                self.date = row[1].strip() if dated in first else self.date
        self.known = marked and self.at is not None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names
        self.folder = options["path"]
        self.asked: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what is asked of file, part and header; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("file", "part", "header"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.asked[name] = self.asked[name] & values if name in self.asked else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = self.asked.get("file")
        return [_File(p) for p in listed(self.folder) if files is None or posixpath.basename(p) in files]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        marks = (self.options.get("keyheader", KEY_HEADER), self.options.get("marker", MARKER), self.options.get("dated", DATED))
        head = _Head(_rows(self.folder, partition.path, HEAD), partition.path, *marks)
        if not head.known:
            return
        own = (posixpath.basename(partition.path), head.category, head.date)
        wide = "header" not in self.names
        # the last row of a part counts: its number is kept for each part, and rows are made in a second pass
        last: dict[str, int] = {}
        for i, row in enumerate(_rows(self.folder, partition.path)):
            if i > head.at and row and row[0].strip():
                last[_norm(row[0])] = i
        for i, row in enumerate(_rows(self.folder, partition.path)):
            if i <= head.at or not row or not row[0].strip():
                continue
            part = _norm(row[0])
            if last[part] != i or not self._wanted("part", part):
                continue
            cells = {h: row[k].strip() if k < len(row) else "" for k, h in enumerate(head.header) if h}
            if wide:
                yield (*own, part, *[cells.get(h) for h in self.names[len(_OWN) :]])
            else:
                yield from ((*own, part, h, v) for h, v in cells.items() if self._wanted("header", h))

    def _wanted(self, name: str, value: str) -> bool:
        return name not in self.asked or value in self.asked[name]


def _norm(text: str) -> str:
    """A part number without a download's number, punctuation and case; the same as norm_part."""
    name = text.strip()
    if name.endswith(")"):
        stem, _, n = name[:-1].rpartition("(")
        if n.isdecimal() and len(n) <= 2:
            name = stem
    return "".join(c for c in name if c.isascii() and c.isalnum()).upper()


class ExportSource(DataSource):
    """Options: path (a folder), keyHeader, marker, dated, and wide: a column for each header of the folder's exports in
    place of a row for each cell."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType | str:
        if self.options.get("wide", "false").lower() != "true":
            return ROWS
        folder = self.options["path"]
        marks = (self.options.get("keyheader", KEY_HEADER), self.options.get("marker", MARKER), self.options.get("dated", DATED))
        heads = [_Head(_rows(folder, p, HEAD), p, *marks) for p in listed(folder)]
        found = dict.fromkeys(h for x in heads if x.known for h in x.header if h and h.lower() not in _OWN)
        return StructType([StructField(n, StringType()) for n in (*_OWN, *found)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read_exports(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The exports of a folder: ROWS, or a column for each header with wide="true"."""
    spark.dataSource.register(ExportSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**options).load(folder)


#: Overrides by part and field, with why and when they were checked.
OVERRIDES = "part string, field string, value double, why string, checked string"


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """OVERRIDES of a JSON file that gives parts their fields, why and checked; keys that begin with an underscore are left
    out. No file, or one that isn't JSON, overrides nothing."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OVERRIDES)
    strings = "map<string, string>"
    parts = text.select(F.explode(F.from_json("value", strings)).alias("part", "said")).filter(~F.col("part").startswith("_"))
    said = parts.select(norm_part(F.col("part")).alias("part"), F.from_json("said", strings).alias("m"))
    fields = F.map_filter("m", lambda k, _: ~k.isin("why", "checked"))
    rows = said.select("part", F.explode(fields).alias("field", "x"), F.col("m")["why"].alias("why"), F.col("m")["checked"].alias("checked"))
    return rows.select("part", "field", F.col("x").try_cast("double").alias("value"), "why", "checked").filter("value is not null")


def with_overrides(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """values (part, field, value) with overrides laid on top, and overridden; an override of what isn't there is a row."""
    o = overrides.groupBy(F.col("part").alias("_p"), F.col("field").alias("_f")).agg(F.min(F.struct("value", "why", "checked")).alias("_o"))
    met = values.join(o, (F.col("part") == F.col("_p")) & (F.col("field") == F.col("_f")), "full")
    return met.select(F.coalesce("part", "_p").alias("part"), F.coalesce("field", "_f").alias("field"), F.coalesce("_o.value", "value").alias("value"), F.col("_o").isNotNull().alias("overridden"), F.col("_o.why").alias("why"))
