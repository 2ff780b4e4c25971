"""Readers and writers of the engine's file kinds."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import search

#: One nested row for each document.
DOCUMENT = """document struct<file:string,sha256:string,pages:int,title:string,category:string,parts:array<string>,ids:map<string,string>>,
params array<struct<key:string,min:double,typ:double,max:double,unit:string,confidence:string,contested:boolean,flags:array<string>,page:int,readings:array<struct<source:string,extractor:string,page:int,min:double,max:double>>>>,
registers array<struct<name:string,address:string,reset:string,page:int,fields:array<struct<bits:string,name:string,access:string,reset:string,description:string>>>>,
enrichment map<string,struct<file:string,category:string,date:string,values:map<string,string>,unmapped:map<string,string>>>, flags array<string>"""


def scan(spark: SparkSession, path: str, glob: str = "*", skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modificationTime, content) of files below path, once each; skip: path prefixes that are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).dropDuplicates(["path"])
    for x in skip:
        files = files.filter(~F.col("path").startswith(x))
    return files


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document records, with `doc` from the file name; a file that isn't JSON is a row of nulls."""
    rows = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.data.json").option("multiLine", True).json(path)
    return rows.withColumn("doc", F.regexp_replace(F.col("_metadata.file_name"), "\\.data\\.json$", ""))


def params(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.inline("params")).drop("readings")


def readings(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.explode("params").alias("p")).select("doc", F.col("p.key").alias("key"), F.inline("p.readings"))


def register_fields(docs: DataFrame) -> DataFrame:
    """One row for each field; a register without fields still has a row."""
    rows = docs.select("doc", F.explode("registers").alias("r"))
    return rows.select("doc", F.col("r.name").alias("register"), F.col("r.address").alias("address"), F.col("r.page").alias("page"), F.explode_outer("r.fields").alias("f")).select("doc", "register", "address", "page", "f.bits", F.col("f.name").alias("field"), "f.access")


def enrichment(docs: DataFrame) -> DataFrame:
    """(doc, source, file, field, value): an unmapped value wins over a mapped one of the same name."""
    rows = docs.select("doc", F.explode("enrichment").alias("source", "e"))
    other = F.coalesce("e.unmapped", F.create_map().cast("map<string,string>"))
    mapped = F.map_filter(F.coalesce("e.values", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(other, k))
    return rows.select("doc", "source", F.col("e.file").alias("file"), F.explode(F.map_concat(mapped, other)).alias("field", "value"))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) of page-marked text files."""
    rows = spark.read.text(path, wholetext=True).withColumn("doc", F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", ""))
    return search.split_pages(rows, ["doc"], "value")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_rows(raw: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet. Shared and inline strings are resolved, a link formula gives its text, columns come
    from cell references, and rows are padded to the widest."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        tag = lambda e: e.tag.rpartition("}")[2]
        whole = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t")
        shared = [whole(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for row in (e for e in ElementTree.fromstring(z.read(min(n for n in names if re.match(r"xl/worksheets/[^/]*\.xml$", n)))).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                parts = {tag(x): x for x in c}
                value = (parts["v"].text or "") if "v" in parts else ""
                if c.get("t") == "s":
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = whole(c)
                if "f" in parts and (m := re.match(r'HYPERLINK\("[^"]*","([^"]*)"\)', parts["f"].text or "")):
                    value = m[1]
                cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = value
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    widest = max(map(len, out), default=0)
    return [r + [""] * (widest - len(r)) for r in out]


def xlsx_rows(files: DataFrame) -> DataFrame:
    """(path, row, cells) of the first sheet of each workbook (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                rows = sheet_rows(bytes(raw))
                yield pd.DataFrame({"path": path, "row": range(len(rows)), "cells": rows})

    return files.select("path", "content").mapInPandas(read, "path string, row int, cells array<string>")


def export_rows(cells: DataFrame, key_header: str, marker: str) -> DataFrame:
    """(path, part, header, value) of exports (path, row, cells) that have both a header row with key_header and the
    marker within their first 40 rows; rows below the header are keyed by normalised part, of which the last counts."""
    from factloom.functions.scalars import norm_part

    head = cells.filter("row < 40").groupBy("path").agg(F.min(F.when(F.array_contains("cells", key_header), F.col("row"))).alias("at"), F.bool_or(F.exists("cells", lambda c: c.contains(marker))).alias("marked")).filter("at is not null and marked")
    names = cells.join(head, "path").filter("row = at").select("path", "at", F.col("cells").alias("names"))
    rows = cells.join(names, "path").filter("row > at").withColumn("part", norm_part(F.try_element_at("cells", F.array_position("names", key_header).cast("int")))).filter("part != ''")
    last = rows.groupBy("path", "part").agg(F.max_by(F.struct("names", "cells"), "row").alias("r"))
    return last.select("path", "part", F.inline(F.arrays_zip(F.col("r.names").alias("header"), F.col("r.cells").alias("value")))).filter("header is not null and header != ''")


def frontmatter(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, field, values) of the block between the first two `---` lines; list items belong to the field above them."""
    block = F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---", 1)
    lines = df.select(key, F.posexplode(F.split(block, "\n")).alias("n", "line")).filter("line != ''")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.nullif(F.regexp_extract("line", "^([A-Za-z_][\\w-]*):", 1), F.lit(""))
    value = F.when(F.col("line").rlike("^\\s*- "), F.regexp_replace("line", "^\\s*- ", "")).otherwise(F.regexp_replace("line", "^[A-Za-z_][\\w-]*:\\s*", ""))
    rows = lines.withColumn("field", F.last(own, True).over(w)).withColumn("value", F.regexp_replace(F.trim(value), "^\"(.*)\"$", "$1")).filter("field is not null and value != ''")
    return rows.groupBy(key, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x.value).alias("values"))


def curated_sections(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, section, link) of `[[links]]` under the `## heading` above them, a .pdf ending dropped; lines (doc, n, line)."""
    w = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.nullif(F.regexp_extract("line", "^## (.*)$", 1), F.lit(""))
    rows = lines.withColumn("section", F.last(head, True).over(w))
    return rows.select(doc, "section", F.explode(F.regexp_extract_all("line", F.lit("\\[\\[([^\\]|]+)"), F.lit(1))).alias("link")).withColumn("link", F.regexp_replace("link", "(?i)\\.pdf$", ""))


def merge_card(old: Column, new: Column, owned: list[str]) -> Column:
    """The owned keys of new, and every other key of old."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*owned))
    return F.map_concat(kept, F.map_filter(new, lambda k, v: k.isin(*owned)))


def markdown_rows(*cells: Column) -> Column:
    """One line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def write_lines(df: DataFrame, path: str) -> None:
    """UTF-8 text with line feeds only."""
    df.write.option("lineSep", "\n").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_plan(df: DataFrame, path: str) -> None:
    """A plan as tab-separated values, with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def layout_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a layout reader's output below path, doc (the folder) and chunk (the file's name, in page order) first."""
    from factloom.operators.trees import LAYOUT

    rows = spark.read.schema(LAYOUT).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="p[0-9][0-9][0-9][0-9]-[0-9][0-9][0-9][0-9].json")
    at = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.element_at(at, -2).alias("doc"), F.element_at(at, -1).alias("chunk"), *[f for f in rows.columns])
