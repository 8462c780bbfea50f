"""Reading mixed files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("csv", "json", "jsonl", "txt", "xlsx", "docx")
_TABLE = "file string, sheet string, row_idx long, headers array<string>, cells array<string>"


def read_csv_strings(spark: SparkSession, path: str, line_feeds: bool = True) -> DataFrame:
    """A1: a header line, all cells as text; short rows are padded, cells beyond the header dropped, null is empty.

    Quoted cells may hold line feeds, so a file is one task's work; without line_feeds files are split, and no cell may.
    """
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", escape='"', multiLine=line_feeds, enforceSchema=False).na.fill("")


def _records(text: Column) -> Column:
    """The records of JSON text as JSON texts: those of a list, of {rows}, of {data: {rows}}, or the one object; null for what is no JSON."""
    text = F.trim(text)
    listed = F.when(text.startswith("["), text).otherwise(F.coalesce(F.get_json_object(text, "$.rows"), F.get_json_object(text, "$.data.rows"), F.concat(F.lit("["), text, F.lit("]"))))
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(listed, "array<string>"))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A2: (file, i, record): the records of a list, of {rows}, of {data: {rows}}, or the one object, as JSON text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.posexplode(_records(F.col("value"))).alias("i", "record"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A3: a record in a line; empty lines are skipped. Give the schema to save the pass that infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """A4: (file, text): UTF-8, or latin-1 where the bytes are not valid UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("file", text.alias("text"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_files(z: zipfile.ZipFile, names: set[str]) -> Iterator[tuple[str, str]]:
    """Names of a workbook's sheets, in its order, with their files by relation id; by number where relations are missing."""
    listed = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    links = "xl/_rels/workbook.xml.rels"
    target = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read(links)).iter() if _local(e.tag) == "Relationship"} if links in names else {}
    numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for i, e in enumerate(listed):
        own = next((target[v] for k, v in e.attrib.items() if _local(k) == "id" and v in target), None)
        name = (own.lstrip("/") if own.startswith("/") else posixpath.normpath(f"xl/{own}")) if own is not None else numbered[i] if i < len(numbered) else ""
        if name in names and name.rsplit("/", 2)[-2] != "chartsheets":
            yield e.get("name", ""), name


def sheet_rows(z: zipfile.ZipFile, name: str) -> list[list[str]]:
    """A sheet's rows of text."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    rows = []
    for r in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
        cells: list[str] = []
        for c in (e for e in r if _local(e.tag) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = reduce(lambda a, x: a * 26 + ord(x) - 64, letters[0], 0) - 1 if letters else len(cells)
            cells += [""] * (at - len(cells))
            value = next((e.text or "" for e in c if _local(e.tag) == "v"), "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"))
            kind = c.get("t")
            cells.append(shared[int(value)] if kind == "s" and value else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value)
        rows.append(cells)
    return rows


def _sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Sheets of a workbook: name and rows of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for title, name in _sheet_files(z, set(z.namelist())):
            yield title, sheet_rows(z, name)


def headed(file: str, name: str, rows: list[list[str]]) -> list[tuple]:
    """A table row for each row below the first, whose text cells are the headers."""
    if not rows:
        return []
    heads = [h if h and not re.fullmatch(r"-?[\d.]+", h) else f"column_{i}" for i, h in enumerate(rows[0])]
    return [(file, name, i, heads, (r + [""] * len(heads))[: len(heads)]) for i, r in enumerate(rows[1:])]


def _rows_of(binary: DataFrame, tables) -> DataFrame:
    """A table row for each row below the first, whose text cells are the headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                for name, rows in tables(content):
                    if body := headed(file, name, rows):
                        yield pd.DataFrame(body, columns=["file", "sheet", "row_idx", "headers", "cells"])

    return binary.select("path", "content").mapInPandas(run, _TABLE)


def read_xlsx_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A5: (file, sheet, row_idx, headers, cells) of all sheets, or of one; a task reads whole files."""
    rows = _rows_of(spark.read.format("binaryFile").load(path), _sheets)
    return rows if sheet is None else rows.filter(F.col("sheet") == sheet)


def _document(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs outside of tables, and the tables, of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    paragraphs = [text(e) for e in body if _local(e.tag) == "p"]
    tables = [[[text(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"] for e in body if _local(e.tag) == "tbl"]
    return paragraphs, tables


def read_docx_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): paragraphs, joined by line feeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["path"], "text": ["\n".join(p for p in _document(c)[0] if p) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, text string")


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    return _rows_of(spark.read.format("binaryFile").load(path), lambda content: ((f"table_{i}", t) for i, t in enumerate(_document(content)[1])))


def discover_files(spark: SparkSession, root: str, patterns: list[str] = ("*",), max_bytes: int = 50 << 20) -> DataFrame:
    """(path, length, ext) of files of known extensions below root, each once, none over max_bytes; contents are not read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select("path", "length") for p in patterns]
    every = reduce(DataFrame.unionByName, found).dropDuplicates(["path"]).withColumn("ext", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    return every.filter(F.col("ext").isin(*EXTENSIONS) & (F.col("length") <= max_bytes))


def _typed(spark: SparkSession, root: str, ext: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}").load(root)


def extract_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(text_blocks (file, page, text), table_rows (file, sheet, row_idx, headers, cells)) of all files below root, by extension."""
    content = F.col("content").cast("string")
    text: Column = F.when(F.is_valid_utf8(content), content).otherwise(F.decode("content", "ISO-8859-1"))
    plain = _typed(spark, root, "txt").select(F.col("path").alias("file"), F.lit(1).alias("page"), text.alias("text"))

    def docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["path"], "page": 1, "text": ["\n".join(p for p in _document(c)[0] if p) for c in b["content"]]})

    words = _typed(spark, root, "docx").select("path", "content").mapInPandas(docs, "file string, page int, text string")

    def sheet(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
        import csv

        yield "", [r for r in csv.reader(io.StringIO(content.decode("utf-8", "replace"))) if r]

    tables = [_rows_of(_typed(spark, root, "csv"), sheet), _rows_of(_typed(spark, root, "xlsx"), _sheets), _rows_of(_typed(spark, root, "docx"), lambda c: ((f"table_{i}", t) for i, t in enumerate(_document(c)[1])))]
    for ext in ("json", "jsonl"):
        records = _typed(spark, root, ext).select(F.col("path").alias("file"), F.posexplode(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "") if ext == "jsonl" else _records(text)).alias("row_idx", "r"))
        fields = F.map_entries(F.from_json("r", "map<string,string>"))
        tables.append(records.select("file", F.lit("").alias("sheet"), F.col("row_idx").cast("long").alias("row_idx"), F.transform(fields, lambda e: e["key"]).alias("headers"), F.transform(fields, lambda e: F.coalesce(e["value"], F.lit(""))).alias("cells")))
    return plain.unionByName(words), reduce(DataFrame.unionByName, tables)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """H3: (file, size, sha256)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))
