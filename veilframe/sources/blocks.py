"""Sources: files and tables as rows of blocks.

A block is a piece of text with its place: doc_id, block_index, text, start, end, row. Formats that Spark can take apart by
expressions are; archives of XML (sheets) and JSON trees are walked in Arrow batches.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.spans import covered, match_spans

PARAGRAPH = r"(?m)^[ \t]*\S[^\n]*(?:\n[ \t]*\S[^\n]*)*"
FRONT = r"\A---[ \t]*\r?\n(?s:.*?)(?m:^(?:---|\.\.\.)[ \t]*(?:\r?\n|\z))"


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, content, content_hash of the files in a folder; of a recursive read, hidden, temporary and desktop files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    files = files.withColumn("content_hash", F.sha2("content", 256))
    if recursive:
        files = files.filter(~F.col("path").rlike(r"(?i)/(?:\.|~\$)[^/]*(?:/|\z)|/(?:desktop\.ini|thumbs\.db)\z"))
    return files


def _zip_has_sheets(content: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return any(n.startswith("xl/") for n in z.namelist())
    except zipfile.BadZipFile:
        return False


def detect_format(files: DataFrame) -> DataFrame:
    """Adds ``doc_format``: pdf, image, xlsx, text, json or csv, by magic bytes, then by name and content; null with ``problem`` set otherwise.

    Only archives are looked into in Python.
    """

    @F.pandas_udf("boolean")
    def has_sheets(content):
        return content.map(_zip_has_sheets)

    head = lambda n: F.hex(F.substring("content", 1, n))
    text = F.expr("try_cast(content AS string)")
    valid = F.call_function("is_valid_utf8", text)
    name, start = F.lower("path"), F.regexp_extract(text, r"\A﻿?\s*([\[{])", 1)
    parsed = F.call_function("json_object_keys", text).isNotNull() | F.call_function("json_array_length", text).isNotNull()
    kind = (
        F.when(head(5) == "255044462D", "pdf").when(head(3) == "FFD8FF", "image").when(head(8) == "89504E470D0A1A0A", "image")
        .when((head(4) == "504B0304") & has_sheets("content"), "xlsx").when(head(4) == "504B0304", None)
        .when(~valid, None)
        .when(name.rlike(r"\.(?:txt|md|markdown)\z"), "text")
        .when((start != "") & parsed, "json").when(name.endswith(".json"), None).otherwise("csv")
    )
    return files.withColumn("doc_format", kind).withColumn("problem", F.when(kind.isNull(), "unsupported or damaged file"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markdown: bool = False) -> DataFrame:
    """Blocks of texts: runs of lines that are not blank, with offsets and the number of lines before. Of markdown with front matter, each
    line of that is a block and its delimiters are none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = match_spans(text, PARAGRAPH)
    if markdown:
        bounds = F.length(F.regexp_extract(text, FRONT, 0))
        lines = F.filter(match_spans(F.left(text, bounds), r"[^\r\n]+"), lambda x: ~covered(text, x).rlike(r"\A(?:---|\.\.\.)[ \t]*\z"))
        body = F.transform(match_spans(F.substring(text, bounds + 1, F.length(text)), PARAGRAPH), lambda x: F.struct((x["s"] + bounds).alias("s"), (x["e"] + bounds).alias("e")))
        spans = F.when(bounds > 0, F.concat(lines, body)).otherwise(spans)
    rows = docs.select(id_col, text_col, F.posexplode(spans).alias("block_index", "x"))
    before = F.left(F.col(text_col), F.col("x.s"))
    row = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return rows.select(id_col, "block_index", covered(F.col(text_col), F.col("x")).alias("text"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), row.alias("row"))


def decode_csv(content: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    raise AssertionError("latin-1 decodes anything")


def csv_rows(text: str) -> tuple[list[list[str]], bool, str]:
    """Rows, whether the first is a header, and the delimiter; both are sniffed from the first 8192 characters."""
    sample = text[:8192]
    try:
        delimiter = csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    try:
        header = csv.Sniffer().has_header(sample)
    except csv.Error:
        header = True
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)), header, delimiter


CELLS = "doc_id string, row int, col int, header string, text string"


def _csv_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "col", "header", "text"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, has_header, _ = csv_rows(decode_csv(content))
            if not rows:
                raise ValueError(f"{doc} has no rows")
            header = rows[0] if has_header else []
            for r, row in enumerate(rows, -1 if has_header else 0):
                for c, value in enumerate(row):
                    if value.strip():
                        named = r >= 0 and c < len(header)
                        for column, v in zip(out, (doc, r, c, header[c] if named else f"col_{c}", value)):
                            column.append(v)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def csv_cells(files: DataFrame) -> DataFrame:
    """Cells of CSV files that are not blank; row -1 is the header, whose cells, like columns without one, are under col_N."""
    return files.select(F.col("path").alias("doc_id"), "content").mapInArrow(_csv_cells, CELLS)


def leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """Paths and texts of the string leaves of a JSON value that are not blank."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}[{json.dumps(k, ensure_ascii=False)}]")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    elif isinstance(value, str) and value.strip():
        yield path, value


def json_leaves(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(id, block_index, path, text) of the string leaves of JSON documents; numbers, booleans, nulls and keys are not scanned."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (path, leaf) in enumerate(leaves(json.loads(text))) if text else ():
                    for column, v in zip(out, (i, n, path, leaf)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[id_col, "block_index", "path", "text"])

    return docs.select(id_col, json_col).mapInArrow(run, f"{id_col} {kind}, block_index int, path string, text string")


def json_indent(text: Column) -> Column:
    """Blanks before the first indented line of a JSON text; null where none is."""
    return F.nullif(F.length(F.regexp_extract(text, r"\n( +)\S", 1)), F.lit(0))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str, str, bool]]:
    """(sheet, row, col, kind, text, read_only) of the string cells, formula results, comments and defined names of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in tree("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        book = tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in book.findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            for cell in tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{_NS['m']}}}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for c in letters:
                    col = col * 26 + ord(c) - 64
                kind, value = cell.get("t"), cell.findtext("m:v", None, _NS)
                formula = cell.find("m:f", _NS) is not None
                text = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else value if kind == "str" else None
                if text and text.strip():
                    yield sheet.get("name"), int(row), col, "formula_result" if formula else "value", text, formula
        for name in sorted(n for n in names if re.fullmatch(r"xl/comments\d*\.xml", n)):
            for comment in tree(name).iter(f"{{{_NS['m']}}}comment"):
                text = "".join(t.text or "" for t in comment.iter(f"{{{_NS['m']}}}t"))
                if text.strip():
                    yield name, 0, 0, "comment", text, False
        for name in book.findall("m:definedNames/m:definedName", _NS):
            yield "", 0, 0, "defined_name", name.get("name") or "", True


CELL_BLOCKS = "doc_id string, block_index int, sheet string, row int, col int, kind string, text string, read_only boolean"


def workbook_cells(files: DataFrame) -> DataFrame:
    """One row per string cell, formula result, comment and defined name of workbooks (path, content); the latter two kinds of result are read-only.

    A file that is no workbook fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, n, *cell) for n, cell in enumerate(sheet_cells(content))]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
                names = [c.split()[0] for c in CELL_BLOCKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, CELL_BLOCKS)


def ocr_lines(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_num", "par_num", "line_num")) -> DataFrame:
    """Lines of recognized words: texts joined by blanks in order of word_num, box around them."""
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "text")))
    return words.filter(F.trim("text") != "").groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
