"""Spreadsheets (XLSX): cells as a Spark data source, and a small writer for reports.

A workbook is one zip, so one task reads one file; folders of workbooks are read in parallel.
``read_cells(spark, path)`` gives rows (file, sheet, line, col, value, excel_type,
number_format, is_formula).
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import Rejected, choose_sheet, header_scores, headers, sheet_scores, unique_names

# Fixed values of the format.
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "dd/mm/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "dd/mm/yyyy hh:mm", 44: "$#,##0.00"}
#: Cells that a task gives on at a time.
CELLS_AT_A_TIME = 50_000
CELLS = "file string, sheet string, line long, col int, value string, excel_type string, number_format string, is_formula boolean"


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def cells(data: bytes) -> Iterator[tuple]:
    """All filled cells of a workbook: (sheet, line, col, value, type, number format, is formula); a formula's stored value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        text = lambda si: "".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t"))
        shared = [text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)] if "xl/sharedStrings.xml" in names else []
        formats = ["General"]
        if "xl/styles.xml" in names:
            style = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in style.findall("m:numFmts/m:numFmt", NS)}
            formats = [own.get(k) or BUILT_IN.get(k, "General") for k in (int(x.get("numFmtId", 0)) for x in style.findall("m:cellXfs/m:xf", NS))] or formats
        links = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS):
            target = links[sheet.get(f"{{{NS['r']}}}id")]
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, c in ET.iterparse(f):
                    if not c.tag.endswith("}c"):
                        continue
                    kind, v = c.get("t", "n"), c.find("m:v", NS)
                    value = text(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                    if value is not None:
                        at = c.get("r")
                        yield sheet.get("name"), int(re.search(r"\d+", at)[0]), column_number(at), value, {"s": "s", "inlineStr": "s", "str": "s", "b": "b", "e": "e", "d": "d"}.get(kind, "n"), formats[int(c.get("s", 0))], c.find("m:f", NS) is not None
                    c.clear()


def has_formulas(data: bytes) -> bool:
    """A cheap look for formulas before any sheet is parsed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return any(b"<f" in z.read(n) for n in z.namelist() if n.startswith("xl/worksheets/sheet"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of one workbook, or of all in a folder or pattern; a task per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = cells(bytes(content))
                while part := [(path, *c) for c in islice(found, CELLS_AT_A_TIME)]:
                    yield pd.DataFrame(part, columns=["file", "sheet", "line", "col", "value", "excel_type", "number_format", "is_formula"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


@dataclass(frozen=True)
class Located:
    """Where a table lies in a workbook: the sheet, its header and names, its last line, and how all sheets score."""

    sheet: str
    header_row: int
    names: list[str]
    last: int
    confidence: float
    alternatives: list[int]
    sheets: list[dict]


def located(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None) -> Located:
    """Unless named, the sheet is found by figures over all its cells and the header by the first rows and those that follow them."""
    found = read_cells(spark, path).persist()
    try:
        sheets = found.withColumn("at", F.monotonically_increasing_id()).groupBy("sheet").agg(F.max("col").alias("width"), F.max("line").alias("last"), F.min("at").alias("at"))
        best = headers(header_scores(found, sheets.select("sheet", "width")))
        scored = sheet_scores(found, sheets.select("sheet", "width"), best).join(sheets, "sheet").join(best, "sheet", "left").orderBy("at").collect()  # a row per sheet
        chosen = choose_sheet({r["sheet"]: r["score"] for r in scored}, sheet)
        told = next(r for r in scored if r["sheet"] == chosen)
        width, last, at = told["width"], told["last"], header_row if header_row is not None else told["header_row"] or 1
        if not 1 <= at <= last:
            raise Rejected(f"linha de cabecalho {at} fora da aba (ela tem {last} linhas)")
        header = {r["col"]: r["value"] for r in found.filter((F.col("sheet") == chosen) & (F.col("line") == at)).collect()}
    finally:
        found.unpersist()
    names = unique_names([header.get(k + 1) for k in range(width)])
    ranked = sorted(scored, key=lambda r: -r["score"])
    tables = [{"name": r["sheet"], "score": r["score"], "rows": r["last"], "cols": r["width"], "reason": r["reason"]} for r in ranked]
    sure, others = (1.0, []) if header_row is not None else (told["confidence"] or 0.0, list(told["alternatives"] or []))
    return Located(chosen, at, names, last, sure, others, tables)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None) -> DataFrame:
    """The table of one workbook: all cells as text and ``line``, as wide as its widest row."""
    at = located(spark, path, sheet, header_row)
    body = read_cells(spark, path).filter((F.col("sheet") == at.sheet) & (F.col("line") > at.header_row))
    return body.groupBy("line").agg(*(F.max(F.when(F.col("col") == k + 1, F.col("value"))).alias(n) for k, n in enumerate(at.names)))


def workbook(sheets: dict[str, tuple[Sequence[str], Sequence[Sequence]]]) -> bytes:
    """A workbook of small tables (header, rows), for reports that people open."""

    def sheet_xml(header: Sequence[str], rows: Sequence[Sequence]) -> str:
        out = []
        for i, row in enumerate([header, *rows], 1):
            made = []
            for k, v in enumerate(row, 1):
                at = f"{column_letters(k)}{i}"
                if isinstance(v, bool):
                    made.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    made.append(f'<c r="{at}"><v>{v!r}</v></c>')
                elif v is not None:
                    made.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>')
            out.append(f'<row r="{i}">{"".join(made)}</row>')
        return f'<worksheet xmlns="{NS["m"]}"><sheetData>{"".join(out)}</sheetData></worksheet>'

    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(made := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{rel}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}/relationships"><Relationship Id="rId1" Type="{NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{NS["r"]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (header, rows) in zip(n, sheets.values(), strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet_xml(header, rows))
    return made.getvalue()
