"""Writing results: tables by extension, split and report artefacts, archives, a dashboard page.

Data goes out through Spark's writers. What a person opens (workbook, JSON report, page) is small
by construction and written by the driver.
"""

from __future__ import annotations

import hashlib
import html
import json
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .xlsx import workbook

#: Rows that a workbook or a page takes from a table; the full table is beside it.
REPORT_ROWS = 10_000


def flat(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with nested columns as JSON where the kind of file has none."""
    return df.select(*(F.to_json(f"`{c}`").alias(c) if kind == "csv" and t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes))


def save(df: DataFrame, path: str) -> None:
    """A folder of part files of the kind that the extension names: .csv, .json, .parquet; .xlsx is one workbook of up to REPORT_ROWS rows."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"a workbook takes {REPORT_ROWS} rows; write .csv or .parquet")
        Path(path).write_bytes(workbook({"Dados": (df.columns, [list(r) for r in rows])}))
    elif kind in ("csv", "json", "parquet"):
        flat(df, kind).write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def write_split(valid: DataFrame, invalid: DataFrame, folder: str) -> None:
    save(valid, f"{folder}/registros_validos.csv")
    save(invalid, f"{folder}/registros_invalidos.csv")


def write_validation(totals: DataFrame, valid: DataFrame, invalid: DataFrame, issues: DataFrame, folder: str, run: dict | None = None) -> None:
    """The split, all issues, a JSON report (what is known of the run, the totals, the first REPORT_ROWS issues), and a workbook of four sheets with the first REPORT_ROWS rows of each by line; its summary says how many rows each sheet leaves out."""
    heads = {
        "Registros validos": saved(valid, f"{folder}/registros_validos.csv"),
        "Registros invalidos": saved(invalid, f"{folder}/registros_invalidos.csv"),
        "Auditoria": saved(issues, f"{folder}/problemas.csv"),
    }
    told = totals.first().asDict()
    listed = [dict(zip(issues.columns, r, strict=True)) for r in heads["Auditoria"][0]]
    write_json((run or {}) | told | {"issues": listed, "issues_omitidas": heads["Auditoria"][1] - len(listed)}, f"{folder}/relatorio.json")
    write_workbook(told, {n: (df.columns, *heads[n]) for n, df in (("Registros validos", valid), ("Registros invalidos", invalid), ("Auditoria", issues))}, folder)


def saved(df: DataFrame, path: str) -> tuple[list[list], int]:
    """``df`` written by ``save``; its first REPORT_ROWS rows by line, and how many it has.

    The rows are counted as they are written, and the first ones are read back from what was written (empty text as none), so that
    ``df`` is worked out once.
    """
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    back = df.sparkSession.read.options(header="true", multiLine="true").schema(flat(df, "csv").schema).csv(path)
    order = [c for c in ("line", "linha", "seq") if c in df.columns]
    return [list(r) for r in (back.orderBy(*order) if order else back).limit(REPORT_ROWS).collect()], seen.get["n"]


def write_json(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, default=str, indent=2, ensure_ascii=False), "utf-8")


def write_workbook(told: dict, sheets: dict[str, tuple[list, list, int]], folder: str) -> None:
    """A summary, and sheets from (columns, first rows, rows in all); the summary says how many rows each sheet leaves out."""
    left_out = [[f"Omitidos: {n}", count - len(rows)] for n, (_, rows, count) in sheets.items() if count > len(rows)]
    summary = [list(x) for x in told.items()] + left_out
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "relatorio.xlsx").write_bytes(workbook({"Resumo": (["campo", "valor"], summary)} | {n: (columns, rows) for n, (columns, rows, _) in sheets.items()}))


def write_delivery(sent: DataFrame, failed: DataFrame, rolled: DataFrame, folder: str, details: DataFrame | None = None, run: dict | None = None) -> None:
    """What went out, what didn't (fit to be sent again), a JSON report with what is known of the run, and a workbook: summary, sent, failed, and ``details`` (a row per line and outcome), the first REPORT_ROWS rows of each."""
    tables = {"Enviados": (sent, "enviados.csv"), "Falhas": (failed, "falhas.csv")} | ({"Detalhes": (details, "detalhes.csv")} if details is not None else {})
    heads = {n: (df.columns, *saved(df, f"{folder}/{file}")) for n, (df, file) in tables.items()}
    told = (run or {}) | rolled.first().asDict()
    write_json(told, f"{folder}/relatorio.json")
    write_workbook(told, heads, folder)


def write_extract(df: DataFrame, folder: str, source: str, pages: int, duration_ms: int) -> None:
    """The rows, a JSON report, and a workbook of a summary and the first REPORT_ROWS rows."""
    rows, n = saved(df, f"{folder}/dados.csv")
    report = {"total_registros": n, "paginas": pages, "colunas": df.columns, "origem": source, "duracao_ms": duration_ms}
    write_json(report, f"{folder}/relatorio.json")
    write_workbook({k: v for k, v in report.items() if k != "colunas"}, {"Dados": (df.columns, rows, n)}, folder)


def write_profile(report: dict, path: str) -> None:
    """What ``profile_state.report`` gives, as a JSON file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n", "utf-8")


def first_issues(issues: DataFrame, n: int = 20) -> tuple[list, int]:
    """The first n issues by line, and how many more there are."""
    return issues.orderBy("line", "seq").limit(n).collect(), max(0, issues.count() - n)


def dashboard(entries: DataFrame, summary: DataFrame, limit: int = 100) -> str:
    """A page of the latest entries and the summary; every value escaped."""

    def part(df: DataFrame) -> str:
        cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
        rows = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.collect())
        return "<table><tr>" + "".join(cell("th", c) for c in df.columns) + f"</tr>{rows}</table>"

    return f"<!doctype html><meta charset='utf-8'><title>Painel</title><h1>Resumo</h1>{part(summary.limit(limit))}<h1>Execucoes</h1>{part(entries.orderBy(F.col('id').desc()).limit(limit))}"


def formatted(df: DataFrame, kind: str, limit: int = 1000) -> str:
    """A bounded result as a text table, JSON or CSV for a console."""
    rows = [r.asDict() for r in df.limit(limit).collect()]
    if kind == "json":
        return json.dumps(rows, default=str, ensure_ascii=False, indent=2)
    lines: Iterable[Sequence] = [df.columns, *([("" if v is None else str(v)) for v in r.values()] for r in rows)]
    if kind == "csv":
        import csv
        import io

        csv.writer(out := io.StringIO()).writerows(lines)
        return out.getvalue()
    lines = list(lines)
    widths = [max(len(str(r[k])) for r in lines) for k in range(len(df.columns))]
    return "\n".join("  ".join(str(v).ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in lines)


def archive(files: Iterable[str], path: str) -> str:
    """A zip of local files; its SHA-256."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for f in sorted(files):
            z.write(f, Path(f).name)
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
