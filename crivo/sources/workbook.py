"""A sheet read with all that is known of it: types, conversions, warnings and how sure each choice is.

Rows stay in Spark. What comes to the driver is a row for each sheet, column and type, and the header.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import is_blank
from ..operators import profile
from . import tabular, xlsx
from .detect import Rejected

# Fixed value of the contract: the least confidence in a header.
MIN_HEADER = 0.45


@dataclass
class TableRead:
    """``raw`` has the cells as text and ``line``, ``typed`` their values, ``conversions`` rows (line, column, original, normalized, rule)."""

    source_file: str
    file_type: str
    raw: DataFrame | None = None
    typed: DataFrame | None = None
    conversions: DataFrame | None = None
    columns: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    sheets: list[dict] = field(default_factory=list)
    selected_sheet: str | None = None
    header_row: int | None = None
    header_confidence: float = 0.0
    header_alternatives: list[int] = field(default_factory=list)
    skipped_empty_rows: int = 0
    confidence: float = 0.0
    rejected_reason: str | None = None

    def reading(self) -> dict:
        """What a report tells of the file."""
        keep = ("source_file", "file_type", "selected_sheet", "header_row", "header_confidence", "header_alternatives", "confidence", "skipped_empty_rows", "warnings")
        return {k: getattr(self, k) for k in keep} | {"available_sheets": self.sheets}


def shown(value: Column, kind: Column, excel_type: Column, number_format: Column) -> Column:
    """A stored cell as text: day numbers with a date's format as dates, truth values in words."""
    date = parse.serial_date(value.try_cast("double"))
    text = F.when(kind == "data_hora", F.date_format(date, "dd/MM/yyyy HH:mm:ss")).when(kind == "data", F.date_format(date, "dd/MM/yyyy"))
    return F.when((excel_type == "n") & kind.isin("data", "data_hora"), F.coalesce(text, value)).when(excel_type == "b", F.when(value == "1", "True").otherwise("False")).otherwise(value)


def _sheet(spark: SparkSession, path: str, sheet: str | None, header_row: int | None, out: TableRead) -> tuple[DataFrame, list[str], dict[str, dict]]:
    """The sheet's rows, the names of its columns, and what their cells' stored types say: kinds, format, and marks of numbers kept as text."""
    at = xlsx.located(spark, path, sheet, header_row)
    out.sheets, out.selected_sheet, out.header_row, out.header_confidence, out.header_alternatives = at.sheets, at.sheet, at.header_row, at.confidence, at.alternatives
    sheet_sure = 1.0 if sheet is not None else next(s["score"] for s in at.sheets if s["name"] == at.sheet)
    out.confidence = round(min(sheet_sure, at.confidence), 3)
    kind = parse.sheet_cell_type(F.col("value"), F.col("excel_type"), F.col("number_format"))
    cells = xlsx.read_cells(spark, path).filter((F.col("sheet") == at.sheet) & (F.col("line") > at.header_row)).withColumn("kind", kind)
    cells = cells.withColumn("text", shown(F.col("value"), F.col("kind"), F.col("excel_type"), F.col("number_format")))
    filled = cells.filter(~is_blank(F.col("value")))
    comma, point = parse.decimal_mark_votes(F.col("value"))
    native = F.col("excel_type") == "n"
    told: dict[str, dict] = defaultdict(lambda: {"kinds": {}, "formats": set(), "native": 0, "written": 0, "comma": False, "point": False, "formulas": 0})
    votes = filled.groupBy("col", "kind", "number_format").agg(F.count("*").alias("n"), F.count_if(native).alias("native"), F.max(F.when(~native, comma)).alias("comma"), F.max(F.when(~native, point)).alias("point"), F.count_if("is_formula").alias("formulas"))
    for r in votes.collect():  # a row for each column, type and format
        if r["col"] > len(at.names):
            continue
        of = told[at.names[r["col"] - 1]]
        of["kinds"][r["kind"]] = of["kinds"].get(r["kind"], 0) + r["n"]
        of["formats"].add(r["number_format"])
        of["native"] += r["native"]
        of["written"] += r["n"] - r["native"]
        of["comma"], of["point"], of["formulas"] = of["comma"] or bool(r["comma"]), of["point"] or bool(r["point"]), of["formulas"] + r["formulas"]
    # a number that is stored as one has a point; it gets the mark of what is written beside it
    commas = [k for k, n in enumerate(at.names, 1) if told[n]["comma"]] if told else []
    text = F.when(native & F.col("col").isin(*commas) & F.col("kind").isin(*profile.NUMBERS), F.translate("text", ".", ",")).otherwise(F.col("text")) if commas else F.col("text")
    lines = cells.join(filled.select("line").distinct(), "line", "left_semi").groupBy("line")
    raw = lines.agg(*(F.max(F.when(F.col("col") == k + 1, text)).alias(n) for k, n in enumerate(at.names)))
    formulas = sum(t["formulas"] for t in told.values())
    if formulas:
        out.warnings.append({"code": "formulas", "message": f"{formulas} celula(s) continham formula; foi usado o valor calculado que estava salvo no arquivo", "row": None, "column": None})
    out.skipped_empty_rows = at.last - at.header_row
    return raw, at.names, told


def read_table(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None) -> TableRead:
    """Reads a delimited file or a workbook; what can't be read as a table is told in ``rejected_reason``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    ending = name[name.rfind(".") :].lower() if "." in name else ""
    out = TableRead(name, "xlsx" if ending.startswith(".xls") else "csv")
    told: dict[str, dict] = {}
    try:
        if ending == ".xls":
            raise Rejected("formato .xls antigo nao suportado: converta para .xlsx")
        if ending in (".xlsx", ".xlsm"):
            raw, names, told = _sheet(spark, path, sheet, header_row, out)
        elif ending in (".csv", ".tsv", ".txt"):
            found = tabular.sniff(spark, path, header_row)
            raw, names, out.selected_sheet = tabular.read_delimited(spark, path, found=found), found.names, "csv"
            out.header_row, out.header_confidence, out.header_alternatives, out.confidence = found.header_row, found.confidence, found.alternatives, found.confidence
            out.skipped_empty_rows = tabular.records(spark, path, found).filter(F.col("line") > found.header_row).count()
        else:
            raise Rejected(f"extensao nao suportada: {ending} (use .csv ou .xlsx)")
        if out.header_confidence < MIN_HEADER:
            raise Rejected("nenhuma linha de cabecalho plausivel")
    except Rejected as e:
        out.rejected_reason = str(e)
        return out
    figures = {r["column"]: r.asDict() for r in profile.column_figures(raw, names).collect()}
    if not figures:
        out.rejected_reason = "o cabecalho foi encontrado, mas nao ha nenhuma linha de dados abaixo dele"
        return out
    typings = {n: profile.decide(Row(**_by_stored_types(figures[n], told.get(n)))) for n in names}
    table = profile.table_figures(raw, names).first()
    out.raw = raw
    out.typed, out.conversions = profile.normalize(raw, typings)
    out.skipped_empty_rows -= table["rows"]
    samples = _samples(raw, names)
    formats = {n: next(iter(t["formats"])) for n, t in told.items() if len(t["formats"]) == 1}
    out.columns = [{"index": k, "name": n, "inferred_type": t.type, "type_confidence": round(t.confidence, 3), "observations": list(t.observations), "excel_number_format": formats.get(n), "sample_values": samples.get(n, []), "empty_count": figures[n]["empty"], "type_counts": t.counts} for k, (n, t) in enumerate(typings.items())]
    warn = lambda code, message, column=None, row=None: {"code": code, "message": message, "row": row, "column": column}
    if tabular.footer_like(raw, names):
        out.warnings.insert(0, warn("rodape_suspeito", "a ultima linha parece um rodape de totais (nao foi removida; confira antes de analisar)", row=raw.agg(F.max("line")).first()[0]))
    if out.skipped_empty_rows:
        out.warnings.append(warn("linhas_vazias_ignoradas", f"{out.skipped_empty_rows} linha(s) totalmente vazia(s) nao foram contadas como registro"))
    for n, t in typings.items():
        if t.type == "misto":
            out.warnings.append(warn("coluna_mista", f"coluna '{n}': {t.observations[0]}", n))
        if t.type == "erro":
            out.warnings.append(warn("erro_excel", f"coluna '{n}' contem valores de erro do Excel (#DIV/0!, #REF!...)", n))
    if table["duplicate_rows"]:
        out.warnings.append(warn("linhas_duplicadas", f"{table['duplicate_rows']} linha(s) completamente identica(s) a outra (nao foram removidas)"))
    out.warnings += [warn("coluna_vazia", f"coluna '{n}' esta vazia", n) for n, t in typings.items() if t.type == "vazio"]
    return out


def _by_stored_types(figures: dict, told: dict | None) -> dict:
    """A column's figures with the types that its cells are stored with; numbers that are stored as such are no identifiers."""
    if not told:
        return figures
    out = figures | {f"n_{k}": told["kinds"].get(k, 0) for k in profile.CELL_TYPES}
    if told["native"]:
        out |= {"leading_zero": False, "only_digits": False, "masked_digits": False, "comma_mark": told["comma"], "point_mark": not told["comma"]}
    return out


def _samples(raw: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The first filled cells of each column."""
    from ..operators.profile_state import _first

    heads = _first(profile.long_form(raw, names).filter(~is_blank(F.col("value"))).select("column", F.lit("filled").alias("kind"), "line", "value"))
    out: dict[str, list[str]] = {}
    for r in heads.orderBy("column", "line").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out
