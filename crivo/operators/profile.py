"""Profiling: types and figures of all columns from two fused aggregates, findings as rows.

The figures of every column are one aggregate over the table (wide tables in runs of columns); the
top repeated values of a column are a grouped count. Exact distinct counts are grouped counts over
(column, value) pairs, which a hot value doesn't burden, as partial counts run before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import SPACE, cell_text, is_blank, strip

NUMBERS, DATES = ("moeda", "decimal", "inteiro", "percentual"), ("data", "data_hora")
CELL_TYPES = ("erro", "booleano", "data", "data_hora", "percentual", "moeda", "inteiro", "decimal", "texto")
SAMPLES, COLUMNS_AT_ONCE = 5, 40
MIN_FOR_CARDINALITY, MANY, FEW, HALF = 20, 0.9, 0.1, 0.5

SEVERITY = {"erro_excel": "problema", "coluna_mista": "aviso", "rodape_suspeito": "aviso", "linhas_duplicadas": "aviso", "formulas": "informacao", "coluna_vazia": "informacao", "linhas_vazias_ignoradas": "informacao"}


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (line?, column, value): every cell as text. One projection, no shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    keep = ["line"] if "line" in df.columns else []
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*")


def has_space_issue(c: Column) -> Column:
    """Space at an end, or two or more spaces inside."""
    return F.coalesce((strip(c) != c) | c.rlike(rf"\S{SPACE}{{2,}}\S"), F.lit(False))


def cell_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, n): how often each column has each value. Equal cells are counted before the shuffle."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_figures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``figures`` of a table's columns: one pass."""
    return figures(cell_counts(df, columns))


def figures(cells: DataFrame) -> DataFrame:
    """Per column: filled, empty, fill_rate, distinct_count, uniqueness_rate, surplus, space issues, sheet errors, and votes on types; each distinct value is judged once."""
    v, filled = F.col("value"), ~is_blank(F.col("value"))
    times = lambda test: F.sum(F.when(filled & test, F.col("n")).otherwise(0))
    t = strip(v)
    kind = parse.cell_type(v)
    comma, point = parse.decimal_mark_votes(v)
    every = [
        F.sum("n").alias("rows"), times(F.lit(True)).alias("filled"), F.count_if(filled).alias("distinct_count"),
        times(has_space_issue(v)).alias("space_issues"), times(parse.is_sheet_error(t)).alias("sheet_errors"),
        *(times(kind == k).alias(f"n_{k}") for k in CELL_TYPES),
        F.max(F.when(filled, t.rlike(r"\A0[0-9]+\z"))).alias("leading_zero"), F.min(F.when(filled, t.rlike(r"\A[0-9]+\z"))).alias("only_digits"),
        F.min(F.when(filled, F.length(t))).alias("min_length"), F.max(F.when(filled, F.length(t))).alias("max_length"),
        F.min(F.when(filled, t.rlike(parse.MASKED_DIGITS) & t.rlike(r"[.\-/]"))).alias("masked_digits"),
        F.max(F.when(filled, comma)).alias("comma_mark"), F.max(F.when(filled, point)).alias("point_mark"),
    ]
    out = cells.groupBy("column").agg(*every)
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return out.withColumns({"empty": F.col("rows") - F.col("filled"), "surplus": F.col("filled") - F.col("distinct_count"), "fill_rate": rate("filled", "rows"), "uniqueness_rate": rate("distinct_count", "filled")})


@dataclass(frozen=True)
class Typing:
    """What a column's figures say: its type, how sure, the decimal mark, and observations."""

    column: str
    type: str
    confidence: float
    decimal_mark: str
    observations: tuple[str, ...]
    counts: dict


def decide(row) -> Typing:
    """A column's type from its row of figures."""
    f = row.asDict()
    counts = {k: f[f"n_{k}"] for k in CELL_TYPES if f[f"n_{k}"]}
    if not f["filled"]:
        return Typing(f["column"], "vazio", 1.0, "", ("coluna inteiramente vazia",), {})
    if counts.get("inteiro") and counts.get("decimal"):
        counts["decimal"] += counts.pop("inteiro")
    mark = "," if f["comma_mark"] else "." if f["point_mark"] else ""
    top = max(counts.values())
    if len(counts) > 1:
        detail = ", ".join(f"{k}: {n}" for k, n in sorted(counts.items()))
        return Typing(f["column"], "misto", top / f["filled"], mark, (f"tipos misturados na coluna ({detail})",), counts)
    (kind,) = counts
    if kind in ("inteiro", "decimal", "texto"):
        reason = None
        if f["leading_zero"]:
            reason = "zero a esquerda"
        elif f["only_digits"] and f["min_length"] == f["max_length"] >= 4 and f["distinct_count"] / f["filled"] > HALF:
            reason = "digitos de comprimento fixo, valores quase todos distintos"
        elif f["masked_digits"]:
            reason = "mascara de digitos"
        if reason:
            return Typing(f["column"], "identificador", 1.0, "", (f"identificador ({reason}); preservado como texto",), counts)
    seen = ()
    if kind == "inteiro" and f["filled"] >= MIN_FOR_CARDINALITY and f["distinct_count"] / f["filled"] > HALF:
        seen = ("possivel identificador (alta cardinalidade, sem casas decimais)",)
    return Typing(f["column"], kind, 1.0, mark if kind in NUMBERS else "", seen, counts)


def infer(df: DataFrame, columns: Sequence[str]) -> dict[str, Typing]:
    """The types of all columns; one row per column comes to the driver."""
    return {row["column"]: decide(row) for row in column_figures(df, columns).collect()}


def typed_value(c: Column, typing: Typing) -> Column:
    """A cell's typed value; null where it can't be read, and text without blanks at its ends for all other types."""
    t = F.when(~is_blank(c), strip(c))
    if typing.type in DATES:
        return parse.parse_date(t)
    if typing.type in NUMBERS:
        return parse.parse_number(t, typing.decimal_mark)
    return parse.parse_bool(t) if typing.type == "booleano" else t


def _told(c: Column, value: Column, typing: Typing) -> tuple[Column, Column]:
    """A cell's text after conversion, from its typed value, and the rule that made it (null: none)."""
    t = F.when(~is_blank(c), strip(c))
    if typing.type in DATES:
        day, second = F.date_format(value, "yyyy-MM-dd"), F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(F.when(value == F.date_trunc("day", value), day).otherwise(second), t), F.when(value.isNotNull(), "data_texto")
    if typing.type in NUMBERS:
        rule = {"moeda": "moeda_br" if typing.decimal_mark == "," else "moeda_us", "percentual": "percentual_texto"}.get(typing.type, "numero_texto")
        return F.coalesce(parse.trimmed_number(value), t), F.when(value.isNotNull(), rule)
    if typing.type == "booleano":
        return F.coalesce(F.initcap(value.cast("string")), t), F.when(value.isNotNull(), "booleano_texto")
    return value, F.when(value != c, "espacos_nas_pontas")


def normalize(df: DataFrame, typings: dict[str, Typing]) -> tuple[DataFrame, DataFrame]:
    """The table with typed columns, and rows (line, column, original, normalized, rule) of the cells whose text changed.

    Each cell is read once, in a projection below the one that tells of it.
    """
    cell = {n: F.col(f"`{n}`").cast("string") for n in typings}
    values = {n: typed_value(cell[n], t) for n, t in typings.items()}
    typed = df.withColumns(values)
    read = df.select("line", F.struct(*(c.alias(f"c{k}") for k, c in enumerate(cell.values()))).alias("cells"), F.struct(*(v.alias(f"c{k}") for k, v in enumerate(values.values()))).alias("read"))
    trail = []
    for k, (n, t) in enumerate(typings.items()):
        text, rule = _told(F.col(f"cells.c{k}"), F.col(f"read.c{k}"), t)
        trail.append(F.struct(F.lit(n).alias("column"), F.col(f"cells.c{k}").alias("original"), text.alias("normalized"), rule.alias("rule")))
    changes = read.select("line", F.explode(F.array(*trail)).alias("c")).select("line", "c.*").filter("rule is not null and original <> normalized")
    return typed, changes


def min_max(df: DataFrame, columns: Sequence[str], typings: dict[str, Typing]) -> DataFrame:
    """Rows (column, min, max) as text of columns of numbers and dates; null for all others."""
    typed, _ = normalize(df, {c: typings[c] for c in columns})
    text = lambda c, t: parse.trimmed_number(c) if t in NUMBERS else F.date_format(c, "yyyy-MM-dd") if t in DATES else F.lit(None).cast("string")
    ends = [F.struct(F.lit(c).alias("column"), *(text(fn(F.col(f"`{c}`")), typings[c].type).alias(n) for n, fn in (("min", F.min), ("max", F.max)))) for c in columns]
    return typed.agg(F.array(*ends).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def top_repeated(df: DataFrame, column: str, n: int = SAMPLES) -> DataFrame:
    """Rows (value, times) of the values that occur most, twice at least; ties to the value that comes first."""
    v = F.col(f"`{column}`").cast("string")
    counted = df.select(v.alias("value"), "line").filter(~is_blank(F.col("value"))).groupBy("value").agg(F.count("*").alias("times"), F.min("line").alias("first"))
    return counted.filter("times > 1").orderBy(F.col("times").desc(), "first").limit(n).select("value", "times")


def first_samples(df: DataFrame, column: str, n: int = SAMPLES) -> DataFrame:
    """The first filled cells by line."""
    v = F.col(f"`{column}`").cast("string")
    return df.select("line", v.alias("value")).filter(~is_blank(F.col("value"))).orderBy("line").limit(n)


def table_figures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, cells, filled cells, fill rate, empty rows, and surplus of equal rows (by digest)."""
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    filled = reduce(lambda a, b: a + b, (F.when(~is_blank(c), 1).otherwise(0) for c in cells))
    key = F.sha2(F.to_json(F.array(*map(cell_text, cells))), 256)
    return table_of(df.select(filled.alias("filled"), key.alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.first("filled").alias("filled")), len(columns))


def table_of(grouped: DataFrame, width: int) -> DataFrame:
    """``table_figures`` from rows (key, n, filled): how often each row occurs, and its filled cells."""
    out = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("filled")), F.lit(0)).alias("filled_cells"), F.coalesce(F.sum(F.when(F.col("filled") == 0, F.col("n"))), F.lit(0)).alias("empty_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    total = F.col("rows") * width
    return out.withColumn("cells", total).withColumn("fill_rate", F.round(F.when(total > 0, F.col("filled_cells") / total).otherwise(0.0), 4))


def findings(figures: DataFrame) -> DataFrame:
    """Rows (column, code, severity, count) from the columns' figures."""
    kinds = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") > 0, F.lit("decimal" if k == "inteiro" else k)) for k in CELL_TYPES)))
    tests = (
        ("coluna_vazia", "informacao", F.col("filled") == 0, F.col("empty")),
        ("preenchimento_baixo", "aviso", (F.col("filled") > 0) & (F.col("fill_rate") < HALF), F.col("empty")),
        ("tipos_misturados", "aviso", F.size(F.array_distinct(kinds)) > 1, F.col("filled")),
        ("erro_excel", "problema", F.col("sheet_errors") > 0, F.col("sheet_errors")),
        ("espacos_extras", "aviso", F.col("space_issues") > 0, F.col("space_issues")),
        ("alta_cardinalidade", "informacao", (F.col("n_texto") == F.col("filled")) & (F.col("filled") >= MIN_FOR_CARDINALITY) & (F.col("uniqueness_rate") >= MANY), F.col("distinct_count")),
        ("baixa_cardinalidade", "informacao", (F.col("n_texto") == F.col("filled")) & (F.col("filled") >= MIN_FOR_CARDINALITY) & (F.col("uniqueness_rate") <= FEW), F.col("distinct_count")),
    )
    rows = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), count.alias("count"))) for code, severity, test, count in tests)))
    return figures.select("column", F.explode(rows).alias("f")).select("column", "f.*")


def preview(df: DataFrame, rows: int = 10, width: int = 15, columns: int = 8) -> DataFrame:
    """The first rows by line, of the first columns, with long cells cut."""
    from ..functions.text import truncated

    names = [c for c in df.columns if c != "line"][:columns]
    return df.orderBy("line").limit(rows).select(*(truncated(F.col(f"`{c}`").cast("string"), width).alias(c) for c in names))
