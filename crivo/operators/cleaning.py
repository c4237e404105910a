"""Safe normalisation of cells with a trail of what changed: one projection, and a filter for the trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import br
from ..functions.text import cell_text, collapse_spaces
from .rules import Schema


def steps(lowercase: bool = False, cpf: bool = False, cnpj: bool = False, phone: bool = False) -> list[tuple[str, object]]:
    chosen = (("espacos", collapse_spaces, True), ("minusculo", F.lower, lowercase), ("formato_cpf", br.format_cpf, cpf), ("formato_cnpj", br.format_cnpj, cnpj), ("formato_telefone", br.format_phone, phone))
    return [(name, fn) for name, fn, wanted in chosen if wanted]


def clean_cell(c: Column, **wanted: bool) -> tuple[Column, Column]:
    """The cleaned text, and the names of the rules that changed it."""
    value, fired = cell_text(c), []
    for name, fn in steps(**wanted):
        after = fn(value)
        fired.append(F.when(~after.eqNullSafe(value), F.lit(name)))
        value = after
    return value, F.array_compact(F.array(*fired))


def clean(df: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """The table with cleaned columns, and rows (line, column, original, cleaned, rules) of the cells that changed."""
    made, trail = {}, []
    for spec in schema.columns:
        if spec.name not in df.columns:
            continue
        raw = F.col(f"`{spec.name}`")
        value, fired = clean_cell(raw, lowercase=spec.format == "email", cpf=spec.validator_br == "cpf", cnpj=spec.validator_br == "cnpj", phone=spec.format == "phone")
        made[spec.name] = value
        trail.append(F.struct(F.lit(spec.name).alias("column"), cell_text(raw).alias("original"), value.alias("cleaned"), fired.alias("rules")))
    cleaned = df.withColumns(made)
    changes = df.select("line", F.explode(F.array(*trail)).alias("c")).select("line", "c.*").filter(F.size("rules") > 0)
    return cleaned, changes
