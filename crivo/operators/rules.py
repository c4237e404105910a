"""Declarative validation: a schema compiled to one column of issues, duplicates across rows, and the split by them.

A table has a column ``line`` (its physical line, header 1). All rules of all columns are one
projection; only duplicates need a shuffle, on the value's key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import br, parse
from ..functions.text import cell_text, digits, full_match, is_blank, strip, text_key

ISSUE = T.StructType([T.StructField(n, T.LongType() if n in ("line", "seq") else T.StringType()) for n in ("line", "column", "code", "message", "severity", "value", "seq")])
TYPES, FORMATS, DOCUMENTS = ("str", "int", "float", "date", "bool"), ("email", "phone"), ("cpf", "cnpj")


@dataclass(frozen=True)
class Rule:
    """A test that gives a message (null: passed). ``test`` is any function of a column, so users add rules of their own."""

    code: str
    test: Callable[[Column], Column]
    severity: str = "error"


@dataclass
class ColumnRules:
    name: str
    required: bool = True
    type: str = "str"
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    regex: str | None = None
    regex_message: str | None = None
    enum_values: list[str] | None = None
    validator_br: str | None = None
    format: str | None = None
    min_length: int | None = None
    unique: bool = False
    extra: Sequence[Rule] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for value, known in ((self.type, TYPES), (self.format or "email", FORMATS), (self.validator_br or "cpf", DOCUMENTS)):
            if value not in known:
                raise ValueError(f"column {self.name}: {value!r} is none of {known}")
        if self.min_value is not None and self.max_value is not None and self.min_value > self.max_value:
            raise ValueError(f"column {self.name}: min_value is above max_value")
        if self.regex is not None:
            re.compile(self.regex)

    def rules(self) -> list[Rule]:
        """In order: type, regex, range, enumeration, document number, format, length, and own rules."""
        out = []
        if self.type != "str":
            good = {"int": parse.is_int, "float": lambda c: parse.as_float(c).isNotNull(), "date": parse.is_iso_date, "bool": lambda c: F.lower(strip(c)).isin(*parse.SCHEMA_BOOLS)}[self.type]
            out.append(Rule("tipo", lambda c, good=good: F.when(~good(c), F.concat(F.lit("Valor '"), c, F.lit(f"' nao e um {self.type} valido")))))
        if self.regex is not None:
            out.append(Rule("formato", lambda c: F.when(~full_match(c, self.regex), F.lit(self.regex_message or "Valor fora do formato esperado"))))
        if self.min_value is not None or self.max_value is not None:
            out.append(Rule("intervalo", self._range))
        if self.enum_values is not None:
            out.append(Rule("enum", lambda c: F.when(~strip(c).isin(*self.enum_values), F.concat(F.lit("Valor '"), c, F.lit(f"' nao esta entre os aceitos: {self.enum_values}")))))
        for name, wanted, good, message in (
            ("cpf", self.validator_br == "cpf", br.is_cpf, "CPF invalido"),
            ("cnpj", self.validator_br == "cnpj", br.is_cnpj, "CNPJ invalido"),
            ("email", self.format == "email", lambda c: full_match(strip(c), parse.EMAIL), "E-mail invalido"),
            ("telefone", self.format == "phone", br.is_phone, "Telefone invalido"),
        ):
            if wanted:
                out.append(Rule(name, lambda c, good=good, message=message: F.when(~good(c), F.concat(F.lit(f"{message}: '"), c, F.lit("'")))))
        if self.min_length is not None:
            n = lambda c: F.length(strip(c))
            out.append(Rule("tamanho", lambda c: F.when(n(c) < self.min_length, F.concat(F.lit("Valor muito curto: '"), c, F.lit("' tem "), n(c).cast("string"), F.lit(f" caractere(s), minimo {self.min_length}")))))
        return [*out, *self.extra]

    def _range(self, c: Column) -> Column:
        x = parse.as_float(c)
        out = F.lit(None).cast("string")
        if self.max_value is not None:
            out = F.when(x > self.max_value, F.concat(F.lit("Valor "), c, F.lit(f" maior que o maximo {self.max_value}"))).otherwise(out)
        if self.min_value is not None:
            out = F.when(x < self.min_value, F.concat(F.lit("Valor "), c, F.lit(f" menor que o minimo {self.min_value}"))).otherwise(out)
        return out


@dataclass
class Schema:
    columns: list[ColumnRules]
    detect_duplicate_rows: bool = False

    @staticmethod
    def load(text: str) -> Schema:
        """From YAML: ``columns`` with the fields of ColumnRules, and ``detect_duplicate_rows``."""
        raw = yaml.safe_load(text) or {}
        if not isinstance(raw, dict) or not raw.get("columns"):
            raise ValueError("a schema needs columns")
        return Schema([ColumnRules(**c) for c in raw["columns"]], bool(raw.get("detect_duplicate_rows", False)))

    def missing(self, df: DataFrame) -> list[str]:
        """Required columns that the table lacks; no job runs for it."""
        return [c.name for c in self.columns if c.required and c.name not in df.columns]


def _issue(line: Column, name: str | None, code: str, message: Column, severity: str, value: Column, seq: int) -> Column:
    parts = (line.cast("long"), F.lit(name).cast("string"), F.lit(code), message, F.lit(severity), value, F.lit(seq).cast("long"))
    return F.struct(*(p.alias(f.name) for p, f in zip(parts, ISSUE.fields, strict=True)))


def cell_issues(schema: Schema, columns: Sequence[str]) -> Column:
    """An array of the issues of one row: a blank cell that may not be blank has that issue alone."""
    out, seq = [], 0
    for spec in schema.columns:
        if spec.name not in columns:
            continue
        raw = F.col(f"`{spec.name}`").cast("string")
        c, blank = cell_text(raw), is_blank(raw)
        if not spec.nullable:
            out.append(F.when(blank, _issue(F.col("line"), spec.name, "obrigatorio", F.lit("Valor obrigatorio nao informado"), "error", F.lit(None).cast("string"), seq)))
        for k, rule in enumerate(spec.rules()):
            message = rule.test(c)
            out.append(F.when(~blank & message.isNotNull(), _issue(F.col("line"), spec.name, rule.code, message, rule.severity, c, seq + k + 1)))
        seq += 100
    return F.array_compact(F.array(*out)) if out else F.array().cast(T.ArrayType(ISSUE))


#: Lines of a group of equal keys that are named.
LINES = 20


def duplicate_values(df: DataFrame, name: str, key: Callable[[Column], Column] = text_key, lines: int = LINES) -> DataFrame:
    """Rows (key, n, first, lines) of keys that occur twice or more; blank keys don't count. ``lines`` are the first of a group, as many as asked for (0: no such column)."""
    rows = _keyed(df, name, key)
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("first")).filter("n > 1")
    return groups.join(_first_lines(rows.join(groups.select("key"), "key"), lines), "key") if lines else groups


def duplicate_members(df: DataFrame, name: str, key: Callable[[Column], Column] = text_key) -> DataFrame:
    """Rows (key, line, n): every member of the groups of ``duplicate_values``."""
    rows = _keyed(df, name, key)
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key").select("key", "line", "n")


def _keyed(df: DataFrame, name: str, key: Callable[[Column], Column]) -> DataFrame:
    return df.select(key(cell_text(F.col(f"`{name}`"))).alias("key"), "line").filter(F.col("key") != "")


def _first_lines(rows: DataFrame, lines: int) -> DataFrame:
    """Rows (key, lines): the first lines of each key by rank, of which Spark keeps so many per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy("key").orderBy("line"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= lines).groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def duplicate_value_issues(df: DataFrame, spec: ColumnRules, seq: int = 10_000) -> DataFrame:
    """An error for every member of a group of equal keys. The message names up to 20 of the group's lines, so a hot key stays small."""
    key = digits if spec.validator_br else text_key
    rows = _keyed(df, spec.name, key)
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(groups, "key")
    some = _first_lines(members, LINES).select("key", F.array_join(F.transform("lines", lambda x: x.cast("string")), ", ").alias("where"))
    message = F.concat(F.lit(f"Valor duplicado na coluna '{spec.name}' (linhas "), F.col("where"), F.when(F.col("n") > LINES, F.concat(F.lit(" ... "), F.col("n").cast("string"), F.lit(" no total"))).otherwise(""), F.lit(")"))
    return members.join(some, "key").select(_issue(F.col("line"), spec.name, "duplicado", message, "error", F.lit(None).cast("string"), seq).alias("i")).select("i.*")


def duplicate_rows(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows (line, original, later): the members of groups of equal rows after their first. Only a digest of the row is shuffled."""
    cells = [cell_text(F.col(f"`{c}`")) if exact else text_key(cell_text(F.col(f"`{c}`"))) for c in columns]
    keyed = df.select("line", F.sha2(F.to_json(F.array(*cells)), 256).alias("key"), F.array_join(F.array(*cells), "").alias("all"))
    if not exact:
        keyed = keyed.filter("all <> ''")
    first = keyed.groupBy("key").agg(F.min("line").alias("original"), F.count("*").alias("n")).filter("n > 1")
    return keyed.drop("all").join(first, "key").filter("line <> original").select("line", "original")


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """All issues of a table: line, column, code, message, severity, value, seq. Missing required columns are one issue each, and then the only ones."""
    spark = df.sparkSession
    if missing := schema.missing(df):
        return spark.createDataFrame([(1, n, "coluna", f"Coluna obrigatoria ausente: {n}", "error", None, k) for k, n in enumerate(missing)], ISSUE)
    issues = df.select(F.explode(cell_issues(schema, df.columns)).alias("i")).select("i.*")
    for k, spec in enumerate(schema.columns):
        if spec.unique and spec.name in df.columns:
            issues = issues.unionByName(duplicate_value_issues(df, spec, 10_000 + k))
    if schema.detect_duplicate_rows:
        message = F.concat(F.lit("Linha duplicada (identica a linha "), F.col("original").cast("string"), F.lit(")"))
        again = duplicate_rows(df, [c for c in df.columns if c != "line"])
        issues = issues.unionByName(again.select(_issue(F.col("line"), None, "linha_duplicada", message, "warning", F.lit(None).cast("string"), 20_000).alias("i")).select("i.*"))
    return issues


def by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity)


def category_counts(issues: DataFrame) -> DataFrame:
    """Issues per code, with the first in order of line."""
    return issues.groupBy("code").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def totals(df: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: rows, errors, warnings, invalid and valid rows."""
    per_line = issues.groupBy("line").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    found = per_line.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.count_if((F.col("e") > 0) & (F.col("line") >= 2)).alias("invalid"))
    return df.agg(F.count("*").alias("n_rows")).crossJoin(found).withColumn("valid", F.col("n_rows") - F.col("invalid"))


def error_lines(issues: DataFrame) -> DataFrame:
    """Rows (line, motivo): the messages of a line's errors in order, parted by bars."""
    errors = issues.filter((F.col("severity") == "error") & (F.col("line") >= 2))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "message")))
    return errors.groupBy("line").agg(F.array_join(F.transform(ordered, lambda x: x["message"]), " | ").alias("motivo"))


def split(df: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (no error on their line), and invalid rows with ``motivo``."""
    bad = error_lines(issues)
    return df.join(bad, "line", "left_anti"), df.join(bad, "line")
