"""Classifying and parsing text cells: types, numbers, dates, booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Literals that spreadsheets write for errors, words for booleans, currency signs, date patterns.
SHEET_ERRORS = ("#DIV/0!", "#N/A", "#N/D", "#NAME?", "#NOME?", "#NULL!", "#NULO!", "#NUM!", "#NUM.!", "#REF!", "#VALUE!", "#VALOR!")
TRUE_WORDS, FALSE_WORDS = ("sim", "true", "verdadeiro", "v", "yes", "y", "s"), ("nao", "não", "false", "falso", "f", "no", "n")
SCHEMA_BOOLS = ("true", "false", "sim", "nao", "yes", "no", "1", "0")
CURRENCIES = ("R$", "US$", "$", "€", "£")
TIME = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?"
DAY_FIRST = r"\A([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})\z"
YEAR_FIRST = r"\A([0-9]{4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,2})\z"
NUMERIC = r"\A[+-]?[0-9.,]*[0-9]\z"
MASKED_DIGITS = r"\A[0-9][0-9.\-/ ]*[0-9]\z"
DAY_OF_DATE = r"\A([0-9]{1,2})([/.-])([0-9]{1,2})\2((?!0000)[0-9]{4})\z"
YEAR_OF_DATE = r"\A((?!0000)[0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})\z"
CLOCK = r"\A(?:[0-9/]+/[0-9]{4}|[0-9]{4}-[0-9-]+)( [0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?)\z"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SERIAL_MIN, SERIAL_MAX = 1, 2_958_465
SERIAL_LIKELY = (36_526, 54_789)


def _quoted(sign: str) -> str:
    return sign.replace("$", r"\$")


def has_currency(c: Column) -> Column:
    return F.upper(c).rlike(rf"\A(?:{'|'.join(map(_quoted, CURRENCIES))})|(?:{'|'.join(map(_quoted, CURRENCIES))})\z")


def strip_currency(c: Column) -> Column:
    """Without the first currency sign that opens or closes the text."""
    up, out = F.upper(c), None
    for sign in CURRENCIES:
        s = _quoted(sign)
        cut = strip(F.regexp_replace(up, rf"\A{s}|{s}\z", ""))
        hit = up.rlike(rf"\A{s}|{s}\z")
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def date_kind(c: Column) -> Column:
    """``data``, ``data_hora`` or null: a shape with a month to 12 and a day to 31, without a calendar."""
    timed = c.rlike(TIME)
    base = F.when(timed, strip(F.regexp_replace(c, TIME, ""))).otherwise(c)
    out = F.lit(None).cast("string")
    for pattern, day in ((DAY_FIRST, 1), (YEAR_FIRST, 3)):
        d, m = F.regexp_extract(base, pattern, day).try_cast("int"), F.regexp_extract(base, pattern, 2).try_cast("int")
        out = F.when(base.rlike(pattern) & m.between(1, 12) & d.between(1, 31), F.when(timed, "data_hora").otherwise("data")).otherwise(out)
    return out


def is_sheet_error(c: Column) -> Column:
    return F.upper(c).isin(*SHEET_ERRORS)


def cell_type(text: Column) -> Column:
    """The type of one text cell, blank cells ``vazio``; the first rule that fits decides."""
    t = strip(text)
    unsigned = F.regexp_replace(t, r"\A[+-]+", "")
    return (
        F.when(t.isNull() | (t == ""), "vazio")
        .when(is_sheet_error(t), "erro")
        .when(F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS), "booleano")
        .when(date_kind(t).isNotNull(), date_kind(t))
        .when(t.endswith("%") & strip(F.regexp_replace(t, r"%\z", "")).rlike(NUMERIC), "percentual")
        .when(has_currency(t) & F.regexp_replace(strip_currency(t), " ", "").rlike(NUMERIC), "moeda")
        .when(t.rlike(NUMERIC), F.when(unsigned.rlike(r"\A[0-9]+\z"), "inteiro").otherwise("decimal"))
        .otherwise("texto")
    )


def sheet_cell_type(value: Column, excel_type: Column, number_format: Column) -> Column:
    """The type of a spreadsheet cell, from its stored type and number format first."""
    form = F.lower(F.coalesce(number_format, F.lit("General")))
    dated = F.regexp_replace(form, r"\[[^\]]*\]|\"[^\"]*\"", "")
    return (
        F.when(F.coalesce(strip(value), F.lit("")) == "", "vazio")
        .when(excel_type == "e", "erro")
        .when(excel_type == "b", "booleano")
        .when((excel_type == "d") | ((excel_type == "n") & dated.rlike("[dy]")), F.when(dated.rlike("h"), "data_hora").otherwise("data"))
        .when((excel_type == "n") & form.contains("%"), "percentual")
        .when((excel_type == "n") & form.rlike(r"r\$|\$|€|£"), "moeda")
        .when(excel_type == "n", F.when(value.rlike(r"\A-?[0-9]+(\.0+)?\z"), "inteiro").otherwise("decimal"))
        .otherwise(cell_type(value))
    )


def decimal_mark_votes(c: Column) -> tuple[Column, Column]:
    """Whether a cell shows the comma, or the point, to be the decimal mark: other than three digits follow the last one."""
    t = F.regexp_replace(strip_currency(strip(F.regexp_replace(c, "%", ""))), " ", "")
    vote = lambda mark: F.coalesce(t.rlike(rf"{mark}(?:[0-9]{{1,2}}|[0-9]{{4,}})\z"), F.lit(False))
    return vote(","), vote(r"\.")


def parse_number(c: Column, decimal_mark: str) -> Column:
    """A number whose column's decimal mark is ``,``, ``.`` or none (then both part thousands); percent signs fall away."""
    t = F.regexp_replace(strip_currency(strip(c)), "[% ]", "")
    negative = t.startswith("-")
    t = F.regexp_replace(t, r"\A[+-]+", "")
    if decimal_mark == ",":
        t = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    elif decimal_mark == ".":
        t = F.regexp_replace(t, ",", "")
    else:
        t = F.regexp_replace(t, "[.,]", "")
    number = F.when(t.rlike(r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), t.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def parse_date(c: Column) -> Column:
    """A timestamp without zone from text, by the calendar; null if no format fits.

    The day is what stands before the first space; a time counts after a day with slashes, or a year
    with hyphens, and is left out where the clock has no such time. One pattern puts a text's parts in
    order and one cast reads them, so that no format is tried in vain.
    """
    t = strip(c)
    first = F.regexp_extract(t, r"\A([^ ]*)", 1)
    day = F.when(first.rlike(DAY_OF_DATE), F.regexp_replace(first, DAY_OF_DATE, "$4-$3-$1")).when(first.rlike(YEAR_OF_DATE), F.regexp_replace(first, YEAR_OF_DATE, "$1-$3-$4"))
    timed = F.when(t.rlike(CLOCK), F.concat(day, F.regexp_extract(t, CLOCK, 1)).try_cast("timestamp_ntz"))
    return F.coalesce(timed, day.try_cast("timestamp_ntz"))


def serial_date(n: Column) -> Column:
    """A spreadsheet's day number as a timestamp, within the range that is taken for dates."""
    day = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
    return F.when(n.between(SERIAL_MIN, SERIAL_MAX), day + F.make_dt_interval(F.floor(n).cast("int"), F.lit(0), F.lit(0), ((n - F.floor(n)) * 86400).cast("decimal(18,6)")))


def parse_bool(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin(*TRUE_WORDS, "1"), True).when(t.isin(*FALSE_WORDS, "0"), False)


def is_int(c: Column) -> Column:
    return strip(c).rlike(r"\A[+-]?[0-9]+\z")


def as_float(c: Column) -> Column:
    """A number with a comma or a point; null if it is none."""
    t = F.translate(strip(c), ",", ".")
    return F.when(t.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))


def is_iso_date(c: Column) -> Column:
    t = strip(c)
    shape = t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\z")
    return shape & F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()


def retry_after(c: Column) -> Column:
    """Whole seconds; other forms are null."""
    t = strip(c)
    return F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("double"))


def trimmed_number(c: Column) -> Column:
    """A double as text, without a fraction where it has none."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
