"""Brazilian document and telephone numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits

# Weights of the check digits, and the area codes in use.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
AREA_CODES = (
    "11 12 13 14 15 16 17 18 19 21 22 24 27 28 31 32 33 34 35 37 38 41 42 43 44 45 46 47 48 49 51 53 54 55 61 62 63 64 65 66 67 68 69 "
    "71 73 74 75 77 79 81 82 83 84 85 86 87 88 89 91 92 93 94 95 96 97 98 99"
).split()


def check_digit(number: Column, weights: tuple[int, ...]) -> Column:
    """The mod-11 check digit of the first digits of ``number``: 0 for remainders below 2, else 11 less the remainder."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.coalesce(F.substring(number, k + 1, 1).try_cast("int"), F.lit(0)) * w
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _numbered(c: Column, size: int, weights: tuple) -> Column:
    d = digits(c)
    good = (F.length(d) == size) & ~d.rlike(r"\A([0-9])\1*\z")
    for k, w in enumerate(weights):
        good = good & (F.substring(d, size - 1 + k, 1).try_cast("int") == check_digit(d, w))
    return F.coalesce(good, F.lit(False))


def is_cpf(c: Column) -> Column:
    """Eleven digits, not all alike, with both check digits right."""
    return _numbered(c, 11, CPF_WEIGHTS)


def is_cnpj(c: Column) -> Column:
    """Fourteen digits, not all alike, with both check digits right."""
    return _numbered(c, 14, CNPJ_WEIGHTS)


def national_phone(c: Column) -> Column:
    """Digits without the country's code."""
    d = digits(c)
    return F.when(F.length(d).isin(12, 13) & d.startswith("55"), F.substring(d, 3, 11)).otherwise(d)


def is_phone(c: Column) -> Column:
    """A known area code and a mobile (nine digits from 9) or land line (eight from 2 to 5)."""
    d = national_phone(c)
    third = F.substring(d, 3, 1)
    kind = ((F.length(d) == 11) & (third == "9")) | ((F.length(d) == 10) & third.between("2", "5"))
    return F.coalesce(F.substring(d, 1, 2).isin(*AREA_CODES) & kind, F.lit(False))


def format_cpf(c: Column) -> Column:
    """With the usual mask if valid, else as it is."""
    return F.when(is_cpf(c), F.regexp_replace(digits(c), r"\A(...)(...)(...)(..)\z", r"$1.$2.$3-$4")).otherwise(c)


def format_cnpj(c: Column) -> Column:
    return F.when(is_cnpj(c), F.regexp_replace(digits(c), r"\A(..)(...)(...)(....)(..)\z", r"$1.$2.$3/$4-$5")).otherwise(c)


def format_phone(c: Column) -> Column:
    return F.when(is_phone(c), F.regexp_replace(national_phone(c), r"\A(..)([0-9]+)([0-9]{4})\z", r"($1) $2-$3")).otherwise(c)
