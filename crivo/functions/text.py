"""Text expressions: trimming, cleaning, masking, templates. All are columns; none needs Python on executors."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text handling has it, for Java regular expressions and for RE2.
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_RE2 = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# What is masked in texts, in this order, and what with.
MASKS = (
    (r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b", "***.***.***-XX"),
    (r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}\b", "**.***.***/****-**"),
    (r"(?i)\b(password|pwd|senha)\s*[=:]\s*\S+", "$1=***"),
    (r"(?i)\b(token|api[_-]?key)\s*[=:]\s*\S+", "$1=***"),
    (r"(?i)Bearer\s+[a-zA-Z0-9_\-.]+", "Bearer ***"),
    (r"\b([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b", "$1***@$2"),
)

# A message's category is the first whose needle it contains.
CATEGORIES = (
    (("duplicad",), "duplicado"), (("obrigat",), "obrigatorio"), (("cpf",), "cpf"), (("cnpj",), "cnpj"), (("mail",), "email"), (("telefone",), "telefone"),
    (("curto",), "tamanho"), (("menor que", "maior que"), "intervalo"), (("aceitos",), "enum"), (("nao e um",), "tipo"), (("formato",), "formato"),
)


def cell_text(c: Column) -> Column:
    """A cell as text; null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), r"\A | \z", "")


def text_key(c: Column) -> Column:
    """What texts are compared by: stripped and in lower case."""
    return F.lower(strip(c))


def digits(c: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(c, "[^0-9]", "")


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches; a final line end is part of the text."""
    return c.rlike(rf"\A(?:{pattern})\z")


def mask_text(c: Column) -> Column:
    """Documents' numbers, secrets and e-mail names hidden."""
    for pattern, by in MASKS:
        c = F.regexp_replace(c, pattern, by)
    return c


def sanitize_stream(c: Column, root: str | None = None) -> Column:
    """A log line fit for display: no terminal codes, no absolute root, masked, without line ends."""
    c = F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", "")
    if root:
        base = re.escape(root.rstrip("/"))
        c = F.regexp_replace(c, rf"{base}[/\\]?", "")
    c = F.regexp_replace(c, r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b", "***.***.***-**")
    c = F.regexp_replace(c, r"(?i)\b(token|secret|api[_-]?key|password|senha)\b\s*[=:]\s*\S+", "$1=[REDACTED]")
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def message_category(c: Column) -> Column:
    """The category of a message that carries no code of its own."""
    low, out = F.lower(c), None
    for needles, name in CATEGORIES:
        hit = low.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | low.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("outro")


def render(template: str, columns: list[str]) -> Column:
    """``{column}`` filled in; an unknown or null column is empty; a malformed template is taken literally."""
    try:
        parts = list(Formatter().parse(template))
    except ValueError:
        return F.lit(template)
    out = []
    for literal, name, _, _ in parts:
        out.append(F.lit(literal))
        if name is not None:
            out.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in columns else F.lit(""))
    return F.concat(*out) if out else F.lit("")


def chat_id(c: Column) -> Column:
    """Stripped; ``111.0`` is ``111``; negative ids and @names stay."""
    return F.regexp_replace(strip(c), r"\A(-?[0-9]+)\.0+\z", "$1")


def truncated(c: Column, width: int = 15) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("~"))).otherwise(c)


def duration_text(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one decimal; null is a dash."""
    return F.when(ms.isNull(), F.lit("-")).when(ms < 1000, F.format_string("%.0f ms", ms.cast("double"))).otherwise(F.format_string("%.1f s", ms / 1000))


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def grouped_number(c: Column) -> Column:
    """Whole numbers with points between thousands."""
    return F.translate(F.format_number(c, 0), ",", ".")
