"""Expressions around HTTP deliveries: outcomes, external ids, keys, error texts, URL and name guards, hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

# Keys whose values are hidden wherever they occur in a name, and names that file systems reserve.
SENSITIVE = ("password", "passwd", "senha", "secret", "token", "api_key", "apikey", "auth", "authorization", "cpf", "cnpj", "rg", "credit_card", "card_number", "card", "private_key", "session_id", "access_key")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def status_category(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "sucesso")
        .when(status.isin(400, 422), "validacao")
        .when(status == 409, "duplicado")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "temporario")
        .otherwise("outro")
    )


def may_resend(status: Column) -> Column:
    """Whether a failure may go away by itself."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def external_id(body: Column) -> Column:
    """``id``, else ``record_id``, else ``data.id`` of a JSON object, if not blank."""
    paths = ("$.id", "$.record_id", "$.data.id")
    found = [F.get_json_object(body, p) for p in paths]
    return F.when(strip(body).startswith("{"), F.coalesce(*(F.when(strip(v) != "", v) for v in found)))


def error_text(body: Column) -> Column:
    """``error`` and its ``detalhes`` of a JSON object, or what there is of both, else the first 120 characters."""
    details = F.array_join(F.from_json(F.get_json_object(body, "$.detalhes"), T.ArrayType(T.StringType())), ", ")
    told = F.concat_ws(": ", *(F.nullif(x, F.lit("")) for x in (strip(F.get_json_object(body, "$.error")), details)))
    return F.when(strip(body).startswith("{") & (told != ""), told).otherwise(F.substring(body, 1, 120))


def canonical_json(columns: Sequence[str]) -> Column:
    """A JSON object of text columns with sorted keys, no spaces and ASCII escapes for quotes, backslashes and control characters."""

    def quoted(c: Column) -> Column:
        for raw, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(raw), F.lit(by))
        # beyond ASCII: UTF-16 units as \\uXXXX, as ASCII-only JSON has them
        units = F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "([0-9A-F]{4})", "$1 ")
        escaped = F.array_join(
            F.transform(F.filter(F.split(units, " "), lambda u: u != ""), lambda u: F.when(u.rlike("^00[2-7]"), F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), ""
        )
        return F.concat(F.lit('"'), F.when(c.rlike(r"[^\x20-\x7e]"), escaped).otherwise(c), F.lit('"'))

    pairs = [F.concat(F.lit(f'"{name}":'), quoted(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))) for name in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def idempotency_key(columns: Sequence[str]) -> Column:
    """The first 32 hex digits of the SHA-256 of the row's canonical JSON: the same row always has the same key."""
    return F.substring(F.sha2(canonical_json(columns), 256), 1, 32)


def hmac_sha256(c: Column, secret: str) -> Column:
    """HMAC from nested digests, so it stays in the JVM; without a secret the plain SHA-256."""
    if not secret:
        return F.sha2(c, 256)
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), c.cast("binary")), 256))), 256)


def masked_struct(schema: T.StructType, column: Column | None = None) -> list[Column]:
    """The columns of ``schema`` with every value under a sensitive name hidden, in nested structs as well."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if column is None else column[f.name]
        if any(s in f.name.lower() for s in SENSITIVE):
            c = F.lit("***")
        elif isinstance(f.dataType, T.StructType):
            c = F.struct(*masked_struct(f.dataType, c))
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.StringType):
            c = F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), "***").otherwise(v))
        out.append(c.alias(f.name))
    return out


def is_safe_url(c: Column, schemes: Sequence[str] = ("http", "https")) -> Column:
    """A known scheme, a host, and neither spaces nor control characters."""
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(scheme.isin(*schemes) & (host != "") & ~c.rlike(r"[\x00-\x20]"), F.lit(False))


def safe_filename(c: Column, longest: int = 255) -> Column:
    """A name without separators, control characters or reserved words; blank names are ``unnamed``."""
    t = F.regexp_replace(F.regexp_replace(c, r'[\x00-\x1f<>:"/\\|?*]', "_"), r"\A[. ]+|[. ]+\z", "")
    t = F.when(F.upper(F.regexp_extract(t, r"\A([^.]*)", 1)).isin(*RESERVED), F.concat(F.lit("_"), t)).otherwise(t)
    return F.when(F.coalesce(t, F.lit("")) == "", "unnamed").otherwise(F.substring(t, 1, longest))


def has_traversal(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(\A|[/\\])\.\.([/\\]|\z)") | c.contains("\x00"), F.lit(False))
