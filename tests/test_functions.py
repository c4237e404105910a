"""Expressions against plain Python and against values worked out by hand."""

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions import br, parse, text, web


def values(spark, cells, *fns):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = df.select("i", *(fn(F.col("c")).alias(f"v{k}") for k, fn in enumerate(fns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(fns) > 1 else r[1] for r in rows]


SPACED = ["  Ana   Lima ", "x", "", None, "\t a  b　", "\x1ca\x1f", "a\nb", " "]


def test_space_handling(spark):
    got = values(spark, SPACED, text.strip, text.collapse_spaces, text.is_blank)
    for cell, (stripped, collapsed, blank) in zip(SPACED, got, strict=True):
        assert stripped == (None if cell is None else cell.strip())
        assert collapsed == (None if cell is None else " ".join(cell.split()))
        assert blank == (not (cell or "").strip())


def plain_digit(d, weights):
    r = sum(int(x) * w for x, w in zip(d, weights, strict=False)) % 11
    return 0 if r < 2 else 11 - r


def plain_document(cell, size, weights):
    d = re.sub("[^0-9]", "", cell or "")
    return len(d) == size and len(set(d)) > 1 and all(int(d[size - 2 + k]) == plain_digit(d, w) for k, w in enumerate(weights))


def test_document_numbers(spark):
    base = [f"{k * 7919 % 10**9:09d}" for k in range(300)]
    cpfs = [b + str(a := plain_digit(b, br.CPF_WEIGHTS[0])) + str(plain_digit(b + str(a), br.CPF_WEIGHTS[1])) for b in base]
    cells = cpfs + ["529.982.247-25", "111.111.111-11", "123", None, "", *[c[:-1] + str((int(c[-1]) + 1) % 10) for c in cpfs[:50]]]
    got = values(spark, cells, br.is_cpf, br.format_cpf)
    for cell, (ok, shown) in zip(cells, got, strict=True):
        assert ok == plain_document(cell, 11, br.CPF_WEIGHTS)
        assert shown == (re.sub(r"^(...)(...)(...)(..)$", r"\1.\2.\3-\4", re.sub("[^0-9]", "", cell)) if ok else cell)
    assert sum(ok for ok, _ in got) >= 300
    assert values(spark, ["11.222.333/0001-81", "11222333000182", None], br.is_cnpj) == [True, False, False]
    assert values(spark, ["11222333000181"], br.format_cnpj) == ["11.222.333/0001-81"]


@pytest.mark.parametrize(
    "cell,ok,shown",
    [
        ("(11) 98765-4321", True, "(11) 98765-4321"), ("+55 11 98765-4321", True, "(11) 98765-4321"), ("1133334444", True, "(11) 3333-4444"),
        ("11 8765-4321", False, "11 8765-4321"), ("20987654321", False, "20987654321"), ("1163334444", False, "1163334444"), (None, False, None),
    ],
)
def test_phones(spark, cell, ok, shown):
    assert values(spark, [cell], br.is_phone, br.format_phone) == [(ok, shown)]


CELLS = {
    "": "vazio", None: "vazio", "  ": "vazio", "#DIV/0!": "erro", "#n/d": "erro", "Sim": "booleano", "não": "booleano", "01/12/2019": "data", "2019-12-01": "data", "1.12.2019": "data",
    "31/02/2019": "data", "32/01/2019": "texto", "01/13/2019": "texto", "01/12/2019 14:30": "data_hora", "12%": "percentual", "1,5 %": "percentual", "R$ 1.234,56": "moeda", "US$ 3": "moeda",
    "10 €": "moeda", "£": "texto", "123": "inteiro", "-5": "inteiro", "1": "inteiro", "1.234": "decimal", "10,25": "decimal", "1,": "texto", "abc": "texto", "12a": "texto",
}


def test_cell_types(spark):
    assert dict(zip(CELLS, values(spark, list(CELLS), parse.cell_type), strict=True)) == CELLS


def test_numbers(spark):
    for mark, cells in {",": {"R$ 1.234,56": 1234.56, "-10,5": -10.5, "12%": 12.0, "1.000": 1000.0, "x": None, "": None}, ".": {"$1,234.56": 1234.56, "1e3": None}, "": {"1.234": 1234.0, "1,234": 1234.0, "+7": 7.0}}.items():
        assert values(spark, list(cells), lambda c, mark=mark: parse.parse_number(c, mark)) == list(cells.values())
    votes = values(spark, ["10,25", "1.234", "1.234,56", "1.5", "R$ 2,5%"], lambda c: F.array(*parse.decimal_mark_votes(c)))
    assert votes == [[True, False], [False, False], [True, False], [False, True], [True, False]]


def test_dates_follow_the_calendar_in_every_form(spark):
    cases = {
        "1/2/2020 3:4": "2020-02-01 03:04:00", "01/02/2020 03:04:05": "2020-02-01 03:04:05", "2020-2-1 3:4:5": "2020-02-01 03:04:05",
        "1.2.2020": "2020-02-01 00:00:00", "1-2-2020 10:00": "2020-02-01 00:00:00", "2020/2/1 10:00": "2020-02-01 00:00:00",
        "01/02/2020 25:00": "2020-02-01 00:00:00", "01/02/2020 foo": "2020-02-01 00:00:00", " 29/02/2024 ": "2024-02-29 00:00:00",
        "29/02/2023": None, "1/2-2020": None, "2020.2.1": None, "1/13/2020": None, "0/1/2020": None, "01/02/0000": None, "01/02/20": None, "": None, None: None,
    }
    assert values(spark, list(cases), lambda c: parse.parse_date(c).cast("string")) == list(cases.values())


def test_dates_bools_and_floats(spark):
    got = values(spark, ["01/12/2019", "2019-12-01 14:30", "31/02/2019", "1-2-2020", "2020/3/4", "x"], lambda c: parse.parse_date(c).cast("string"))
    assert got == ["2019-12-01 00:00:00", "2019-12-01 14:30:00", None, "2020-02-01 00:00:00", "2020-03-04 00:00:00", None]
    assert values(spark, ["SIM", " 1", "n", "0", "talvez"], parse.parse_bool) == [True, True, False, False, None]
    assert values(spark, ["34", "+5", "12.5", "1_000", " 7 "], parse.is_int) == [True, True, False, False, True]
    assert values(spark, ["1,5", ".5", "1e3", "abc", "5."], parse.as_float) == [1.5, 0.5, 1000.0, None, 5.0]
    assert values(spark, ["2024-01-05", "2024-1-5", "2024-02-30", "2024-01-05T10:00"], parse.is_iso_date) == [True, False, False, True]
    assert values(spark, ["43800"], lambda c: parse.serial_date(c.cast("double")).cast("string")) == ["2019-12-01 00:00:00"]
    assert values(spark, ["2", " 3 ", "1.5", "Wed"], parse.retry_after) == [2.0, 3.0, None, None]


def test_sheet_cells(spark):
    rows = [("43800", "n", "dd/mm/yyyy", "data"), ("0.12", "n", "0%", "percentual"), ("5", "n", "R$ #,##0", "moeda"), ("5", "n", None, "inteiro"), ("5.5", "n", "General", "decimal"), ("#REF!", "e", None, "erro"), ("1", "b", None, "booleano"), ("sim", "s", None, "booleano"), (None, "n", None, "vazio"), ("43800.5", "n", "dd/mm/yyyy hh:mm", "data_hora")]
    df = spark.createDataFrame(rows, "v string, t string, f string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", parse.sheet_cell_type(F.col("v"), F.col("t"), F.col("f")).alias("got")).collect())


def test_masks(spark):
    cells = {"CPF: 123.456.789-00": "CPF: ***.***.***-XX", "user paulo@gmail.com": "user p***@gmail.com", "password=segredo123 x": "password=*** x", "API-KEY: abc": "API-KEY=***", "Bearer a.b-c": "Bearer ***", "12.345.678/0001-90": "**.***.***/****-**", "nada": "nada"}
    assert values(spark, list(cells), text.mask_text) == list(cells.values())
    assert values(spark, ["\x1b[31merro\x1b[0m /srv/app/x token=abc\n"], lambda c: text.sanitize_stream(c, "/srv/app")) == ["erro x token=[REDACTED]"]


def test_templates_ids_and_categories(spark):
    df = spark.createDataFrame([("Ana", None)], "nome string, saldo string")
    assert df.select(text.render("Ola {nome}: {saldo}{x} {{ok}}", df.columns), text.render("{quebrado", df.columns)).first() == ("Ola Ana:  {ok}", "{quebrado")
    assert values(spark, ["111.0", " -5", "@nome", "1.5"], text.chat_id) == ["111", "-5", "@nome", "1.5"]
    assert values(spark, ["Valor duplicado na coluna 'cpf'", "CPF invalido", "nada"], text.message_category) == ["duplicado", "cpf", "outro"]
    assert values(spark, ["250", "1500", None], lambda c: text.duration_text(c.cast("double"))) == ["250 ms", "1.5 s", "-"]


def test_keys_are_canonical_json(spark):
    rows = [("Ana", "1"), ('a"b\\c', "é ü\n"), ("漢🙂", None)]
    df = spark.createDataFrame(rows, "nome string, id string")
    for row, got in zip(rows, df.select(web.idempotency_key(["nome", "id"])).collect(), strict=True):
        canonical = json.dumps({"nome": row[0], "id": row[1] or ""}, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
        assert got[0] == hashlib.sha256(canonical.encode()).hexdigest()[:32]


def test_hmac(spark):
    for secret in ("chave", "k" * 100):
        assert values(spark, ["dado", "é"], lambda c, s=secret: web.hmac_sha256(c, s)) == [hmac.new(secret.encode(), x.encode(), "sha256").hexdigest() for x in ("dado", "é")]
    assert values(spark, ["dado"], lambda c: web.hmac_sha256(c, "")) == [hashlib.sha256(b"dado").hexdigest()]


def test_outcomes_of_statuses(spark):
    table = {200: ("sucesso", False), 201: ("sucesso", False), 299: ("sucesso", False), 400: ("validacao", False), 422: ("validacao", False), 409: ("duplicado", False), 429: ("rate_limit", True), 500: ("temporario", True), 503: ("temporario", True), 302: ("outro", False), 404: ("outro", False)}
    df = spark.createDataFrame([(s,) for s in table], "s int")
    assert {r[0]: (r[1], r[2]) for r in df.select("s", web.status_category(F.col("s")), web.may_resend(F.col("s"))).collect()} == table
    bodies = {'{"id": 42}': "42", '{"record_id": "r1"}': "r1", '{"data": {"id": 7}}': "7", '{"id": " "}': None, "[1]": None, "x": None}
    assert values(spark, list(bodies), web.external_id) == list(bodies.values())
    assert values(spark, ['{"error": "ruim", "detalhes": ["a", "b"]}', "z" * 200], web.error_text) == ["ruim: a, b", "z" * 120]


def test_guards_and_masked_structs(spark):
    assert values(spark, ["https://a.b/c", "ftp://a", "http://", "x", "http://a b"], web.is_safe_url) == [True, False, False, False, False]
    assert values(spark, ["a/b.txt", "CON.txt", " .. ", "ok"], web.safe_filename) == ["a_b.txt", "_CON.txt", "unnamed", "ok"]
    assert values(spark, ["a/../b", "a/b", "..", "a..b"], web.has_traversal) == [True, False, True, False]
    schema = T.StructType.fromDDL("user string, senha string, inner struct<token: string, x: int>, m map<string, string>")
    row = spark.createDataFrame([("ana", "x", ("t", 1), {"api_key": "k", "b": "c"})], schema).select(*web.masked_struct(schema)).first()
    assert row.asDict(True) == {"user": "ana", "senha": "***", "inner": {"token": "***", "x": 1}, "m": {"api_key": "***", "b": "c"}}
