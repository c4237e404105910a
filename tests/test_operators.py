"""Operators on small sheets, logs and deliveries."""

import datetime
import hmac
import json
import os
import random
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crivo.functions import web
from crivo.operators import audit, cleaning, delivery, ledger, profile, profile_state, routing, rules
from crivo.plans.runner import ExpectedError, Pipeline, Result, chained
from crivo.sources import sinks

YAML = """
columns:
  - {name: nome, min_length: 3}
  - {name: email, format: email, nullable: true}
  - {name: cpf, validator_br: cpf, unique: true}
  - {name: idade, type: int, min_value: 18, max_value: 99, required: false}
detect_duplicate_rows: true
"""


@pytest.fixture(scope="module")
def people(spark):
    rows = [(2, "Ana Lima", "ana@x.com", "529.982.247-25", "30"), (3, "Al", None, "52998224725", "17"), (4, "Bia", "ruim", "111.111.111-11", "abc"), (5, " ", "", "", "200"), (6, "ANA LIMA", "ana@x.com ", "529.982.247-25", "30")]
    return spark.createDataFrame(rows, "line long, nome string, email string, cpf string, idade string")


@pytest.fixture(scope="module")
def schema():
    return rules.Schema.load(YAML)


def test_validation(people, schema):
    issues = rules.validate(people, schema)
    got = sorted((r["line"], r["column"] or "", r["code"]) for r in issues.collect())
    assert got == sorted(
        [(3, "nome", "tamanho"), (4, "email", "email"), (4, "cpf", "cpf"), (4, "idade", "tipo"), (3, "idade", "intervalo"), (5, "nome", "obrigatorio"), (5, "cpf", "obrigatorio"), (5, "idade", "intervalo"), (2, "cpf", "duplicado"), (3, "cpf", "duplicado"), (6, "cpf", "duplicado"), (6, "", "linha_duplicada")]
    )
    said = {(r["line"], r["code"]): r["message"] for r in issues.collect()}
    assert said[3, "duplicado"] == "Valor duplicado na coluna 'cpf' (linhas 2, 3, 6)" and said[6, "linha_duplicada"] == "Linha duplicada (identica a linha 2)"
    assert said[4, "tipo"] == "Valor 'abc' nao e um int valido" and said[3, "tamanho"] == "Valor muito curto: 'Al' tem 2 caractere(s), minimo 3"
    t = rules.totals(people, issues).first()
    assert (t["n_rows"], t["errors"], t["warnings"], t["invalid"], t["valid"]) == (5, 11, 1, 5, 0)
    valid, invalid = rules.split(people, issues.filter("code <> 'duplicado'"))
    assert sorted(r["line"] for r in valid.collect()) == [2, 6]
    assert {r["line"]: r["motivo"] for r in invalid.collect()}[4] == "E-mail invalido: 'ruim' | CPF invalido: '111.111.111-11' | Valor 'abc' nao e um int valido"
    assert rules.by_severity(issues, "warning").count() == 1


def test_missing_columns_end_validation(people, schema):
    issues = rules.validate(people.drop("cpf", "idade"), schema).collect()
    assert [(r["code"], r["column"]) for r in issues] == [("coluna", "cpf")]


@pytest.mark.parametrize("bad", ["{}", "columns: [{name: a, type: x}]", "columns: [{name: a, min_value: 3, max_value: 1}]", "columns: [{name: a, format: fax}]"])
def test_bad_schemas(bad):
    with pytest.raises(ValueError):
        rules.Schema.load(bad)


def test_own_rules_and_enumerations(spark):
    even = rules.Rule("par", lambda c: F.when(c.cast("int") % 2 == 1, F.concat(c, F.lit(" e impar"))), "warning")
    schema = rules.Schema([rules.ColumnRules("n", extra=[even], enum_values=["1", "2"]), rules.ColumnRules("t", regex="[a-z]+", nullable=True)])
    df = spark.createDataFrame([(2, "1", "ab"), (3, "2", "ab\n"), (4, "3", None)], "line long, n string, t string")
    assert sorted((r["line"], r["code"]) for r in rules.validate(df, schema).collect()) == [(2, "par"), (3, "formato"), (4, "enum"), (4, "par")]


def test_a_hot_duplicate_names_few_lines(spark):
    df = spark.range(2, 5002).select(F.col("id").alias("line"), F.lit("x").alias("k"))
    issues = rules.duplicate_value_issues(df, rules.ColumnRules("k", unique=True))
    assert issues.count() == 5000 and "5000 no total" in issues.first()["message"]


def test_cleaning_and_its_trail(people, schema, spark):
    df = spark.createDataFrame([(2, "  Ana   Lima ", "ANA@X.com", "52998224725", "1"), (3, "Bia", "b@x.com", "123", None)], people.schema)
    cleaned, changes = cleaning.clean(df, schema)
    first = cleaned.orderBy("line").first()
    assert (first["nome"], first["email"], first["cpf"]) == ("Ana Lima", "ana@x.com", "529.982.247-25")
    assert {(r["line"], r["column"]): r["rules"] for r in changes.collect()} == {(2, "nome"): ["espacos"], (2, "email"): ["minusculo"], (2, "cpf"): ["formato_cpf"]}
    assert cleaning.clean(cleaned, schema)[1].count() == 0


SHEET = [
    (2, "00123", "10,25", "01/12/2019", "sim", "x", "R$ 1.234,56", "1", None),
    (3, "00124", "7,5", "02/12/2019", "nao", " z ", "R$ 2,00", "2", ""),
    (4, "00125", "3", "03/12/2019", "sim", "a  b", "R$ 3,10", "dois", " "),
]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(SHEET, "line long, cod string, dec string, dia string, flag string, txt string, preco string, mix string, vazia string")


def test_types_and_conversion(sheet):
    names = [c for c in sheet.columns if c != "line"]
    found = profile.infer(sheet, names)
    assert {c: found[c].type for c in names} == {"cod": "identificador", "dec": "decimal", "dia": "data", "flag": "booleano", "txt": "texto", "preco": "moeda", "mix": "misto", "vazia": "vazio"}
    assert found["mix"].confidence == pytest.approx(2 / 3) and found["preco"].decimal_mark == ","
    typed, trail = profile.normalize(sheet, found)
    row = typed.orderBy("line").first()
    assert (row["cod"], row["dec"], row["flag"], row["preco"], row["dia"]) == ("00123", 10.25, True, 1234.56, datetime.datetime(2019, 12, 1))
    told = {(r["line"], r["column"]): (r["normalized"], r["rule"]) for r in trail.collect()}
    assert told[2, "preco"] == ("1234.56", "moeda_br") and told[2, "dia"] == ("2019-12-01", "data_texto") and told[3, "txt"] == ("z", "espacos_nas_pontas") and told[2, "flag"] == ("True", "booleano_texto")
    assert (4, "dec") not in told
    ends = {r["column"]: (r["min"], r["max"]) for r in profile.min_max(sheet, names, found).collect()}
    assert ends["dec"] == ("3", "10.25") and ends["dia"] == ("2019-12-01", "2019-12-03") and ends["txt"] == (None, None)


def test_profile_figures(sheet, spark):
    names = [c for c in sheet.columns if c != "line"]
    figures = {r["column"]: r for r in profile.column_figures(sheet, names).collect()}
    assert (figures["txt"]["space_issues"], figures["vazia"]["filled"], figures["vazia"]["fill_rate"]) == (2, 0, 0.0)
    assert (figures["flag"]["distinct_count"], figures["flag"]["surplus"], figures["flag"]["uniqueness_rate"]) == (2, 1, 0.6667)
    codes = {(r["column"], r["code"]) for r in profile.findings(profile.column_figures(sheet, names)).collect()}
    assert codes == {("txt", "espacos_extras"), ("vazia", "coluna_vazia"), ("mix", "tipos_misturados")}
    t = profile.table_figures(sheet.union(sheet), names).first()
    assert (t["rows"], t["duplicate_rows"], t["empty_rows"], t["cells"]) == (6, 3, 0, 48)
    empty = profile.table_figures(sheet.limit(0), names).first()
    assert (empty["rows"], empty["fill_rate"]) == (0, 0.0)
    assert profile.preview(sheet, 1, 4).first()["cod"] == "001~"
    assert [tuple(r) for r in profile.top_repeated(sheet, "flag").collect()] == [("sim", 2)]


def test_masked_numbers_are_identifiers_and_years_are_not(spark):
    df = spark.createDataFrame([(2, "123.456.789-00", "2019", "10.25"), (3, "987.654.321-00", "2019", "9.75"), (4, "111.222.333-44", "2019", "8.10")], "line long, cpf string, ano string, v string")
    found = profile.infer(df, ["cpf", "ano", "v"])
    assert found["cpf"].type == "identificador" and found["ano"].type == "inteiro" and found["v"].type == "identificador"


LOG = [("validate", "success", 100), ("validate", "success", 150), ("validate", "failure", 50), ("validate", "success", 150), ("backup", "success", 500), ("backup", "success", 600), ("backup", "success", 550), ("organize", "success", 200), ("organize", "partial", 220), ("organize", "success", 210), ("init", "success", 25), ("init", "dry_run", 30)]


@pytest.fixture(scope="module")
def log(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, at + datetime.timedelta(days=i), t, "u", s, "demo", "", None, ms, i, i % 2, None) for i, (t, s, ms) in enumerate(LOG, 1)]
    return spark.createDataFrame(rows, audit.SCHEMA)


def test_audit_report(log, tmp_path, spark):
    got = {r["task_name"]: (r["n"], r["success"], r["avg_ms"]) for r in audit.summary(log).collect()}
    assert got == {"validate": (4, 3, 112.5), "backup": (3, 3, 550.0), "organize": (3, 2, 210.0), "init": (2, 1, 27.5)}
    assert [r["id"] for r in audit.recent_failures(log).collect()] == [9, 3]
    assert {r["status"]: r["share"] for r in audit.counts(log, "status", share=True).collect()}["failure"] == 8.3
    since, until = audit.period("2026-01-03", "2026-01-05")
    assert [r["id"] for r in audit.latest(audit.filtered(log, "validate", since=since, until=until)).collect()] == [3, 2]
    with pytest.raises(ValueError):
        audit.latest(log, 0)
    with pytest.raises(ValueError):
        audit.period("2026-01-05", "2026-01-05")
    path = str(tmp_path / "log")
    audit.append(log.filter("id < 3"), path)
    audit.append(log.filter("id = 3"), path)
    assert audit.read(spark, path).count() == 3
    raw = log.select("id", F.lit("ontem").alias("timestamp"), "task_name", F.lit("x").alias("duration_ms"), F.lit("7").alias("rows_affected"), F.lit(None).cast("string").alias("rows_failed"))
    first = audit.typed(raw).first()
    assert (first["timestamp"], first["duration_ms"], first["rows_affected"], first["rows_failed"]) == (None, 0, 7, 0)


def transport(payload, headers):
    assert len(headers["Idempotency-Key"]) == 32 and "_nota" not in payload
    answer = {"a": (201, '{"data": {"id": 9}}', {}), "b": (422, '{"error": "cpf"}', {}), "c": (409, "x", {}), "d": (503, "fora", {})}
    if payload["nome"] == "e":
        raise ConnectionError("sem rede")
    return answer[payload["nome"]]


def test_delivery(spark, tmp_path):
    rows = spark.createDataFrame([(k, n, "m") for k, n in enumerate("abcde", 2)], "line long, nome string, _nota string")
    out = delivery.send(rows, transport, str(tmp_path / "outcomes"), delivery.Retry(attempts=2, first=0.0, jitter=0.0))
    got = {r["nome"]: (r["categoria"], r["sucesso"], r["tentativas"], r["pode_reenviar"], r["id_externo"]) for r in out.collect()}
    assert got == {"a": ("sucesso", True, 1, False, "9"), "b": ("validacao", False, 1, False, None), "c": ("duplicado", False, 1, False, None), "d": ("temporario", False, 2, True, None), "e": ("temporario", False, 2, True, None)}
    rolled = delivery.roll_up(out).first()
    assert (rolled["sent"], rolled["failed"], rolled["resendable"], rolled["status"]) == (1, 4, 2, "partial")
    sent, failed = delivery.sent_and_failed(out)
    assert sent.count() == 1 and failed.columns == rows.columns
    told = {r["line"]: r["_resultado"] for r in delivery.report_rows(rows, out).collect()}
    assert told[2] == "sucesso" and told[4] == "duplicado"
    dry = delivery.send(rows, transport, str(tmp_path / "dry"), dry_run=True)
    assert dry.filter("tentativas = 0").count() == 5 and delivery.without_meta(rows).columns == ["line", "nome"]


def test_rows_are_sent_once_whatever_reads_their_outcomes(spark, tmp_path):
    calls, outcomes = tmp_path / "calls", str(tmp_path / "outcomes")

    def counted(payload, headers):
        with open(calls, "a") as f:
            f.write(headers["Idempotency-Key"] + "\n")
        return (200, "", {}) if payload["nome"] < "c" else (400, "", {})

    rows = spark.createDataFrame([(k, n) for k, n in enumerate("abcde", 2)], "line long, nome string")
    out = delivery.send(rows, counted, outcomes)
    sent, failed = delivery.sent_and_failed(out)
    sinks.write_delivery(sent, failed, delivery.roll_up(out), str(tmp_path / "folder"))
    assert (sent.count(), failed.count(), len(calls.read_text().splitlines())) == (2, 3, 5)
    with pytest.raises(AnalysisException):
        delivery.send(rows.filter("line < 0"), counted, outcomes)


def killing(folder, at):
    """Counts the calls of each key, and dies once at a name."""

    def call(payload, headers):
        if payload["nome"] == at and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            raise RuntimeError("the driver is gone")
        with open(f"{folder}/calls", "a") as f:
            f.write(headers["Idempotency-Key"] + "\n")
        return {"b": (422, '{"error": "cpf"}', {}), "c": (200, '{"ok": false, "description": "chat not found"}', {}), "d": (503, "fora", {})}.get(payload["nome"], (201, '{"id": 9}', {}))

    return call


def test_no_key_is_sent_twice(spark, tmp_path):
    rows = spark.createDataFrame([(k, n, "m") for k, n in enumerate("abcdefghija", 2)], "line long, nome string, _nota string").repartition(3)
    book, retry = str(tmp_path / "ledger"), delivery.Retry(attempts=1, first=0.0, jitter=0.0)
    for at in ("f", "never"):
        (tmp_path / "killed").unlink(missing_ok=True)
        if at == "f":
            with pytest.raises(Exception, match="the driver is gone"):
                ledger.send_once(rows, killing(tmp_path, at), book, retry, flush=1)
    out = ledger.send_once(rows, killing(tmp_path, "never"), book, retry, flush=1)
    got = {r["nome"]: (r["categoria"], r["sucesso"], r["mensagem"], r["pode_reenviar"], r["id_externo"]) for r in out.collect()}
    assert got["a"] == ("sucesso", True, "", False, "9") and got["b"][:2] == ("validacao", False) and got["c"] == ("outro", False, "chat not found", False, None) and got["d"][3]
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == len(set(calls)) == 10 and out.count() == 11
    # a third run has nothing to send but what may have gone away, if that is asked for
    ledger.send_once(rows, killing(tmp_path, "never"), book, retry)
    assert len((tmp_path / "calls").read_text().splitlines()) == 10
    ledger.send_once(rows, killing(tmp_path, "never"), book, retry, again=True)
    assert len((tmp_path / "calls").read_text().splitlines()) == 11
    assert ledger.send_once(rows.limit(0), killing(tmp_path, "never"), str(tmp_path / "none"), retry).count() == 0


def test_entries_have_ids_of_their_own(spark, tmp_path):
    path, at = str(tmp_path / "log"), datetime.datetime(2026, 1, 1)
    entry = lambda k, given=None: (given, at + datetime.timedelta(seconds=k), "t", "u", "success", "e", "", None, 1, 1, 0, None, f"in {k}" if k % 2 else None)
    frame = lambda ks: spark.createDataFrame([entry(k) for k in ks], f"{audit.SCHEMA}, given string")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: audit.append(frame([9 * k + 2, 9 * k + 1, 9 * k + 3]), path, "given", "key"), range(4)))
    audit.append(spark.createDataFrame([entry(99, 7)[:-1]], audit.SCHEMA), path)
    rows = audit.read(spark, path).collect()
    assert len(rows) == 13 and len({r["id"] for r in rows}) == 13 and 7 in {r["id"] for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r["id"] >> audit.ROW_BITS, []).append((r["id"], r["timestamp"]))
    assert all(sorted(x) == sorted(x, key=lambda p: p[1]) for x in by.values()) and set(by) == {0, 1, 2, 3, 4}
    for r in rows:
        k = int((r["timestamp"] - at).total_seconds())
        assert r["input_hash"] == (hmac.new(b"key", f"in {k}".encode(), "sha256").hexdigest() if k % 2 and k != 99 else "")


def test_runs_leave_a_digest_of_their_input(spark, tmp_path):
    class Runs(Pipeline):
        name = "roda"

        def execute(self):
            return Result("success")

    path = str(tmp_path / "log")
    for _ in range(2):
        assert "audit_error" not in Runs().run(spark, path, inputs="clientes.csv", secret="s").data
    rows = audit.read(spark, path)
    inputs = rows.select("id", F.lit("clientes.csv").alias("input"))
    assert [r["verified"] for r in audit.verified(rows, inputs, web.hmac_sha256(F.col("input"), "s")).collect()] == [True, True]
    assert rows.select("id").distinct().count() == 2


def test_lines_of_a_hot_key_are_bounded(spark):
    df = spark.range(3000).selectExpr("id + 2 as line", "case when id % 3 = 0 then 'quente' else concat('k', id div 2) end as nome")
    got = {r["key"]: r for r in rules.duplicate_values(df, "nome").collect()}
    assert got["quente"]["n"] == 1000 and got["quente"]["lines"] == [2 + 3 * k for k in range(20)] and got["quente"]["first"] == 2
    assert rules.duplicate_values(df, "nome", lines=0).columns == ["key", "n", "first"]
    assert rules.duplicate_members(df, "nome").filter("key = 'quente'").count() == 1000


def test_profiles_of_merged_states(spark, tmp_path):
    values = [" a", "b", "b", None, "#REF!", "3", "c  d", "", "e ", "#N/D", " f", "g  h", "b"]
    rows = [(k, v, "1.234,5" if k % 2 else "7,25", "x") for k, v in enumerate(values, 2)]
    df = spark.createDataFrame(rows, "line long, a string, valor string, igual string")
    whole = profile_state.state(df, ("a", "valor", "igual"))
    for k, part in enumerate(("line < 7", "line >= 7")):
        profile_state.state(df.filter(part), ("a", "valor", "igual")).save(f"{tmp_path}/{k}")
    both = profile_state.State.load(spark, f"{tmp_path}/1").merged(profile_state.State.load(spark, f"{tmp_path}/0"))
    at = datetime.datetime(2026, 1, 1)
    typed, changes = profile.normalize(df, profile.infer(df, ("valor",)))
    got, want = (profile_state.report(x, changes, {"source_file": "a.csv", "header_row": 1, "warnings": []}, at) for x in (both, whole))
    assert got == want and json.loads(json.dumps(got, default=str)) == got
    by = {(f["column"], f["code"]): f for f in got["findings"]}
    assert by["a", "espacos_extras"]["samples"] == [" a", "c  d", "e ", " f", "g  h"] and by["a", "espacos_extras"]["count"] == 5
    assert by["a", "erro_excel"]["samples"] == ["#N/D", "#REF!"] and by["a", "tipos_misturados"]["samples"] == [" a", "b", "b", "#REF!", "3"]
    valor = got["columns"][1]
    assert (valor["inferred_type"], valor["minimum"], valor["maximum"], valor["sample_values"]) == ("decimal", "7.25", "1234.5", ["7,25", "1.234,5", "7,25", "1.234,5", "7,25"])
    assert got["estrutura"]["row_count"] == 13 and got["estrutura"]["empty_cells"] == 2 and got["estrutura"]["duplicate_row_count"] == 13 - len({r[1:] for r in [(k, v or "", w, x) for k, v, w, x in rows]})
    assert got["leitura"]["conversion_count"] == 13 and got["leitura"]["header_row"] == 1
    sinks.write_profile(got, f"{tmp_path}/p/perfil.json")
    assert json.loads((tmp_path / "p" / "perfil.json").read_text("utf-8"))["columns"][2]["distinct_count"] == 1
    empty = profile_state.report(profile_state.state(df.limit(0), ("a",)))
    assert empty["estrutura"]["row_count"] == 0 and empty["findings"] == [] and empty["columns"] == []
    with pytest.raises(ValueError):
        whole.merged(profile_state.state(df, ("a",)))


def test_a_validation_workbook_tells_what_it_leaves_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "REPORT_ROWS", 3)
    lines = spark.createDataFrame([(k, f"v{k}") for k in (9, 7, 5, 3, 2)], "line long, nome string").repartition(4)
    sinks.write_validation(spark.createDataFrame([(8, 3)], "total long, erros long"), lines, lines.filter("line < 4"), lines.withColumn("seq", F.lit(0)), str(tmp_path))
    with zipfile.ZipFile(tmp_path / "relatorio.xlsx") as z:
        summary, valid, invalid = (z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2, 3))
    assert all(x in summary for x in ("Omitidos: Registros validos", "Omitidos: Auditoria")) and "Omitidos: Registros invalidos" not in summary
    assert [v for v in ("v2", "v3", "v5", "v7", "v9") if v in valid] == ["v2", "v3", "v5"] and "v2" in invalid
    assert spark.read.option("header", True).csv(str(tmp_path / "registros_validos.csv")).count() == 5


def test_reports_hold_the_run_the_issues_and_all_sheets(spark, tmp_path):
    lines = spark.createDataFrame([(3, "c\nd", ["x"]), (2, "", ["y", "z"])], "line long, nome string, tags array<string>")
    issues = spark.createDataFrame([(3, 0, "nome", "enum")], "line long, seq int, column string, code string")
    run = {"task_name": "validar", "status": "partial", "duration_ms": 7, "rows_affected": 2}
    sinks.write_validation(spark.createDataFrame([(2, 1)], "total long, erros long"), lines, lines.limit(0), issues, str(tmp_path / "v"), run)
    report = json.loads((tmp_path / "v" / "relatorio.json").read_text("utf-8"))
    assert report == run | {"total": 2, "erros": 1, "issues": [{"line": 3, "seq": 0, "column": "nome", "code": "enum"}], "issues_omitidas": 0}
    rows, n = sinks.saved(lines, str(tmp_path / "saved.csv"))
    assert n == 2 and rows == [[2, None, '["y","z"]'], [3, "c\nd", '["x"]']]
    rolled = spark.createDataFrame([(1, 1, 1, "partial")], "sent long, failed long, resendable long, status string")
    sinks.write_delivery(lines.filter("line = 2"), lines.filter("line = 3"), rolled, str(tmp_path / "d"), lines.select("line", F.lit("sucesso").alias("_resultado")), run)
    with zipfile.ZipFile(tmp_path / "d" / "relatorio.xlsx") as z:
        assert all(f">{k}<" in z.read("xl/worksheets/sheet1.xml").decode() for k in ("task_name", "resendable"))
        assert len([n for n in z.namelist() if n.startswith("xl/worksheets/sheet")]) == 4
    assert json.loads((tmp_path / "d" / "relatorio.json").read_text("utf-8")) == run | rolled.first().asDict()
    sinks.write_extract(lines, str(tmp_path / "e"), "http://x", 4, 9)
    assert json.loads((tmp_path / "e" / "relatorio.json").read_text("utf-8")) == {"total_registros": 2, "paginas": 4, "colunas": ["line", "nome", "tags"], "origem": "http://x", "duracao_ms": 9}
    with zipfile.ZipFile(tmp_path / "e" / "relatorio.xlsx") as z:
        assert "c\nd" in z.read("xl/worksheets/sheet2.xml").decode()


def test_retries_wait_as_asked():
    waits, answers = [], iter([(429, "", {"Retry-After": "2"}), (500, "", {}), (200, "ok", {})])
    assert delivery.call(lambda p, h: next(answers), {}, {}, delivery.Retry(jitter=0.0), waits.append) == (200, "ok", 3) and waits == [2.0, 1.0]
    assert delivery.Retry().wait(0, "99") == 30.0 and delivery.Retry(jitter=0.0).wait(9, None) == 5.0


RULES = """
target_root: fora
on_conflict: rename
rules:
  - {name: notas, patterns: ["nota*.pdf", "NF*"], destination: "{year}/{month:02d}"}
  - {name: resto, patterns: ["*.pdf"], destination: "{ext}"}
"""


def test_routing(spark):
    routes = routing.Routes.load(RULES)
    at = datetime.datetime(2026, 3, 4)
    files = spark.createDataFrame([(n, n, at) for n in ("nota1.pdf", "x.pdf", "NF9", "nf9", "a.txt")], "path string, name string, modificationTime timestamp")
    existing = spark.createDataFrame([("fora/pdf/x.pdf",)], "path string")
    got = {r["name"]: (r["rule"], r["destination"], r["status"]) for r in routing.plan(files, routes, existing).collect()}
    assert got == {"nota1.pdf": ("notas", "fora/2026/03/nota1.pdf", "moved"), "x.pdf": ("resto", "fora/pdf/x_1.pdf", "moved"), "NF9": ("notas", "fora/2026/03/NF9", "moved"), "nf9": ("unmatched", None, "unmatched"), "a.txt": ("unmatched", None, "unmatched")}
    with pytest.raises(ValueError):
        routing.Routes.load("rules: []")
    inside, outside = routing.included(spark.createDataFrame([("a/b.txt",), ("a/.git/c",), ("x.tmp",)], "path string"), [".git", "*.tmp"])
    assert [r["path"] for r in inside.collect()] == ["a/b.txt"] and outside.count() == 2
    assert {r["status"]: r["n"] for r in routing.counters(routing.plan(files, routes)).collect()} == {"moved": 3, "unmatched": 2}


def test_too_many_rules_are_refused(spark):
    rules_ = spark.range(routing.MAX_RULES + 1).selectExpr("id as ord", "'r' as rule", "'x' as regex")
    names = spark.createDataFrame([("x",)], "name string")
    with pytest.raises(ValueError):
        routing.matched_by_table(names, rules_, "name")
    assert routing.matched_by_table(names, rules_.limit(5), "name").first()["rule"] == "r"


def plain_plan(names, existing, policy):
    """Destinations as the rule has them: the first of equal names keeps a free one, the others take free numbers."""
    there, wanted, out, given = set(existing), set(existing) | set(names), [], set()
    for n in names:
        if policy == "overwrite" or n not in there and n not in given:
            out.append((n, "moved"))
        elif policy == "skip":
            out.append((n, "skipped"))
        else:
            stem, dot, ext = n.rpartition(".")
            stem, ext = (stem, dot + ext) if stem else (n, "")
            new = next((c for c in (f"{stem}_{k}{ext}" for k in range(1, 1001)) if c not in wanted and c not in given), None)
            out.append((new, "moved") if new else (None, "error"))
        given.add(out[-1][0])
    return out


@pytest.mark.parametrize("policy", ["skip", "rename", "overwrite"])
def test_routing_with_clashes(spark, policy):
    rng = random.Random(9)
    names = ["a.pdf", "a.pdf", *(rng.choice(["a.pdf", "a_1.pdf", "a_2.pdf", "a_1_1.pdf", "b.pdf", "c", "c_1", "d.tar.gz", "x_01.pdf", "x.pdf"]) for _ in range(60)), *["viel.pdf"] * 1005]
    existing = ["a.pdf", "a_1.pdf", "a_7.pdf", "c", "x_3.pdf", "viel_5.pdf", "viel_1001.pdf"]
    files = spark.createDataFrame([(k, n, datetime.datetime(2026, 3, 4)) for k, n in enumerate(names)], "k long, name string, modificationTime timestamp")
    routes = routing.Routes((routing.Route("all", ("*",), ""),), on_conflict=policy)
    planned = routing.plan(files, routes, spark.createDataFrame([(e,) for e in existing * 2], "path string"), "k")
    got = [(r["destination"], r["status"]) for r in planned.orderBy("k").collect()]
    want = plain_plan(names, existing, policy)
    assert got == [(d if s != "error" else None, s) for d, s in want]
    if policy == "rename":
        assert got[:2] == [("a_3.pdf", "moved"), ("a_4.pdf", "moved")] and got[-1] == (None, "error")
        moved = [d for d, s in got if s == "moved"]
        assert len(moved) == len(set(moved)) and not set(moved) & set(existing)


def test_two_files_of_a_taken_name(spark):
    files = spark.createDataFrame([(f"/f{k}", "a.pdf", datetime.datetime(2026, 3, 4)) for k in (1, 2)], "path string, name string, modificationTime timestamp")
    routes = routing.Routes((routing.Route("docs", ("*.pdf",), "docs"),), "/t", on_conflict="rename")
    got = routing.plan(files, routes, spark.createDataFrame([("/t/docs/a.pdf",), ("/t/docs/a_1.pdf",)], "path string"))
    assert {r["destination"] for r in got.collect()} == {"/t/docs/a_2.pdf", "/t/docs/a_3.pdf"}


def killed_once(folder):
    def act(source, destination, action):
        routing.local_file(source, destination, action)
        if source.endswith("7.txt") and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            raise RuntimeError("the executor is gone")

    return act


@pytest.mark.parametrize("action", ["move", "copy"])
def test_a_kept_plan_is_done_once(spark, tmp_path, action):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for k in range(12):
        (tmp_path / "in" / f"{k}.txt").write_text(f"neu {k}")
    (tmp_path / "out" / "3.txt").write_text("alt")
    at = datetime.datetime(2026, 3, 4)
    files = spark.createDataFrame([(f"{tmp_path}/in/{k}.txt", f"{k}.txt", at) for k in range(12)] + [(f"{tmp_path}/in/fehlt.txt", "fehlt.txt", at)], "path string, name string, modificationTime timestamp")
    routes = routing.Routes((routing.Route("all", ("*.txt",), ""),), f"{tmp_path}/out", action, "rename")
    planned = routing.plan(files, routes, spark.createDataFrame([(f"{tmp_path}/out/3.txt",)], "path string"))
    journal = f"{tmp_path}/journal"
    routing.keep_plan(planned, journal, action)
    with pytest.raises(Exception, match="the executor is gone"):
        routing.execute(spark, journal, killed_once(tmp_path))
    for _ in range(2):
        told = {r["source"]: (r["status"], r["error"]) for r in routing.execute(spark, journal).collect()}
        assert [s for s, (status, _) in told.items() if status == "error"] == [f"{tmp_path}/in/fehlt.txt"] and len(told) == 13
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"3.txt": "alt", "3_1.txt": "neu 3"} | {f"{k}.txt": f"neu {k}" for k in range(12) if k != 3}
    assert len(list((tmp_path / "in").iterdir())) == (0 if action == "move" else 12)


class Fails(Pipeline):
    name = "falha"

    def execute(self):
        raise ExpectedError("nao deu")


class Works(Pipeline):
    name = "ok"

    def execute(self):
        return Result("success", rows_affected=3)


def test_numbers_within_a_hot_key(spark):
    rows = [("a" if i % 3 else None if i % 2 else "b", (i * 7919) % 2003) for i in range(2000)]
    got = audit.numbered(spark.createDataFrame(rows, "task_name string, id long"), "task_name", "id", "k")
    want = [(t, n, sum(1 for u, m in rows if u == t and m <= n)) for t, n in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert audit.numbered(spark.createDataFrame([], "task_name string, id long"), "task_name", "id", "k").count() == 0


def test_rules_of_a_table_keep_every_row(spark):
    df = spark.createDataFrame([(n,) for n in ("ab", "ab", "ab", "b", None, None, "x", "x")], "name string")
    rules = spark.createDataFrame([(1, "second", "b"), (0, "first", r"\Aa"), (2, "never", "a")], "ord int, rule string, regex string")
    got = sorted(map(tuple, routing.matched_by_table(df, rules, "name").collect()), key=repr)
    assert got == sorted([("ab", "first")] * 3 + [("b", "second")] + [(None, "unmatched")] * 2 + [("x", "unmatched")] * 2, key=repr)
    assert routing.matched_by_table(df, rules.limit(0), "name").filter("rule = 'unmatched'").count() == 8


def test_runs_are_recorded(spark, tmp_path):
    log = str(tmp_path / "log")
    assert Works().run(spark, log).status == "success" and Fails().run(spark, log).error == "ExpectedError"
    assert sorted((r["task_name"], r["status"], r["rows_affected"]) for r in audit.read(spark, log).collect()) == [("falha", "failure", 0), ("ok", "success", 3)]
    with pytest.raises(ValueError):
        Result("bom")
    assert chained(lambda: 1, lambda x: Result("success", rows_affected=x)).rows_affected == 1
    assert chained(Fails().execute, lambda x: None).data == {"stage": "extract"}
