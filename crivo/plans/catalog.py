"""All queries of the library by name, and the SQL that gives the same rows.

The tables stand in for the sheets, logs and deliveries that the operators are made for: ``events``
for a run log, ``orders`` and ``customer`` for sheets to validate and profile, ``documents`` for texts,
``pages`` for HTML and files. Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import br, parse, text, web
from ..operators import audit, cleaning, delivery, profile, routing, rules
from ..sources import web as pages_source
from ..streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the run log, read from events ------------------------------------------------------------

LOG_SQL = """log AS (
  SELECT event_id AS id, ts AS "timestamp", event_type AS task_name,
         CASE user_id % 7 WHEN 0 THEN 'failure' WHEN 1 THEN 'partial' ELSE 'success' END AS status,
         floor(value * 10)::BIGINT AS duration_ms, user_id % 11 AS rows_affected, user_id % 3 AS rows_failed
  FROM events)"""


def run_log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    status = F.when(F.col("user_id") % 7 == 0, "failure").when(F.col("user_id") % 7 == 1, "partial").otherwise("success")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("task_name"), status.alias("status"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), (F.col("user_id") % 11).alias("rows_affected"), (F.col("user_id") % 3).alias("rows_failed"),
    )


@query(f"""WITH {LOG_SQL} SELECT task_name, count(*) AS n, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS "partial",
count(*) FILTER (status = 'failure') AS failure, round(avg(duration_ms), 2) AS avg_ms, coalesce(sum(rows_affected), 0)::BIGINT AS rows_affected FROM log GROUP BY task_name""")
def audit_summary_by_task(spark, d):
    return audit.summary(run_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT task_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM log GROUP BY task_name")
def audit_count_by_type(spark, d):
    return audit.counts(run_log(spark, d), "task_name", share=True)


@query(f"WITH {LOG_SQL} SELECT status, count(*) AS n FROM log GROUP BY status")
def audit_count_by_status(spark, d):
    return audit.counts(run_log(spark, d), "status")


@query(f"WITH {LOG_SQL} SELECT task_name, status, count(*) AS n FROM log GROUP BY ALL")
def audit_crosstab(spark, d):
    return audit.crosstab(run_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT task_name, round(avg(duration_ms), 2) AS avg_ms FROM log WHERE duration_ms IS NOT NULL GROUP BY task_name")
def audit_avg_by_type(spark, d):
    return audit.average_duration(run_log(spark, d))


@query(f"""WITH {LOG_SQL} SELECT count(*) AS n, coalesce(sum(rows_affected), 0)::BIGINT AS rows_affected, coalesce(sum(rows_failed), 0)::BIGINT AS rows_failed,
count(*) FILTER (status IN ('failure', 'partial')) AS failures FROM log""")
def audit_totals(spark, d):
    return audit.totals(run_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT id, task_name, status, duration_ms FROM log WHERE status IN ('failure', 'partial') ORDER BY id DESC LIMIT 5")
def audit_recent_failures(spark, d):
    return audit.recent_failures(run_log(spark, d)).select("id", "task_name", "status", "duration_ms")


@query(f"WITH {LOG_SQL} SELECT id, task_name, status FROM log ORDER BY id DESC LIMIT 100")
def audit_recent_executions(spark, d):
    return audit.latest(run_log(spark, d)).select("id", "task_name", "status")


@query(f"""WITH {LOG_SQL}, f AS (SELECT min("timestamp") + INTERVAL 5 DAY AS a, min("timestamp") + INTERVAL 20 DAY AS b FROM log)
SELECT id, task_name, status FROM log, f WHERE status = 'failure' AND "timestamp" >= a AND "timestamp" < b ORDER BY id DESC LIMIT 50""")
def audit_filtered_errors(spark, d):
    log = run_log(spark, d)
    first = log.agg(F.min("timestamp").alias("t")).first()["t"]
    import datetime

    chosen = audit.filtered(log, status="failure", since=first + datetime.timedelta(days=5), until=first + datetime.timedelta(days=20))
    return audit.latest(chosen, 50).select("id", "task_name", "status")


@query("""SELECT event_id AS id, event_id % 3 = 0 AS no_time, coalesce(try_cast(props->>'$.k' AS BIGINT), 0) AS duration_ms, coalesce(try_cast(event_type AS BIGINT), 0) AS rows_affected, user_id AS rows_failed FROM events""")
def audit_typed_scan(spark, d):
    e = _t(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, "ontem").otherwise(F.col("ts").cast("string"))
    log = e.select(F.col("event_id").alias("id"), text.alias("timestamp"), F.get_json_object("props", "$.k").alias("duration_ms"), F.col("event_type").alias("rows_affected"), F.col("user_id").cast("string").alias("rows_failed"))
    return audit.typed(log).select("id", F.col("timestamp").isNull().alias("no_time"), "duration_ms", "rows_affected", "rows_failed")


@query("""WITH r AS (SELECT event_id AS run_id, event_type AS task_name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE user_id % 2 = 0),
e AS (SELECT event_id AS id, event_type AS task_name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE user_id % 2 = 1)
SELECT r.run_id, r.task_name, e.id FROM r LEFT JOIN e USING (task_name, k)""")
def attach_runs(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("task_name"))
    runs, entries = (e.filter(F.col("user_id") % 2 == k).select(F.col("event_id").alias(n), "task_name") for k, n in ((0, "run_id"), (1, "id")))
    return audit.attached(runs, entries).select("run_id", "task_name", "id")


@query("SELECT event_id AS id, sha256(event_type) = sha256(CASE WHEN user_id % 5 = 0 THEN 'view' ELSE event_type END) AS verified FROM events")
def verify_input_hash(spark, d):
    e = _t(spark, d, "events")
    entries = e.select(F.col("event_id").alias("id"), F.sha2("event_type", 256).alias("input_hash"))
    inputs = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 == 0, "view").otherwise(F.col("event_type")).alias("input"))
    return audit.verified(entries, inputs, F.sha2("input", 256))


# --- profiles ---------------------------------------------------------------------------------

SHEET = ("o_custkey", "o_orderstatus", "o_orderpriority", "o_comment", "o_day")
SHEET_SQL = """sheet AS (
  SELECT o_orderkey + 2 AS line, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority,
         CASE o_orderkey % 5 WHEN 0 THEN '  ' || o_orderstatus WHEN 1 THEN 'a   b' WHEN 2 THEN '#N/A' WHEN 3 THEN '' ELSE 'ok' END AS o_comment,
         strftime(o_orderdate, '%d/%m/%Y') AS o_day
  FROM orders)"""


def sheet(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    comment = F.when(k == 0, F.concat(F.lit("  "), "o_orderstatus")).when(k == 1, "a   b").when(k == 2, "#N/A").when(k == 3, "").otherwise("ok")
    return o.select(
        (F.col("o_orderkey") + 2).alias("line"), F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderpriority", comment.alias("o_comment"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_day")
    )


@query(f"""WITH {SHEET_SQL}, c AS (UNPIVOT (SELECT * EXCLUDE (line) FROM sheet) ON * INTO NAME "column" VALUE v),
g AS (SELECT "column", v, trim(v) AS t, count(*) AS n FROM c GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS "rows", coalesce(sum(n) FILTER (t <> ''), 0)::BIGINT AS filled, count(*) FILTER (t <> '') AS distinct_count,
       coalesce(sum(n) FILTER (t <> '' AND (t <> v OR regexp_matches(v, '\\S\\s{{2,}}\\S'))), 0)::BIGINT AS space_issues, coalesce(sum(n) FILTER (t = '#N/A'), 0)::BIGINT AS sheet_errors,
       (sum(n) - sum(n) FILTER (t <> ''))::BIGINT AS "empty", (sum(n) FILTER (t <> '') - count(*) FILTER (t <> ''))::BIGINT AS surplus,
       round(sum(n) FILTER (t <> '') / sum(n), 4) AS fill_rate, round(count(*) FILTER (t <> '') / sum(n) FILTER (t <> ''), 4) AS uniqueness_rate
FROM g GROUP BY "column\"""")
def profile_orders(spark, d):
    return profile.column_figures(sheet(spark, d), SHEET).select("column", "rows", "filled", "distinct_count", "space_issues", "sheet_errors", "empty", "surplus", "fill_rate", "uniqueness_rate")


@query(f"""WITH {SHEET_SQL}, c AS (UNPIVOT (SELECT * EXCLUDE (line) FROM sheet) ON * INTO NAME "column" VALUE v),
g AS (SELECT "column", v, trim(v) AS t, count(*) AS n FROM c GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS "rows", coalesce(sum(n) FILTER (t <> ''), 0)::BIGINT AS filled, count(*) FILTER (t <> '') AS distinct_count,
       coalesce(sum(n) FILTER (t <> '' AND (t <> v OR regexp_matches(v, '\\S\\s{{2,}}\\S'))), 0)::BIGINT AS space_issues, coalesce(sum(n) FILTER (t = '#N/A'), 0)::BIGINT AS sheet_errors,
       (sum(n) - sum(n) FILTER (t <> ''))::BIGINT AS "empty", (sum(n) FILTER (t <> '') - count(*) FILTER (t <> ''))::BIGINT AS surplus,
       round(sum(n) FILTER (t <> '') / sum(n), 4) AS fill_rate, round(count(*) FILTER (t <> '') / sum(n) FILTER (t <> ''), 4) AS uniqueness_rate
FROM g GROUP BY "column\"""")
def profile_of_stored_states(spark, d):
    """The same from the states of two halves, stored and read again."""
    from ..operators import profile_state
    from ..sources.files import shared_dir

    halves = []
    for part in (F.col("line") % 2 == 0, F.col("line") % 2 == 1):
        profile_state.state(sheet(spark, d).filter(part), SHEET).save(path := shared_dir(spark, "profile"))
        halves.append(profile_state.State.load(spark, path))
    figures = profile.figures(halves[0].merged(halves[1]).cells)
    return figures.select("column", "rows", "filled", "distinct_count", "space_issues", "sheet_errors", "empty", "surplus", "fill_rate", "uniqueness_rate")


@query(f"""WITH {SHEET_SQL}, filled AS (SELECT line, o_comment AS v FROM sheet WHERE trim(o_comment) <> '')
SELECT 'o_comment' AS "column", 'tipos_misturados' AS code, unnest((SELECT list_slice(list(v ORDER BY line), 1, 5) FROM filled)) AS value
UNION ALL SELECT 'o_comment', 'espacos_extras', unnest((SELECT list_slice(list(v ORDER BY line), 1, 5) FROM filled WHERE v LIKE '  %' OR v = 'a   b'))
UNION ALL SELECT 'o_orderstatus', 'tipos_misturados', unnest((SELECT list_slice(list(o_orderstatus ORDER BY line), 1, 5) FROM sheet))
UNION ALL SELECT 'o_comment', 'erro_excel', '#N/A'""")
def samples_of_findings(spark, d):
    """The cells that a report shows for what was found."""
    from ..operators import profile_state

    found = profile_state.findings(profile_state.state(sheet(spark, d), SHEET))
    return found.select("column", "code", F.explode("samples").alias("value"))


@query(f"""WITH {SHEET_SQL}, c AS (UNPIVOT (SELECT * EXCLUDE (line) FROM sheet) ON * INTO NAME "column" VALUE v), k AS (
SELECT "column", CASE WHEN trim(v) = '' THEN 'vazio' WHEN v = '#N/A' THEN 'erro' WHEN lower(trim(v)) IN ('sim','true','verdadeiro','v','yes','y','s','nao','não','false','falso','f','no','n') THEN 'booleano'
WHEN regexp_matches(v, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'data' WHEN regexp_matches(trim(v), '^[0-9]+$') THEN 'inteiro' ELSE 'texto' END AS type FROM c)
SELECT "column", type, count(*) AS n FROM k GROUP BY ALL""")
def type_distribution(spark, d):
    return profile.long_form(sheet(spark, d), SHEET).groupBy("column", parse.cell_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"))


@query(f"""WITH {SHEET_SQL} SELECT o_custkey AS "value", count(*) AS times FROM sheet GROUP BY o_custkey HAVING count(*) > 1 ORDER BY times DESC, min(line) LIMIT 5""")
def top_repeated_values(spark, d):
    return profile.top_repeated(sheet(spark, d), "o_custkey")


@query(f"""WITH {SHEET_SQL} SELECT line, o_comment AS "value" FROM sheet WHERE trim(o_comment) <> '' ORDER BY line LIMIT 5""")
def first_samples(spark, d):
    return profile.first_samples(sheet(spark, d), "o_comment")


@query(f"""WITH {SHEET_SQL}, g AS (SELECT o_orderstatus, o_orderpriority, o_comment, count(*) AS n FROM sheet GROUP BY ALL)
SELECT sum(n)::BIGINT AS "rows", sum(n * (2 + (trim(o_comment) <> '')::INT))::BIGINT AS filled_cells, 0::BIGINT AS empty_rows, sum(n - 1)::BIGINT AS duplicate_rows, (3 * sum(n))::BIGINT AS cells,
round(sum(n * (2 + (trim(o_comment) <> '')::INT)) / (3 * sum(n)), 4) AS fill_rate FROM g""")
def profile_table(spark, d):
    return profile.table_figures(sheet(spark, d), ("o_orderstatus", "o_orderpriority", "o_comment"))


@query("""SELECT 'o_day' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS "min", strftime(max(o_orderdate), '%Y-%m-%d') AS "max" FROM orders
UNION ALL SELECT 'o_custkey', NULL, NULL
UNION ALL SELECT 'price', min(o_orderkey * 7 % 10007)::VARCHAR, max(o_orderkey * 7 % 10007)::VARCHAR FROM orders""")
def min_max_by_type(spark, d):
    t = _t(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("line"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_day"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("o_custkey"), F.concat(F.lit("R$ "), F.col("o_orderkey") * 7 % 10007, F.lit(",00")).alias("price"))
    names = ("o_day", "o_custkey", "price")
    return profile.min_max(t, names, profile.infer(t, names))


@query(f"""WITH {SHEET_SQL}, n AS (SELECT count(*) AS n FROM sheet)
SELECT 'o_comment' AS "column", 'tipos_misturados' AS code, 'aviso' AS severity, (SELECT count(*) FROM sheet WHERE trim(o_comment) <> '') AS "count"
UNION ALL SELECT 'o_comment', 'erro_excel', 'problema', (SELECT count(*) FROM sheet WHERE o_comment = '#N/A')
UNION ALL SELECT 'o_comment', 'espacos_extras', 'aviso', (SELECT count(*) FROM sheet WHERE o_comment LIKE '  %' OR o_comment LIKE 'a   b')
UNION ALL SELECT 'o_orderpriority', 'baixa_cardinalidade', 'informacao', (SELECT count(DISTINCT o_orderpriority) FROM sheet)""")
def findings_of_sheet(spark, d):
    return profile.findings(profile.column_figures(sheet(spark, d).withColumn("o_comment", F.col("o_comment")), ("o_comment", "o_orderpriority", "o_day")))


@query("""SELECT p_partkey, '[' || CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE '.' END || ']' AS mark FROM part""")
def decimal_marks(spark, d):
    p = _t(spark, d, "part")
    whole, cents = F.col("p_partkey").cast("string"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(whole, F.lit(","), cents)).otherwise(F.concat(whole, F.lit("."), cents))
    comma, point = parse.decimal_mark_votes(cell)
    return p.select("p_partkey", F.concat(F.lit("["), F.when(comma, ",").otherwise(F.lit("")), F.when(point, ".").otherwise(F.lit("")), F.lit("]")).alias("mark"))


@query("""SELECT p_partkey, (p_partkey * 1234 + p_size / 100.0)::DOUBLE AS br, -(p_partkey + p_size / 100.0)::DOUBLE AS us, (p_size)::DOUBLE AS pct FROM part""")
def parse_numbers(spark, d):
    p = _t(spark, d, "part")
    cents = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    grouped = F.translate(F.format_number(F.col("p_partkey") * 1234, 0), ",", ".")
    return p.select(
        "p_partkey",
        parse.parse_number(F.concat(F.lit("R$ "), grouped, F.lit(","), cents), ",").alias("br"),
        parse.parse_number(F.concat(F.lit("-"), F.format_number(F.col("p_partkey"), 0), F.lit("."), cents), ".").alias("us"),
        parse.parse_number(F.concat(F.col("p_size").cast("string"), F.lit("%")), "").alias("pct"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS day, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders""")
def parse_dates_and_bools(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    cell = F.when(k % 4 == 0, F.date_format(at, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(at, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(at, "d.M.yyyy")).otherwise("31/02/2020")
    word = F.when(k % 3 == 0, "Sim").when(k % 3 == 1, " nao ").otherwise("talvez")
    return _t(spark, d, "orders").select("o_orderkey", parse.parse_date(cell).alias("day"), parse.parse_bool(word).alias("flag"))


@query(f"""WITH {SHEET_SQL} SELECT line, o_day AS original, strftime(strptime(o_day, '%d/%m/%Y'), '%Y-%m-%d') AS normalized, 'data_texto' AS rule, 'o_day' AS "column" FROM sheet""")
def normalize_trail(spark, d):
    s = sheet(spark, d).select("line", "o_day", "o_orderstatus")
    return profile.normalize(s, profile.infer(s, ("o_day", "o_orderstatus")))[1]


# --- validation -------------------------------------------------------------------------------

ORDER_RULES = rules.Schema(
    [
        rules.ColumnRules("o_custkey", type="int", min_value=10, max_value=1000),
        rules.ColumnRules("o_orderstatus", enum_values=["F", "O"], regex="[A-Z]", regex_message="formato"),
        rules.ColumnRules("o_comment", min_length=3),
    ]
)
ISSUES_SQL = f"""{SHEET_SQL}, issues AS (
  SELECT line, 'o_custkey' AS "column", 'intervalo' AS code, 'error' AS severity FROM sheet WHERE o_custkey::BIGINT < 10 OR o_custkey::BIGINT > 1000
  UNION ALL SELECT line, 'o_orderstatus', 'enum', 'error' FROM sheet WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT line, 'o_comment', 'obrigatorio', 'error' FROM sheet WHERE trim(o_comment) = ''
  UNION ALL SELECT line, 'o_comment', 'tamanho', 'error' FROM sheet WHERE trim(o_comment) <> '' AND length(trim(o_comment)) < 3)"""


def order_issues(spark: SparkSession, d: str) -> DataFrame:
    return rules.validate(sheet(spark, d), ORDER_RULES)


@query(f"""WITH {ISSUES_SQL} SELECT line, "column", code, severity FROM issues""")
def validate_orders_issues(spark, d):
    return order_issues(spark, d).select("line", "column", "code", "severity")


@query(f"WITH {ISSUES_SQL} SELECT code, count(*) AS n, min(line) AS first_line FROM issues GROUP BY code")
def validate_issue_counts(spark, d):
    return rules.category_counts(order_issues(spark, d))


@query(f"""WITH {ISSUES_SQL}, i AS (SELECT count(DISTINCT line) AS n FROM issues)
SELECT (SELECT count(*) FROM sheet) AS n_rows, (SELECT count(*) FROM issues) AS errors, 0::BIGINT AS warnings, i.n AS invalid, (SELECT count(*) FROM sheet) - i.n AS valid FROM i""")
def validate_totals(spark, d):
    return rules.totals(sheet(spark, d), order_issues(spark, d))


@query(f"WITH {ISSUES_SQL} SELECT * FROM sheet WHERE line NOT IN (SELECT line FROM issues)")
def split_valid(spark, d):
    return rules.split(sheet(spark, d), order_issues(spark, d))[0]


@query(f"""WITH {ISSUES_SQL}, m AS (SELECT line, CASE code WHEN 'intervalo' THEN 1 WHEN 'enum' THEN 2 ELSE 3 END AS seq, code FROM issues)
SELECT s.line, string_agg(code, ' | ' ORDER BY seq) AS motivo FROM sheet s JOIN m USING (line) GROUP BY s.line""")
def split_invalid_with_reasons(spark, d):
    issues = order_issues(spark, d).withColumn("message", F.col("code"))
    return rules.split(sheet(spark, d), issues)[1].select("line", "motivo")


@query("SELECT o_custkey::VARCHAR AS key, count(*) AS n, min(o_orderkey + 2) AS first FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_values_orders(spark, d):
    return rules.duplicate_values(sheet(spark, d), "o_custkey", lines=0).select("key", "n", "first")


@query("""SELECT doc_id AS line, f AS original FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f""")
def dup_rows_exact(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("line"), "text")
    return rules.duplicate_rows(docs, ["text"], exact=True)


@query("""SELECT c_custkey + 1 AS line, n AS group_size FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n > 1""")
def dup_fan_out(spark, d):
    c = _t(spark, d, "customer").select((F.col("c_custkey") + 1).alias("line"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("k"))
    found = rules.duplicate_value_issues(c, rules.ColumnRules("k", unique=True))
    sizes = c.groupBy(F.lower("k").alias("key")).agg(F.count("*").alias("group_size"))
    return found.select("line").join(c, "line").join(sizes, F.lower("k") == F.col("key")).select("line", "group_size")


def _check(digits: str, weights: tuple) -> str:
    total = " + ".join(f"substr({digits}, {k + 1}, 1)::INT * {w}" for k, w in enumerate(weights))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


def _valid(digits: str, n: int, weights: tuple) -> str:
    return " AND ".join([f"NOT regexp_matches({digits}, '^({'|'.join(str(k) * n for k in range(10))})$')", *(f"substr({digits}, {n - 1 + k}, 1)::INT = {_check(digits, w)}" for k, w in enumerate(weights))])


@query(f"""WITH x AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 1000000007)::VARCHAR, 11, '0') AS d FROM orders) SELECT o_orderkey, {_valid("d", 11, br.CPF_WEIGHTS)} AS ok,
CASE WHEN {_valid("d", 11, br.CPF_WEIGHTS)} THEN d[1:3] || '.' || d[4:6] || '.' || d[7:9] || '-' || d[10:11] ELSE d END AS shown FROM x""")
def cpf_check(spark, d):
    number = F.lpad((F.col("o_orderkey") * 7919 % 1000000007).cast("string"), 11, "0")
    return _t(spark, d, "orders").select("o_orderkey", br.is_cpf(number).alias("ok"), br.format_cpf(number).alias("shown"))


@query(f"""WITH x AS (SELECT o_orderkey, lpad((o_orderkey * 104729)::VARCHAR, 14, '0') AS d FROM orders) SELECT o_orderkey, {_valid("d", 14, br.CNPJ_WEIGHTS)} AS ok FROM x""")
def cnpj_check(spark, d):
    number = F.lpad((F.col("o_orderkey") * 104729).cast("string"), 14, "0")
    return _t(spark, d, "orders").select("o_orderkey", br.is_cnpj(number).alias("ok"))


PHONE_SQL = f"substr(p, 1, 2) IN ({', '.join(repr(a) for a in br.AREA_CODES)}) AND ((length(p) = 11 AND substr(p, 3, 1) = '9') OR (length(p) = 10 AND substr(p, 3, 1) BETWEEN '2' AND '5'))"


@query(f"""WITH x AS (SELECT o_orderkey, (10 + o_orderkey % 90)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '9' || lpad((o_orderkey * 31 % 100000000)::VARCHAR, 8, '0') ELSE lpad((o_orderkey * 31 % 100000000)::VARCHAR, 8, '3') END AS p FROM orders)
SELECT o_orderkey, {PHONE_SQL} AS ok FROM x""")
def phone_check(spark, d):
    k = F.col("o_orderkey")
    tail = (k * 31 % 100000000).cast("string")
    number = F.concat((10 + k % 90).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("9"), F.lpad(tail, 8, "0"))).otherwise(F.lpad(tail, 8, "3")))
    return _t(spark, d, "orders").select("o_orderkey", br.is_phone(number).alias("ok"))


@query("""SELECT c_custkey, regexp_full_match(e, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AS email_ok, regexp_full_match(c_custkey::VARCHAR, '[+-]?[0-9]+') AS int_ok, regexp_full_match(c_name, 'Customer#[0-9]+') AS regex_ok,
length(c_mktsegment) >= 9 AS length_ok FROM (SELECT *, replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '@' ELSE '' END) || CASE WHEN c_custkey % 3 = 0 THEN '.com' ELSE '' END AS e FROM customer)""")
def cell_predicates(spark, d):
    name, key = F.col("c_name"), F.col("c_custkey")
    mail = F.concat(F.when(key % 2 == 0, F.replace(name, F.lit("#"), F.lit("@"))).otherwise(F.replace(name, F.lit("#"), F.lit(""))), F.when(key % 3 == 0, ".com").otherwise(""))
    return _t(spark, d, "customer").select(
        "c_custkey", text.full_match(mail, parse.EMAIL).alias("email_ok"), parse.is_int(key.cast("string")).alias("int_ok"), text.full_match(name, "Customer#[0-9]+").alias("regex_ok"), (F.length(text.strip(F.col("c_mktsegment"))) >= 9).alias("length_ok")
    )


# --- cleaning and masking ---------------------------------------------------------------------

COLLAPSE = f"trim(regexp_replace(text, '{text.SPACE_RE2}+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id AS line, md5({COLLAPSE}) AS cleaned FROM documents WHERE {COLLAPSE} <> text")
def clean_text_trail(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("line"), "text")
    return cleaning.clean(docs, rules.Schema([rules.ColumnRules("text")]))[1].select("line", F.md5("cleaned").alias("cleaned"))


@query("""SELECT c_custkey + 1 AS line, CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END || upper(c_name) || '@X.com' AS original, lower(c_name) || '@x.com' AS cleaned,
CASE WHEN c_custkey % 2 = 0 THEN 'espacos,minusculo' ELSE 'minusculo' END AS rules FROM customer""")
def clean_cells(spark, d):
    c = _t(spark, d, "customer").select((F.col("c_custkey") + 1).alias("line"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(""), F.upper("c_name"), F.lit("@X.com")).alias("email"))
    changes = cleaning.clean(c, rules.Schema([rules.ColumnRules("email", format="email")]))[1]
    return changes.select("line", "original", "cleaned", F.array_join("rules", ",").alias("rules"))


def _masked_sql(c: str) -> str:
    for pattern, by in text.MASKS:
        c = f"regexp_replace({c}, '{pattern}', '{by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return c


@query(f"SELECT doc_id, md5({_masked_sql('text')}) AS masked, {_masked_sql('text')} <> text AS changed FROM documents")
def mask_documents(spark, d):
    masked = text.mask_text(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(masked).alias("masked"), (masked != F.col("text")).alias("changed"))


@query("SELECT conv_id, turn, '***' AS access_token, role FROM conversations")
def mask_by_key(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("access_token"), "role")
    return c.select(*web.masked_struct(c.schema))


# --- pages, routing, delivery -----------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE html LIKE '%<title>%'")
def html_titles(spark, d):
    found = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").contains("<title>").alias("has"))
    return found.filter("has").drop("has")


@query()
def html_links(spark, d):
    """A row per link: its text and where it leads."""
    return pages_source.scrape(_t(spark, d, "pages"), "a", {"text": ":scope", "href": "@href"})


@query()
def html_paragraphs(spark, d):
    """A row per paragraph, heading (h1) and link of a page, its text in the column of its kind."""
    return pages_source.scrape(_t(spark, d, "pages"), "p, h1, a[href]", {"paragraph": "p:scope", "heading": "h1:scope", "link": "a:scope", "href": "@href"})


PART_ROUTES = routing.Routes(
    (routing.Route("brand1", ("Brand#1*",), "b1/{ext}"), routing.Route("even", ("*[02468]",), "even"), routing.Route("three", ("*#?3",), "three")), target_root="out", action="copy"
)


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN p_brand LIKE 'Brand#1%' THEN 'brand1' WHEN regexp_matches(p_brand, '[02468]$') THEN 'even' WHEN regexp_matches(p_brand, '#.3$') THEN 'three' ELSE 'unmatched' END AS rule FROM part) GROUP BY rule""")
def route_parts(spark, d):
    return _t(spark, d, "part").groupBy(routing.matched_rule(F.col("p_brand"), PART_ROUTES).alias("rule")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'brand1' WHEN regexp_matches(p_brand, '[02468]$') THEN 'even' ELSE 'unmatched' END AS rule FROM part""")
def route_by_table(spark, d):
    table = spark.createDataFrame([(0, "brand1", routing.glob("Brand#1*")), (1, "even", routing.glob("*[02468]"))], "ord int, rule string, regex string")
    return routing.matched_by_table(_t(spark, d, "part").select("p_partkey", "p_brand"), table, "p_brand").select("p_partkey", "rule")


@query("""SELECT o_orderkey, 'docs/' || strftime(o_orderdate, '%Y/%m') || '/' || o_orderkey || '.PDF' AS destination, 'moved' AS status FROM orders""")
def route_plan(spark, d):
    files = _t(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("name"), F.col("o_orderdate").alias("modificationTime"))
    return routing.plan(files, routing.Routes((routing.Route("pdf", ("*.PDF",), "{year}/{month:02d}"),), "docs")).select("o_orderkey", "destination", "status")


@query("""WITH files AS (SELECT o_orderkey, 'docs/' || (o_custkey % 300) AS stem FROM orders),
existing AS (SELECT DISTINCT 'docs/' || (c_custkey % 290) AS stem, CASE c_custkey % 3 WHEN 0 THEN 0 ELSE c_custkey % 7 + 1 END AS k FROM customer),
ranked AS (SELECT f.o_orderkey, f.stem, row_number() OVER (PARTITION BY f.stem ORDER BY o_orderkey) - CASE WHEN e.stem IS NULL THEN 1 ELSE 0 END AS r FROM files f LEFT JOIN (SELECT stem FROM existing WHERE k = 0) e USING (stem)),
free AS (SELECT s.stem, g.k, row_number() OVER (PARTITION BY s.stem ORDER BY g.k) AS r FROM (SELECT DISTINCT stem FROM files) s, (SELECT unnest(range(1, 1001)) AS k) g WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.stem = s.stem AND e.k = g.k))
SELECT o_orderkey, CASE WHEN ranked.r = 0 THEN ranked.stem || '.pdf' ELSE ranked.stem || '_' || free.k || '.pdf' END AS destination, CASE WHEN ranked.r > 0 AND free.k IS NULL THEN 'error' ELSE 'moved' END AS status
FROM ranked LEFT JOIN free ON ranked.stem = free.stem AND ranked.r = free.r""")
def route_clashes(spark, d):
    """Many files of one name, to where some of these names and of the numbered ones are taken."""
    files = _t(spark, d, "orders").select("o_orderkey", F.concat((F.col("o_custkey") % 300).cast("string"), F.lit(".pdf")).alias("name"), F.col("o_orderdate").alias("modificationTime"))
    k = F.col("c_custkey")
    existing = _t(spark, d, "customer").select(F.concat(F.lit("docs/"), (k % 290).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), (k % 7 + 1).cast("string"))), F.lit(".pdf")).alias("path"))
    routes = routing.Routes((routing.Route("pdf", ("*.pdf",), ""),), "docs", on_conflict="rename")
    return routing.plan(files, routes, existing, "o_orderkey").select("o_orderkey", "destination", "status")


@query("""SELECT o_orderkey, substr(sha256('{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '"}'), 1, 32) AS key FROM orders""")
def idempotency_keys(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", web.idempotency_key(["o_orderkey", "o_custkey", "o_orderpriority"]).alias("key"))


STATUSES = (200, 201, 400, 409, 422, 429, 500, 503, 302)


def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % len(STATUSES) + 1).cast("int"))
    return delivery.with_outcome(_t(spark, d, "orders").select(k.alias("line"), status.alias("status_http"), F.concat(F.lit('{"data": {"id": '), k.cast("string"), F.lit("}}")).alias("_body")))


OUTCOMES_SQL = f"""outcomes AS (SELECT line, CASE WHEN s BETWEEN 200 AND 299 THEN 'sucesso' WHEN s IN (400, 422) THEN 'validacao' WHEN s = 409 THEN 'duplicado' WHEN s = 429 THEN 'rate_limit' WHEN s >= 500 THEN 'temporario' ELSE 'outro' END AS categoria,
  s BETWEEN 200 AND 299 AS sucesso, s = 429 OR s >= 500 AS pode_reenviar, CASE WHEN s BETWEEN 200 AND 299 THEN line::VARCHAR END AS id_externo
  FROM (SELECT o_orderkey AS line, ({list(STATUSES)})[o_orderkey % {len(STATUSES)} + 1] AS s FROM orders))"""


@query(f"WITH {OUTCOMES_SQL} SELECT * FROM outcomes")
def http_outcomes(spark, d):
    return answers(spark, d).select("line", "categoria", "sucesso", "pode_reenviar", "id_externo")


@query(f"WITH {OUTCOMES_SQL} SELECT categoria, count(*) AS n FROM outcomes WHERE NOT sucesso GROUP BY categoria")
def failures_by_category(spark, d):
    return delivery.failures_by_category(answers(spark, d))


@query(f"WITH {OUTCOMES_SQL} SELECT count(*) FILTER (sucesso) AS sent, count(*) FILTER (NOT sucesso) AS failed, count(*) FILTER (NOT sucesso AND pode_reenviar) AS resendable, 'partial' AS status FROM outcomes")
def outcome_rollup(spark, d):
    return delivery.roll_up(answers(spark, d))


@query(f"WITH {OUTCOMES_SQL} SELECT line FROM outcomes WHERE NOT sucesso AND pode_reenviar")
def resendable(spark, d):
    return delivery.sent_and_failed(answers(spark, d).filter("sucesso or pode_reenviar"))[1].select("line")


@query("""SELECT o_orderkey AS line, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS is_replay FROM orders""")
def idempotent_replay(spark, d):
    keyed = _t(spark, d, "orders").select(F.col("o_orderkey").alias("line"), web.idempotency_key(["o_custkey", "o_orderstatus"]).alias("idempotency_key"))
    return delivery.replayed(keyed).select("line", "is_replay")


@query("""SELECT c_custkey, 'Ola ' || c_name || ', segmento ' || c_mktsegment || '!' AS message, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE '-' || c_custkey END AS chat_id FROM customer""")
def template_render(spark, d):
    c = _t(spark, d, "customer")
    chat = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" -"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", text.render("Ola {c_name}, segmento {c_mktsegment}{nada}!", c.columns).alias("message"), text.chat_id(chat).alias("chat_id"))


@query(f"""SELECT o_orderkey AS line, CASE WHEN o_orderkey % 4 = 0 THEN 'Nome vazio' WHEN o_orderkey % 4 = 1 THEN 'Email vazio' WHEN NOT ({_valid("d", 11, br.CPF_WEIGHTS)}) THEN 'CPF invalido (modulo 11)' END AS error
FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 % 1000000007)::VARCHAR, 11, '0') AS d FROM orders)""")
def form_plan(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(k.alias("line"), F.when(k % 4 == 0, " ").otherwise("Ana").alias("nome"), F.when(k % 4 == 1, "").otherwise("a@b.co").alias("email"), F.lpad((k * 7919 % 1000000007).cast("string"), 11, "0").alias("cpf"))
    return delivery.form_plan(rows).select("line", "error")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Nome deve ter pelo menos 3 caracteres;CPF e obrigatorio' WHEN 1 THEN 'CPF e obrigatorio;Telefone deve estar no formato (XX) XXXXX-XXXX' ELSE 'Email com formato invalido;CPF e obrigatorio' END AS errors FROM customer""")
def record_errors(spark, d):
    k = F.col("c_custkey") % 3
    made = delivery.record_errors(F.when(k == 0, "An").otherwise(F.col("c_name")), F.when(k == 2, "a@b").otherwise("a@b.co"), F.lit(None).cast("string"), F.when(k == 1, "1199").otherwise(""))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(made, ";").alias("errors"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cpf' WHEN 1 THEN 'duplicado' WHEN 2 THEN 'intervalo' ELSE 'outro' END AS category FROM orders""")
def message_categories(spark, d):
    k = F.col("o_orderkey")
    message = F.when(k % 4 == 0, "CPF invalido: 'x'").when(k % 4 == 1, "Valor duplicado na coluna 'cpf'").when(k % 4 == 2, "Valor 1 menor que o minimo 2").otherwise("nada")
    return _t(spark, d, "orders").select("o_orderkey", text.message_category(message).alias("category"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def paginate_customers(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(20).limit(10)


@query("""SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS accumulated FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)""")
def running_total_pages(spark, d):
    daily = _t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    # a row per day: the only unpartitioned window here is over days
    return daily.withColumn("accumulated", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_extract_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT role, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY role")
def conversation_roles(spark, d):
    return _t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, event_id, ts, n, true AS allowed, [sec] AS hits FROM e WHERE n = 1
UNION ALL SELECT e.key, e.event_id, e.ts, e.n, len(list_filter(r.hits, lambda h: e.sec - h <= 3600)) < 2,
CASE WHEN len(list_filter(r.hits, lambda h: e.sec - h <= 3600)) < 2 THEN list_append(list_filter(r.hits, lambda h: e.sec - h <= 3600), e.sec) ELSE list_filter(r.hits, lambda h: e.sec - h <= 3600) END
FROM r JOIN e ON r.key = e.key AND e.n = r.n + 1)
SELECT key, event_id, ts, allowed FROM r""")
def rate_limit_60s(spark, d):
    hits = _t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return streams.rate_limited_batch(hits, 2, 3600.0)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hits FROM events")
def hits_in_window(spark, d):
    hits = _t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return streams.hits_in_window(hits, 3600).select("event_id", "hits")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", ' || c_nationkey AS note, CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""")
def delimited_customers(spark, d):
    """Customers from delimited files that Spark has written, each with its header, with quotes and line ends in cells."""
    from ..sources.files import shared_dir
    from ..sources.tabular import read_delimited

    c, path = _t(spark, d, "customer"), shared_dir(spark, "customers")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", '), F.col("c_nationkey").cast("string"))
    c.select("c_custkey", note.alias("note"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey")).alias("nation")).repartition(3).write.csv(path, header=True, escape='"')
    return read_delimited(spark, path).select("c_custkey", "note", "nation")


@query("SELECT count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages")
def directory_fingerprint(spark, d):
    from ..sources.files import fingerprint

    return fingerprint(_t(spark, d, "pages").select(F.octet_length("html").cast("long").alias("length")))


@query("""SELECT page_id, url, regexp_matches(url, '^https?://[^/ ]+') AS safe, sha256(url) AS digest FROM pages""")
def url_guards(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", "url", web.is_safe_url(F.col("url")).alias("safe"), F.sha2("url", 256).alias("digest"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unvisited_pages(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url")
    return p.join(p.filter("page_id % 3 = 0").select("url"), "url", "left_anti")

