"""Delivering rows: outcomes of each row from an injected transport, their roll-up and split.

A row's key is the same in every attempt, so that a task that Spark repeats is recognised by the
receiver; outcomes are stored before anything reads them twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.web import external_id, idempotency_key, may_resend, status_category

#: A transport takes (payload, headers) and gives (status, body, headers); it raises ConnectionError where there is no answer.
Transport = Callable[[dict, dict], tuple[int, str, dict]]


@dataclass(frozen=True)
class Retry:
    """Waits 0.5 s, doubled, up to ``longest``; what the receiver asks for goes before, up to ``longest_asked``."""

    attempts: int = 3
    first: float = 0.5
    longest: float = 5.0
    longest_asked: float = 30.0
    jitter: float = 0.25
    on: tuple[int, ...] = (429,)

    def wait(self, attempt: int, asked: str | None) -> float:
        if asked and asked.strip().isdigit():
            return min(float(asked), self.longest_asked)
        base = min(self.first * 2**attempt, self.longest)
        return base + random.uniform(0, self.jitter * base)

    def again(self, status: int) -> bool:
        return status in self.on or status >= 500


def call(transport: Transport, payload: dict, headers: dict, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, str, int]:
    """Status (null without an answer), body, and attempts made."""
    for attempt in range(retry.attempts):
        try:
            status, body, back = transport(payload, headers)
        except ConnectionError as e:
            status, body, back = None, str(e), {}
        if attempt + 1 == retry.attempts or status is not None and not retry.again(status):
            break
        sleep(retry.wait(attempt, back.get("Retry-After")))
    return status, body, attempt + 1


def without_meta(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_")))


def payload_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c != "line"]


def send(df: DataFrame, transport: Transport, outcomes: str, retry: Retry | None = None, dry_run: bool = False) -> DataFrame:
    """``df`` with status_http, categoria, sucesso, mensagem, id_externo, idempotency_key, tentativas, pode_reenviar.

    Rows are sent here, a call and its retries each, and their outcomes written to ``outcomes``, a new folder that
    all executors share (an existing one is an error). What is returned reads that folder, so no use of it sends again.
    """
    names, retry = payload_columns(df), retry or Retry()
    keyed = df.withColumn("idempotency_key", idempotency_key(names))
    if dry_run:
        answered = keyed.withColumns({"status_http": F.lit(None).cast("int"), "_body": F.lit(""), "tentativas": F.lit(0)})
    else:
        schema = T.StructType([*keyed.schema.fields, T.StructField("status_http", T.IntegerType()), T.StructField("_body", T.StringType()), T.StructField("tentativas", T.IntegerType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers = [call(transport, {n: "" if row[n] is None else str(row[n]) for n in names}, {"Idempotency-Key": row["idempotency_key"]}, retry) for row in batch.to_dict("records")]
                yield batch.assign(status_http=pd.array([a[0] for a in answers], "Int32"), _body=[a[1] for a in answers], tentativas=[a[2] for a in answers])

        answered = keyed.mapInPandas(run, schema)
    told = with_outcome(answered).drop("_body")
    told.write.parquet(outcomes)
    return df.sparkSession.read.schema(told.schema).parquet(outcomes)


def with_outcome(answered: DataFrame) -> DataFrame:
    """What status_http and _body mean; a body that says ``"ok": false`` is a failure whatever the status."""
    status, body = F.col("status_http"), F.col("_body")
    refused = F.when(strip(body).startswith("{"), F.get_json_object(body, "$.ok") == "false")
    good = status.between(200, 299) & ~F.coalesce(refused, F.lit(False))
    told = F.coalesce(strip(F.get_json_object(body, "$.description")), F.lit("resposta ok=false"))
    return answered.withColumns(
        {
            "categoria": F.when(status.isNull(), "temporario").when(status.between(200, 299) & ~good, "outro").otherwise(status_category(status)),
            "sucesso": F.coalesce(good, F.lit(False)),
            "mensagem": F.when(good, "").when(status.between(200, 299), F.substring(told, 1, 120)).otherwise(F.substring(body, 1, 120)),
            "id_externo": F.when(good, external_id(body)),
            "pode_reenviar": status.isNull() | may_resend(status),
        }
    )


def failures_by_category(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(~F.col("sucesso")).groupBy("categoria").agg(F.count("*").alias("n"))


def roll_up(outcomes: DataFrame) -> DataFrame:
    """One row: sent, failed, resendable, and the run's status."""
    out = outcomes.agg(F.count_if("sucesso").alias("sent"), F.count_if(~F.col("sucesso")).alias("failed"), F.count_if(~F.col("sucesso") & F.col("pode_reenviar")).alias("resendable"))
    return out.withColumn("status", run_status(F.col("sent"), F.col("failed")))


def run_status(sent: Column, failed: Column, skipped: Column | None = None) -> Column:
    """Nothing failed: success (all skipped as well); nothing sent: failure; else partial."""
    return F.when(failed == 0, "success").when((sent == 0) & (F.lit(True) if skipped is None else skipped == 0), "failure").otherwise("partial")


def sent_and_failed(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that went out, and those that didn't, fit to be sent again (without the outcome's columns)."""
    made = ("idempotency_key", "status_http", "tentativas", "categoria", "sucesso", "mensagem", "id_externo", "pode_reenviar")
    return outcomes.filter("sucesso"), outcomes.filter("not sucesso").drop(*made)


def report_rows(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Input rows with ``_resultado`` and ``_mensagem``, joined by line."""
    told = outcomes.select("line", F.when(F.col("sucesso"), "sucesso").otherwise(F.col("categoria")).alias("_resultado"), F.col("mensagem").alias("_mensagem"))
    return rows.join(told, "line", "left")


def replayed(df: DataFrame, key: str = "idempotency_key", order: str = "line") -> DataFrame:
    """``df`` and ``is_replay``: whether an earlier row had the same key."""
    return df.withColumn("is_replay", F.row_number().over(W.partitionBy(key).orderBy(order)) > 1)


def form_plan(df: DataFrame) -> DataFrame:
    """What a form robot would do per row: status would_create or would_skip, and the first reason."""
    from ..functions.br import is_cpf

    blank = lambda n: F.coalesce(strip(F.col(n)), F.lit("")) == ""
    reason = F.when(blank("nome"), "Nome vazio").when(blank("email"), "Email vazio").when(blank("cpf"), "CPF vazio").when(~is_cpf(F.col("cpf")), "CPF invalido (modulo 11)")
    return df.withColumn("error", reason).withColumn("status", F.when(F.col("error").isNull(), "would_create").otherwise("would_skip"))


def record_errors(nome: Column, email: Column, cpf: Column, telefone: Column) -> Column:
    """What a registry would refuse in a record, as an array of messages."""
    n, e, c, t = (F.coalesce(strip(x), F.lit("")) for x in (nome, email, cpf, telefone))
    return F.array_compact(
        F.array(
            F.when(n == "", "Nome e obrigatorio").when(F.length(n) < 3, "Nome deve ter pelo menos 3 caracteres"),
            F.when(e == "", "Email e obrigatorio").when(~F.lower(e).rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"), "Email com formato invalido"),
            F.when(c == "", "CPF e obrigatorio").when(~c.rlike(r"\A[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\z"), "CPF deve estar no formato XXX.XXX.XXX-XX"),
            F.when((t != "") & ~t.rlike(r"\A\([0-9]{2}\)\s?[0-9]{4,5}-[0-9]{4}\z"), "Telefone deve estar no formato (XX) XXXXX-XXXX"),
        )
    )
