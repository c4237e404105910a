"""Which sheet is a table, and which of its rows is the header, by figures over cells.

Cells are rows (sheet, line, col, value), lines and columns from 1. What a sheet or a row scores is a
few grouped aggregates; only the scores, a row per sheet and one for each of its first lines, come to
the driver.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import is_blank, strip

# Lines that may be a header, filled lines below that are looked at, and how many of them count in full;
# what the marks of a header and of a sheet weigh; and the limits of a choice.
SCAN_ROWS, TYPE_ROWS, ROWS_BELOW = 20, 5, 3
HEADER = {"coverage": 0.25, "texts": 0.25, "distinct": 0.15, "agreement": 0.15, "below": 0.20}
SHEET = {"density": 0.30, "steady": 0.25, "regular": 0.15, "volume": 0.10, "header": 0.20}
STEADY_SHARE, LEAST_STEADY, MOST_IF_SPREAD, FULL_VOLUME = 0.5, 0.3, 0.2, 10
NEAR_BEST, OTHERS = 0.85, 3
MIN_SHEET, MARGIN = 0.35, 0.15


class Rejected(ValueError):
    """The file holds no table that can be told apart."""


def header_scores(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """Rows (sheet, line, score) of the lines that may be headers; ``widths`` has (sheet, width)."""
    filled = cells.filter(~is_blank(F.col("value"))).select("sheet", "line", "col", strip(F.col("value")).alias("value"), parse.cell_type(F.col("value")).alias("kind"))
    lines = filled.groupBy("sheet", "line").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "texto").alias("texts"), F.count_distinct("value").alias("names"))
    by_line = W.partitionBy("sheet").orderBy("line")
    # of the lines behind those that may be a header only the first few can stand below one
    later = lines.filter(F.col("line") > SCAN_ROWS).withColumn("k", F.row_number().over(by_line)).filter(F.col("k") <= TYPE_ROWS).drop("k")
    near = lines.filter(F.col("line") <= SCAN_ROWS).unionByName(later).withColumn("k", F.row_number().over(by_line))
    candidates = near.filter((F.col("line") <= SCAN_ROWS) & (F.col("n") >= 2))
    below = candidates.select("sheet", F.col("line").alias("header"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + TYPE_ROWS)).alias("k")).join(near.select("sheet", "line", "k"), ["sheet", "k"])
    kinds = below.join(filled, ["sheet", "line"]).groupBy("sheet", "header", "col", "kind").agg(F.count("*").alias("n"))
    agreed = kinds.groupBy("sheet", "header", "col").agg((F.max("n") / F.sum("n")).alias("share")).groupBy("sheet", "header").agg(F.sum("share").alias("agreed"))
    rows = below.groupBy("sheet", "header").agg(F.count("*").alias("below")).join(agreed, ["sheet", "header"]).withColumnRenamed("header", "line")
    marks = {
        "coverage": F.col("n") / F.col("width"),
        "texts": F.col("texts") / F.col("n"),
        "distinct": F.col("names") / F.col("n"),
        "agreement": F.col("agreed") / F.col("width"),
        "below": F.least(F.col("below") / ROWS_BELOW, F.lit(1.0)),
    }
    score = sum((weight * marks[mark] for mark, weight in HEADER.items()), F.lit(0.0))
    return candidates.join(rows, ["sheet", "line"]).join(widths, "sheet").select("sheet", "line", F.round(score, 3).alias("score"))


def headers(scores: DataFrame) -> DataFrame:
    """Rows (sheet, header_row, confidence, alternatives): the line of the highest score, the upper one of equals, and others nearly as good."""
    best = scores.filter("score > 0").groupBy("sheet").agg(F.max(F.struct("score", (-F.col("line")).alias("above"))).alias("best"), F.sort_array(F.collect_list(F.struct("score", (-F.col("line")).alias("above"))), asc=False).alias("all"))
    near = F.filter("all", lambda x: (x["above"] != F.col("best.above")) & (x["score"] >= NEAR_BEST * F.col("best.score")))
    return best.select("sheet", (-F.col("best.above")).alias("header_row"), F.col("best.score").alias("confidence"), F.transform(F.slice(near, 1, OTHERS), lambda x: -x["above"]).alias("alternatives"))


def sheet_scores(cells: DataFrame, widths: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (sheet, score, reason): how much each sheet of ``widths`` looks like a table; ``found`` is what ``headers`` gives."""
    filled = cells.filter(~is_blank(F.col("value")))
    lines = filled.groupBy("sheet", "line").agg(F.count("*").alias("n"))
    sizes = lines.groupBy("sheet", "n").agg(F.count("*").alias("rows")).groupBy("sheet").agg(F.sum("rows").alias("rows"), F.sum(F.col("n") * F.col("rows")).alias("cells"), F.max("rows").alias("common"))
    columns = filled.groupBy("sheet", "col").agg(F.count("*").alias("in_col")).join(sizes.select("sheet", "rows"), "sheet")
    steady = columns.groupBy("sheet").agg(F.count_if(F.col("in_col") >= STEADY_SHARE * F.col("rows")).alias("steady"))
    of = widths.join(sizes, "sheet", "left").join(steady, "sheet", "left").join(found.select("sheet", "confidence"), "sheet", "left").na.fill(0)
    share = F.col("steady") / F.col("width")
    marks = {
        "density": F.col("cells") / (F.col("rows") * F.col("width")),
        "steady": share,
        "regular": F.col("common") / F.col("rows"),
        "volume": F.least(F.col("rows") / FULL_VOLUME, F.lit(1.0)),
        "header": F.col("confidence"),
    }
    score = sum((weight * marks[mark] for mark, weight in SHEET.items()), F.lit(0.0))
    told = lambda points, reason: F.struct(F.round(points, 3).alias("score"), reason.alias("reason"))
    spread = F.concat(F.lit("colunas espalhadas ("), F.round(share * 100).cast("int"), F.lit("% consistentes): nao parece uma tabela"))
    verdict = (
        F.when(F.col("rows") == 0, told(F.lit(0.0), F.lit("aba vazia")))
        .when(F.col("width") < 2, told(F.lit(0.05), F.lit("menos de 2 colunas: nao e uma tabela")))
        .when(F.col("rows") < 2, told(F.lit(0.1), F.lit("poucas linhas preenchidas")))
        .when(share < LEAST_STEADY, told(F.least(score, F.lit(MOST_IF_SPREAD)), spread))
        .otherwise(told(score, F.concat(F.col("rows"), F.lit(" linhas x "), F.col("width"), F.lit(" colunas"))))
    )
    return of.withColumn("told", verdict).select("sheet", "told.score", "told.reason")


def choose_sheet(scores: dict[str, float], wanted: str | None = None) -> str:
    """The named sheet, or the best one if it is good and no other is close."""
    if wanted is not None:
        if wanted not in scores:
            raise Rejected(f"aba '{wanted}' nao existe. Abas disponiveis: {', '.join(scores)}")
        return wanted
    ranked = sorted(scores, key=lambda s: -scores[s])
    if not ranked or scores[ranked[0]] < MIN_SHEET:
        raise Rejected("nenhuma aba parece uma tabela")
    close = [s for s in ranked[1:] if scores[ranked[0]] - scores[s] < MARGIN]
    if close:
        raise Rejected(f"mais de uma aba parece uma tabela: {', '.join([ranked[0], *close])}")
    return ranked[0]


def unique_names(row: list[str | None]) -> list[str]:
    """Blank names are ``coluna_N``; repeats get ``_1``, ``_2``."""
    seen, out = Counter(), []
    for i, cell in enumerate(row):
        name = (cell or "").strip() or f"coluna_{i + 1}"
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out
