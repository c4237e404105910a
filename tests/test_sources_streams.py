"""Files, pages, sinks and streams."""

import csv
import datetime
import gc
import io
import json
import re
import zipfile
from html import unescape

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.plans import catalog
from crivo.sources import detect, files, sinks, tabular, walk, web, workbook, xlsx
from crivo.streaming import events


def write(tmp_path, name, data, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(data.encode(encoding))
    return str(path)


@pytest.mark.parametrize(
    "data,encoding,header,names,lines",
    [
        ("nome,idade,cidade\nAna,30,Rio\nBia,31,Sao\nCai,32,Ita\n", "utf-8", 1, ["nome", "idade", "cidade"], [2, 3, 4]),
        ("Relatorio;;\n;;\nprodução;qtd;qtd\nmaçã;1;2\npêra;3;4\nuva;5;6\n", "latin-1", 3, ["produção", "qtd", "qtd_1"], [4, 5, 6]),
        ("﻿a\tb\nx\t1\n\t\ny\t2\nz\t3\n", "utf-8", 1, ["a", "b"], [2, 4, 5]),
    ],
)
def test_delimited(spark, tmp_path, data, encoding, header, names, lines):
    path = write(tmp_path, "t.csv", data, encoding)
    found = tabular.sniff(spark, path)
    assert (found.header_row, found.names) == (header, names)
    df = tabular.read_delimited(spark, path)
    assert df.columns == [*names, "line"] and sorted(r["line"] for r in df.collect()) == lines


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_encoding_by_all_lines(spark, tmp_path, encoding):
    path = write(tmp_path, "t.csv", "nome,qtd\n" + "".join(f"p{i},{i}\n" for i in range(200)) + "maçã,200\n", encoding)
    assert tabular.sniff(spark, path).encoding == {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding]
    rows = {r["line"]: r["nome"] for r in tabular.read_delimited(spark, path).collect()}
    assert len(rows) == 201 and rows[202] == "maçã"


def test_quoted_line_ends(spark, tmp_path):
    head = 'nome,obs,qtd\n'
    body = "".join(f'n{i},"linha 1\n\nlinha, ""2"" de {i}\n",{i}\n' if i % 3 == 0 else f'n{i},5" tubo,{i}\n' if i % 3 == 1 else f'"n{i}",,{i}\n\n' for i in range(300))
    path = write(tmp_path, "q.csv", head + body)
    want = [(*(c or None for c in r), k) for k, r in enumerate(csv.reader(io.StringIO(head + body)), 1) if k > 1 and r]
    splits = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    was = [spark.conf.get(c) for c in splits]
    try:
        for size in (was[0], "37", "400"):
            spark.conf.set(splits[0], size)
            spark.conf.set(splits[1], was[1] if size == was[0] else "0")
            assert sorted(map(tuple, tabular.read_delimited(spark, path).collect()), key=lambda r: r[-1]) == want
    finally:
        for c, v in zip(splits, was, strict=True):
            spark.conf.set(c, v)
    with pytest.raises(tabular.Rejected):
        tabular.read_delimited(spark, write(tmp_path, "open.csv", "a,b\nx,1\ny,2\nz,3\n\"w,4\nv,5\n"))


def plain(data, header=1):
    """What ``csv.reader`` reads below the header: (cells to the largest width, None where empty, line), without blank rows."""
    rows = list(csv.reader(io.StringIO(data)))
    width = max(map(len, rows))
    return sorted((*[c or None for c in r], *[None] * (width - len(r)), k) for k, r in enumerate(rows, 1) if k > header and any(c.strip() for c in r))


@pytest.fixture
def split(spark):
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    was = [spark.conf.get(c) for c in names]

    def to(size):
        for c, v in zip(names, was if size is None else (str(size), "0"), strict=True):
            spark.conf.set(c, v)

    yield to
    to(None)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[-1], str(r)))


@pytest.mark.parametrize("size", [None, 61, 700])
def test_records_whoever_reads_them(spark, tmp_path, split, size):
    """Ragged rows, quoted line ends and several files, under plans that put splits into other tasks."""
    made = [f'n{i},"x\n""{i}"",\ny",{i}\n' if i % 5 == 0 else f"n{i},p{i},{i},mais,{i}\n" if i % 7 == 0 else f"n{i}\n" if i % 11 == 0 else f"n{i},p,{i}\n" for i in range(400)]
    body = "".join(made)
    path = write(tmp_path, "r.csv", "nome,obs,qtd\n" + body)
    split(size)
    df = tabular.read_delimited(spark, path)
    want = plain("nome,obs,qtd\n" + body)
    assert df.columns == ["nome", "obs", "qtd", "coluna_4", "coluna_5", "line"]
    assert order(df.collect()) == order(want)
    assert order(df.coalesce(1).collect()) == order(want)
    assert order(df.union(df).collect()) == order(want + want)
    assert order(df.repartition(3).coalesce(2).collect()) == order(want)
    few = [tuple(r) for r in df.limit(9).collect()]
    assert len(few) == 9 and set(few) <= set(want)
    (tmp_path / "many").mkdir()
    for k in range(3):
        write(tmp_path, f"many/{k}.csv", "nome,obs,qtd\n" + "".join(f"{k}-{r}" for r in made[: 40 * k + 20]) + ('"cortada\nem duas",1,2,3,4,5,6\n' if k == 1 else ""))
    both = tabular.read_delimited(spark, str(tmp_path / "many"))
    read = [plain((tmp_path / f"many/{k}.csv").read_text()) for k in range(3)]
    pad = [tuple([*r[:-1], *[None] * (8 - len(r)), r[-1]]) for rows in read for r in rows]
    assert both.columns[-2:] == ["line", "file"] and order(tuple(r)[:-1] for r in both.coalesce(1).collect()) == order(pad)
    write(tmp_path, "many/3.csv", "outro,obs,qtd\n1,2,3\n")
    with pytest.raises(tabular.Rejected):
        tabular.read_delimited(spark, str(tmp_path / "many"))


def test_changed_files_are_refused(spark, tmp_path, split):
    path = write(tmp_path, "c.csv", "a,b\n" + "x,1\n" * 100)
    df = tabular.read_delimited(spark, path)
    split(50)
    with pytest.raises(Exception, match="examine-o de novo"):
        df.count()


def test_header_far_down(spark, tmp_path):
    data = "".join(f"nota {i},,\n" for i in range(30)) + "nome,qtd,obs\nx,1,2\ny,3,4\n"
    path = write(tmp_path, "h.csv", data)
    df = tabular.read_delimited(spark, path, header_row=31)
    assert df.columns == ["nome", "qtd", "obs", "line"] and order(df.collect()) == [("x", "1", "2", 32), ("y", "3", "4", 33)]
    with pytest.raises(tabular.Rejected):
        tabular.read_delimited(spark, path, header_row=99)


@pytest.mark.parametrize("line,inside,want", [(b"a,b", False, (False, 1)), (b'"a,b', False, (True, 0)), (b'a","b', True, (True, 1)), (b'x"y,"z', False, (True, 1)), (b'"a""', False, (True, 0)), (b'""', False, (False, 0)), (b"a,b", True, (True, 0)), (b'"a"x,"b"', False, (False, 1))])
def test_advance(line, inside, want):
    assert tabular.advance(line, b",", inside) == want


def test_no_header_is_refused(spark, tmp_path):
    with pytest.raises(tabular.Rejected):
        tabular.sniff(spark, write(tmp_path, "t.csv", "so um texto\n"))
    assert tabular.read_all_text(spark, write(tmp_path, "u.csv", "a,b\n1,\n")).collect() == [("1", "")]


def scored(spark, *grids):
    """The score and header of each grid, as a sheet."""
    width = {k: max(map(len, g)) for k, g in enumerate(grids)}
    cells = spark.createDataFrame([(str(k), i, j, c) for k, g in enumerate(grids) for i, row in enumerate(g, 1) for j, c in enumerate(row, 1)], "sheet string, line long, col int, value string")
    widths = spark.createDataFrame([(str(k), w) for k, w in width.items()], "sheet string, width long")
    best = detect.headers(detect.header_scores(cells, widths))
    at = {r["sheet"]: r["header_row"] for r in best.collect()}
    return [(r["score"], r["reason"], at.get(r["sheet"])) for r in detect.sheet_scores(cells, widths, best).orderBy("sheet").collect()]


def test_sheets_are_told_apart(spark):
    table = [["produto", "qtd", "valor"], *[[f"p{i}", str(i), "1,5"] for i in range(6)]]
    panel = [[None, "Total", None, None], ["x", None, None, None], [None, None, None, "9"], [None, None, "z", None]]
    titled = [["Vendas", None, None], [None] * 3, *table, ["", " ", None]]
    good, bad, low, none, thin, short = scored(spark, table, panel, titled, [[None, ""]], [["a"], ["b"]], [["a", "b"]])
    # by hand: all cells filled, 7 rows of 10, and a header of 0.25 + 0.25 + 0.15 + 0.15 + 0.20
    assert good == (round(0.30 + 0.25 + 0.15 + 0.07 + 0.20, 3), "7 linhas x 3 colunas", 1)
    assert bad[0] <= 0.2 and low[2] == 3 and none[:2] == (0.0, "aba vazia") and thin[0] == 0.05 and short[:2] == (0.1, "poucas linhas preenchidas")
    assert detect.choose_sheet({"a": good[0], "b": bad[0]}) == "a" and detect.choose_sheet({"a": good[0], "b": bad[0]}, "b") == "b"
    for scores, wanted in (({"a": 0.9, "b": 0.85}, None), ({"a": 0.2}, None), ({"a": 0.9}, "z")):
        with pytest.raises(detect.Rejected):
            detect.choose_sheet(scores, wanted)
    assert detect.unique_names(["a", "", "a", None, "a"]) == ["a", "coluna_2", "a_1", "coluna_4", "a_2"]


def test_header_alternatives(spark):
    """Two rows that look like headers: the upper one of equals, the other named."""
    grid = [["nome", "cidade"], ["rua", "bairro"], *[[f"um{k}", f"dois{k}"] for k in "abcde"]]
    cells = spark.createDataFrame([("s", i, j, c) for i, row in enumerate(grid, 1) for j, c in enumerate(row, 1)], "sheet string, line long, col int, value string")
    best = detect.headers(detect.header_scores(cells, spark.createDataFrame([("s", 2)], "sheet string, width long"))).first()
    assert (best["header_row"], best["confidence"], best["alternatives"]) == (1, 1.0, [2, 3, 4])


def test_workbooks(spark, tmp_path):
    rows = [["Maçã <1>", 3, 1.5, True], ["Uva", 4, 2.5, False], ["Pera", 5, None, True]]
    data = xlsx.workbook({"Capa": (["Relatorio"], [["2026"]]), "Dados": (["produto", "qtd", "valor", "ok"], rows)})
    (tmp_path / "livro.xlsx").write_bytes(data)
    path = str(tmp_path / "livro.xlsx")
    assert not xlsx.has_formulas(data)
    cells = xlsx.read_cells(spark, path)
    assert cells.filter("sheet = 'Dados'").count() == 15 and cells.filter("is_formula").count() == 0
    df = xlsx.read_sheet(spark, path).orderBy("line")
    assert df.columns == ["line", "produto", "qtd", "valor", "ok"]
    assert [tuple(r) for r in df.collect()] == [(2, "Maçã <1>", "3", "1.5", "1"), (3, "Uva", "4", "2.5", "0"), (4, "Pera", "5", None, "1")]
    assert xlsx.column_number("AB12") == 28 and xlsx.column_letters(28) == "AB"


def test_sheets_are_read_to_their_end(spark, tmp_path):
    def read(sheets, **named):
        path = tmp_path / f"{'-'.join(sheets)}.xlsx"
        path.write_bytes(xlsx.workbook(sheets))
        return xlsx.read_sheet(spark, str(path), **named)

    rows = [[f"p{i}", i, i / 2] for i in range(100)]
    # a column whose first cell is in line 91
    df = read({"Dados": (["produto", "qtd", "valor"], [r + ["tarde"] if i >= 89 else r for i, r in enumerate(rows)])})
    assert df.columns == ["line", "produto", "qtd", "valor", "coluna_4"]
    assert df.count() == 100 and df.filter("coluna_4 = 'tarde'").agg(F.min("line"), F.count("*")).first() == (91, 11)
    # a sheet that starts below line 60, and headers there
    low = {"Dados": (["produto", "qtd"], [[f"p{i}", i] for i in range(9)]), "Baixo": ([], [[]] * 69 + [["a", "b"], ["x", 1], ["y", 2]])}
    assert sorted(map(tuple, read(low, sheet="Baixo", header_row=71).collect())) == [(72, "x", "1"), (73, "y", "2")]
    assert read(low, sheet="Baixo", header_row=71).columns == ["line", "a", "b"] and read(low, sheet="Baixo").count() == 3
    with pytest.raises(tabular.Rejected):
        read(low, sheet="Baixo", header_row=74)
    # a sheet that is no table after its first lines: by its head alone, as good as the other
    spread = [[None] * (i % 7) + ["x"] for i in range(500)]
    two = {"Painel": (["a", "b", "c"], [["x", 1, 2]] * 60 + spread), "Dados": (["produto", "qtd", "valor"], rows)}
    assert read(two).columns[1:] == ["produto", "qtd", "valor"]
    grid = [["a", "b", "c", *[None] * 4], *[["x", "1", "2", *[None] * 4]] * 60, *[r + [None] * (7 - len(r)) for r in spread]]
    assert scored(spark, grid)[0][0] <= 0.2


def styled(data, formats):
    """A workbook whose cells have number formats: (cell, format code)."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            body = z.read(n).decode()
            if n.endswith("sheet1.xml"):
                for k, cell in enumerate(formats, 1):
                    body = re.sub(rf'<c r="{cell}"', f'<c r="{cell}" s="{k}"', body)
                body = body.replace("<v>7</v>", "<f>3+4</f><v>7</v>")
            w.writestr(n, body)
        codes = "".join(f'<numFmt numFmtId="{200 + k}" formatCode="{f}"/>' for k, f in enumerate(formats.values()))
        xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + k}"/>' for k in range(len(formats)))
        w.writestr("xl/styles.xml", f'<styleSheet xmlns="{xlsx.NS["m"]}"><numFmts>{codes}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>')
    return out.getvalue()


def test_a_workbook_is_read_with_types_and_warnings(spark, tmp_path):
    rows = [
        ["Arroz", 43800, 0.12, 1234.125, "R$ 1.234,56", 1, None, "00123", "#N/A"],
        ["Feijao", 43801.5, 0.5, 10, "R$ 10,00", 7, None, "00124", "#N/A"],
        [None] * 9,
        ["Milho", 43802, 1, 5.5, "R$ 7,10", "uma duzia", None, "00125", "#N/A"],
        ["Milho", 43802, 1, 5.5, "R$ 7,10", "uma duzia", None, "00125", "#N/A"],
        ["TOTAL", None, None, 1255.125, None, None, None, None, None],
    ]
    names = ["produto", "data", "margem", "valor", "preco", "quantidade", "vazio", "codigo", "erro"]
    formats = {f"B{k}": "dd/mm/yyyy" for k in (2, 5, 6)} | {"B3": "dd/mm/yyyy hh:mm"} | {f"C{k}": "0%" for k in (2, 3, 5, 6)}
    (tmp_path / "v.xlsx").write_bytes(styled(xlsx.workbook({"Dados": (names, rows)}), formats))
    got = workbook.read_table(spark, str(tmp_path / "v.xlsx"))
    assert (got.rejected_reason, got.selected_sheet, got.header_row, got.file_type, got.skipped_empty_rows) == (None, "Dados", 1, "xlsx", 1)
    assert got.confidence == min(got.sheets[0]["score"], got.header_confidence) > 0.5
    types = {c["name"]: c["inferred_type"] for c in got.columns}
    assert types == {"produto": "texto", "data": "misto", "margem": "percentual", "valor": "decimal", "preco": "moeda", "quantidade": "misto", "vazio": "vazio", "codigo": "identificador", "erro": "erro"}
    assert {c["name"]: c["excel_number_format"] for c in got.columns}["margem"] == "0%"
    typed = got.typed.orderBy("line").collect()
    assert [r["valor"] for r in typed] == [1234.125, 10.0, 5.5, 5.5, 1255.125] and [r["margem"] for r in typed] == [0.12, 0.5, 1.0, 1.0, None]
    assert [r["preco"] for r in typed][:2] == [1234.56, 10.0] and [r["data"] for r in typed][:2] == ["01/12/2019", "02/12/2019 12:00:00"] and [r["line"] for r in typed] == [2, 3, 5, 6, 7]
    codes = [(w["code"], w["column"]) for w in got.warnings]
    assert codes == [("rodape_suspeito", None), ("formulas", None), ("linhas_vazias_ignoradas", None), ("coluna_mista", "data"), ("coluna_mista", "quantidade"), ("erro_excel", "erro"), ("linhas_duplicadas", None), ("coluna_vazia", "vazio")]
    assert got.warnings[0]["row"] == 7 and "1 celula" in got.warnings[1]["message"]
    assert {r["rule"] for r in got.conversions.filter("column = 'preco'").collect()} == {"moeda_br"}
    told = got.reading()
    assert told["source_file"] == "v.xlsx" and told["available_sheets"][0]["cols"] == 9


def test_numbers_beside_written_ones(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(xlsx.workbook({"Dados": (["a", "b"], [["x", 1.5], ["y", "2,75"], ["z", 3]])}))
    got = workbook.read_table(spark, str(tmp_path / "m.xlsx"))
    assert [r["b"] for r in got.typed.orderBy("line").collect()] == [1.5, 2.75, 3.0]
    # numbers of days without a date's format stay numbers
    (tmp_path / "d.xlsx").write_bytes(xlsx.workbook({"Dados": (["produto", "data"], [["x", 43800], ["y", 43801], ["z", 43802]])}))
    assert workbook.read_table(spark, str(tmp_path / "d.xlsx")).columns[1]["inferred_type"] == "inteiro"


def test_delimited_tables_and_refusals(spark, tmp_path):
    got = workbook.read_table(spark, write(tmp_path, "t.csv", "nome,idade,cidade\nAna,30,Rio\n\nBia,31,\nCai,32,Ita\n"))
    assert {c["name"]: (c["inferred_type"], c["empty_count"], c["sample_values"]) for c in got.columns} == {"nome": ("texto", 0, ["Ana", "Bia", "Cai"]), "idade": ("inteiro", 0, ["30", "31", "32"]), "cidade": ("texto", 1, ["Rio", "Ita"])}
    assert [w["code"] for w in got.warnings] == ["linhas_vazias_ignoradas"] and got.skipped_empty_rows == 1 and got.raw.count() == 3
    for name, data, reason in (("a.xls", "", ".xls antigo"), ("a.pdf", "", "extensao"), ("b.csv", "so texto\n", "cabecalho")):
        assert reason in workbook.read_table(spark, write(tmp_path, name, data)).rejected_reason
    (tmp_path / "two.xlsx").write_bytes(xlsx.workbook({n: (["a", "b"], [["x", 1], ["y", 2], ["z", 3]]) for n in ("Um", "Dois")}))
    assert "mais de uma aba" in workbook.read_table(spark, str(tmp_path / "two.xlsx")).rejected_reason
    assert workbook.read_table(spark, str(tmp_path / "two.xlsx"), sheet="Dois").raw.count() == 3


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_folders_are_walked(spark, tmp_path, tasks):
    wanted = ["a.txt", "leer.txt", "x/b.txt", "x/y/c.txt", "x/y/z/d.txt", "w/e.txt", "w/v/f.tmp.txt"]
    for name in [*wanted, "x/y/no.tmp", ".git/g", ".git/h/i.txt", "w/.git/j.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "leer.txt" else name)
    (tmp_path / "nothing").mkdir()
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        got = walk.walk(spark, path, True, (".git", "*.tmp"), tasks).collect()
        assert sorted(r["path"].split(f"{tmp_path}/")[1] for r in got) == sorted(wanted)
        assert all(r["path"].endswith(r["name"]) and r["length"] == (0 if r["name"] == "leer.txt" else len(r["path"].split(f"{tmp_path}/")[1])) for r in got)
    flat = walk.walk(spark, str(tmp_path)).orderBy("name")
    assert [r["name"] for r in flat.collect()] == ["a.txt", "leer.txt"] and flat.first()["modificationTime"] is not None
    assert walk.walk(spark, f"{tmp_path}/nothing", True).count() == 0
    fingerprint = files.fingerprint(walk.walk(spark, str(tmp_path), True, (".git",))).first()
    assert fingerprint["files"] == len(wanted) + 1


def test_footer(spark):
    df = spark.createDataFrame([(2, "a", "1", "x"), (3, "b", "2", "y"), (4, "TOTAL", "3", None)], "line long, p string, q string, r string")
    assert tabular.footer_like(df, ["p", "q", "r"]) and not tabular.footer_like(df.filter("line < 4"), ["p", "q", "r"])


HTML = """<html><body><table><tr class="row odd"><td class=n>A &amp; B</td><td><a href="/x?p=1">1</a></td></tr>
<tr class="row"><td class=n>C<br>D</td></tr></table><script>var a = "</p>";</script><a class="next" href="pg2">mais</a></body></html>"""


def test_selectors(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "<p")], "page_id long, html string")
    got = sorted(map(tuple, web.scrape(pages, "table tr.row", {"nome": "td.n", "link": "td > a[href]"}).collect()))
    assert got == [(1, 0, "A & B", "1"), (1, 1, "CD", "")]
    assert web.next_link(HTML, "http://h/a/pg1", "a.next") == "http://h/a/pg2"
    assert [n.tag for n in web.select(web.parse_html(HTML), "td:first-child, script")] == ["td", "td", "script"]
    site = {"http://h/1": '<a id=n href="2">', "http://h/2": '<a id=n href="1">'}
    assert [u for u, _ in web.follow(site.__getitem__, "http://h/1", "#n")] == ["http://h/1", "http://h/2"]
    assert len(list(web.follow(site.__getitem__, "http://h/1", "#n", 1))) == 1


PAGES = [
    (1, '<h1>Um &amp; dois</h1><p>primeiro <a href="/a?x=1&amp;y=2">ir</a></p><p>segundo</p><h1>Outro</h1><p></p><a>sem destino</a><a href=""> vazio </a>'),
    (2, '<html><body><div><p>so <b>um</b></p><a HREF="b.html" class=k><i>b</i></a></div></body></html>'),
    (3, None),
    (4, "<p>sem fim"),
]


def brute(html, tag):
    """(attributes, text) of the elements of a name, by plain search in a page without nested ones."""
    strip = lambda t: unescape(re.sub("<[^>]*>", "", t)).strip()
    return [(m[1], strip(m[2])) for m in re.finditer(rf"<{tag}\b([^>]*)>(.*?)(?:</{tag}>|\Z)", html or "", re.S)]


def href(attrs):
    m = re.search(r'href="([^"]*)"', attrs, re.I)
    return unescape(m[1]) if m else None


def test_all_links_and_paragraphs(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    links = [tuple(r) for r in catalog.html_links(spark, str(tmp_path)).collect()]
    assert sorted(links) == [(k, i, text, href(at) or "") for k, page in PAGES for i, (at, text) in enumerate(brute(page, "a"))]
    assert (1, 0, "ir", "/a?x=1&y=2") in links
    want = []
    for k, page in PAGES:
        own = [(t, "", "", "") for _, t in brute(page, "p")] + [("", t, "", "") for _, t in brute(page, "h1")] + [("", "", t, href(at)) for at, t in brute(page, "a") if href(at) is not None]
        want += [(k, i, *cells) for i, cells in enumerate(own)]
    df = catalog.html_paragraphs(spark, str(tmp_path))
    assert df.columns == ["page_id", "row", "paragraph", "heading", "link", "href"] and sorted(map(tuple, df.collect())) == want


def test_a_scraped_page_leaves_no_tree_behind():
    gc.collect()
    gc.disable()
    try:
        rows = web.extract_rows("<div><p>a<p>b<a href=x>c</a></div>" * 50, "p, a", {"text": ":scope"})
        assert len(rows) == 150 and web.next_link("<a href=n>x</a>", "http://a/", "a") == "http://a/n"
        assert not any(type(o).__name__ == "Node" for o in gc.get_objects())
    finally:
        gc.enable()


def test_scraped_rows_are_given_on_in_bounded_parts(spark):
    pages = [(2**60 + 1, "<p>x</p>" * 1000), (None, "<p>no key</p>"), (3, None), (4, ""), (5, "<p>y" + "z" * 5000 + "</p><p>w</p>")]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int64()), pa.array([h for _, h in pages], pa.string())], names=["page_id", "html"])
    want = [(k, i, *cells) for k, h in pages for i, cells in enumerate(web.extract_rows(h, "p", {"text": ":scope"}))]
    parts = list(web.scraped(batch, "p", {"text": ":scope"}, ["page_id", "row", "text"], 2_000))
    assert max(p.num_rows for p in parts) <= 20 and [tuple(r.values()) for p in parts for r in p.to_pylist()] == want
    df = web.scrape(spark.createDataFrame(pages, "page_id long, html string").coalesce(1), "p", {"text": ":scope"})
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def paged(page, per_page):
    data = [{"id": i, "sku": f"s{i}"} for i in range(47)][(page - 1) * per_page : page * per_page]
    return {"data": data, "page": page, "total_pages": -(-47 // per_page), "has_next": page * per_page < 47}


def unnumbered(page, per_page):
    return {k: v for k, v in paged(page, per_page).items() if k != "total_pages"}


def test_paged_api(spark):
    schema = T.StructType.fromDDL("id long, sku string, nada string")
    numbered = web.paged_api(spark, paged, schema, 10, name="paged_a")
    assert numbered.rdd.getNumPartitions() == 5 and sorted(r["id"] for r in numbered.collect()) == list(range(47))
    assert web.paged_api(spark, unnumbered, schema, 10, name="paged_b").count() == 47
    assert web.paged_api(spark, unnumbered, schema, 10, 2, name="paged_c").count() == 20
    waits, left = [], [ConnectionError(), ConnectionError()]

    def shaky(page, per_page):
        if left:
            raise left.pop()
        return paged(page, per_page)

    assert web.retrying(shaky, sleep=waits.append)(1, 5)["page"] == 1 and waits == [0.5, 1.0]


def test_files_and_sinks(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"f{i}.txt", "x" * i)
    listed = files.listing(spark, str(tmp_path))
    assert sorted(r["name"] for r in listed.collect()) == ["f1.txt", "f2.txt"] and tuple(files.fingerprint(listed).first()) == (2, 3)
    df = spark.createDataFrame([(1, "á", ["x"])], "id long, t string, l array<string>")
    for kind in ("csv", "json", "parquet"):
        sinks.save(df, str(tmp_path / f"o.{kind}"))
    assert spark.read.csv(str(tmp_path / "o.csv"), header=True).first()["l"] == '["x"]'
    sinks.save(df.drop("l"), str(tmp_path / "o.xlsx"))
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "o.doc"))
    assert json.loads(sinks.formatted(df, "json"))[0]["t"] == "á" and sinks.formatted(df.drop("l"), "csv").splitlines() == ["id,t", "1,á"] and "id" in sinks.formatted(df, "table")
    page = sinks.dashboard(df.select("id", F.lit("<b>").alias("t")), df.select("id"))
    assert "&lt;b&gt;" in page and "<b>" not in page
    assert len(sinks.archive([str(tmp_path / "f1.txt")], str(tmp_path / "a.zip"))) == 64
    issues = spark.createDataFrame([(2, 1), (3, 1)], "line long, seq long")
    assert sinks.first_issues(issues, 1)[1] == 1
    (tmp_path / "store.json").write_text('[{"id": 1, "cpf": "a"}, {"id": 2, "cpf": "b"}]')
    assert files.by_key(files.records(spark, str(tmp_path / "store.json"), "id long, cpf string"), F.col("cpf") == "b").first()["id"] == 2


def hits(spark, seconds, key=1):
    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(key, i, at + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)], "key long, event_id long, ts timestamp")


SECONDS = [0, 10, 20, 30, 60, 61, 71, 200, 201, 202, 400]


def plain_limiter(seconds, limit):
    kept, out = [], []
    for s in seconds:
        kept = [k for k in kept if s - k <= 60]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(s)
    return out


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    want = plain_limiter(SECONDS, 2)
    df = hits(spark, SECONDS)
    assert [r["allowed"] for r in events.rate_limited_batch(df, 2).orderBy("event_id").collect()] == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.rate_limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["allowed"] for r in spark.table("limited").orderBy("event_id").collect()] == want
    assert [r["hits"] for r in events.hits_in_window(df).orderBy("event_id").collect()][:5] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [1, 7, 60])
def test_rate_limit_over_ranges(spark, rows):
    """One key has all rows but a few, with ties in time, bursts and gaps; its ranges agree with a loop over all."""
    seconds = sorted((i * i * 37) % 900 + 3000 * (i % 3) for i in range(300))
    df = hits(spark, seconds)
    more = df.filter("event_id < 5").withColumn("key", F.col("key") + 1).unionByName(df.filter("event_id < 3").withColumn("key", F.lit(None).cast("long")))
    got = events.rate_limited_batch(df.unionByName(more), 3, range_rows=rows).orderBy("event_id").collect()
    assert len(got) == 308
    assert [r["allowed"] for r in got if r["key"] == 1] == plain_limiter(seconds, 3)
    assert [r["allowed"] for r in got if r["key"] == 2] == plain_limiter(seconds[:5], 3)
    assert [r["allowed"] for r in got if r["key"] is None] == plain_limiter(seconds[:3], 3)
    none = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, None)], df.select("key", "event_id", "ts").schema)
    assert all(r["allowed"] for r in events.rate_limited_batch(none, 1, range_rows=rows).collect())
    assert events.rate_limited_batch(df.limit(0), 1, range_rows=rows).count() == 0


def test_limiter_forgets_idle_keys(spark, tmp_path):
    """Decisions as without expiry while keys are busy; states go after 15 minutes of event time; late events are left out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "key long, event_id long, ts timestamp"
    stream = events.rate_limited_expiring(spark.readStream.schema(schema).parquet(str(folder)), 2, idle=900)
    sizes, dropped = [], []

    def feed(seconds, key, first):
        at = datetime.datetime(2026, 1, 1)
        spark.createDataFrame([(key, first + i, at + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        sizes.append(state[-1]["numRowsTotal"])
        dropped.append(sum(x["numRowsDroppedByWatermark"] for x in state))

    try:
        feed(SECONDS[:6], 1, 0)
        feed(SECONDS[6:], 1, 6)
        feed([401], 3, 90)  # two keys
        feed([5000], 2, 100)  # the watermark goes past the first key's timer
        feed([5001, 30], 2, 101)  # and an event of long ago comes
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[i] for i in range(len(SECONDS))] == plain_limiter(SECONDS, 2)
    assert got[100] and got[101] and 102 not in got and sum(dropped) == 1
    # a key's rows in the state: its hits and its timer; both first keys are gone at the end
    assert sizes[0] == sizes[1] > 0 and sizes[2] == 2 * sizes[0] and sizes[-1] == sizes[0], sizes
    with pytest.raises(ValueError):
        events.rate_limited_expiring(spark.readStream.schema(schema).parquet(str(folder)), 2, idle=10)


def test_hits_over_the_ends_of_buckets(spark):
    seconds = [(i * i * 31) % 4000 for i in range(400)]
    got = sorted((r["event_id"], r["hits"]) for r in events.hits_in_window(hits(spark, seconds)).collect())
    assert got == [(i, sum(s - 60 <= t <= s for t in seconds)) for i, s in enumerate(seconds)]
    none = spark.createDataFrame([(1, 1, None), (1, 2, None)], "key long, event_id long, ts timestamp")
    assert [r["hits"] for r in events.hits_in_window(none).collect()] == [2, 2]


def test_replays_windows_and_progress(spark, tmp_path):
    df = hits(spark, [0, 1, 2, 4000]).withColumn("idempotency_key", F.col("event_id") % 2).withColumn("event_type", F.lit("a"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = []
    spark.streams.addListener(listener := events.Progress(lambda total, n: seen.append(total)))
    for name, stream, mode in (("once", events.first_per_key(source), "append"), ("hourly", events.windowed_counts(source), "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    spark.streams.removeListener(listener)
    assert spark.table("once").count() == 2 and sorted(r["n"] for r in spark.table("hourly").collect()) == [1, 3]
    assert events.unexpired(df, datetime.datetime(2026, 1, 1, 1, 10)).count() == 1
