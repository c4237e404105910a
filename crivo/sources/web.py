"""Pages and paged APIs: extraction by selectors from stored HTML, and a data source over numbered pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Characters of scraped rows, and 100 for each row, that a task holds before it gives them on.
HELD_CHARS = 2_000_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                stack += reversed(c.children)
        return "".join(out)

    def unlink(self) -> None:
        """Takes the tree apart: its nodes point at each other, so they would stay until a garbage collection comes that far."""
        stack = [self]
        while stack:
            node = stack.pop()
            stack += [c for c in node.children if isinstance(c, Node)]
            node.parent, node.children = None, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]|:nth-of-type\((?P<nth>\d+)\)|(?P<first>:first-child)")


SCOPE = ":scope"
_COLUMN = re.compile(r"(?P<selector>.*?)(?:@(?P<attr>[\w:-]+))?", re.S)


def _fits(node: Node, simple: str) -> bool:
    for m in _SIMPLE.finditer(simple):
        d = m.groupdict()
        have = node.attrs.get(d["attr"] or "")
        ok = (
            (d["tag"] in ("*", node.tag)) if d["tag"]
            else node.attrs.get("id") == d["id"] if d["id"]
            else d["class"] in node.attrs.get("class", "").split() if d["class"]
            else [c for c in node.parent.children if isinstance(c, Node) and c.tag == node.tag].index(node) + 1 == int(d["nth"]) if d["nth"]
            else next(c for c in node.parent.children if isinstance(c, Node)) is node if d["first"]
            else have is not None and (d["op"] is None or {"=": have == d["value"], "~=": d["value"] in have.split(), "^=": have.startswith(d["value"]), "$=": have.endswith(d["value"]), "*=": d["value"] in have}[d["op"]])
        )
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """The nodes below ``root`` that a selector fits: names, #ids, .classes, [attributes], descendants, children (>), alternatives (,).

    A first step that ends with ``:scope`` is ``root`` itself, if it fits the rest of that step.
    """
    out, seen = [], set()
    for one in selector.split(","):
        parts = re.findall(r">|[^\s>]+", one.strip())
        steps, direct = [], False
        for p in parts:
            if p == ">":
                direct = True
            else:
                steps.append((p, direct))
                direct = False
        found, own = [root], bool(steps) and steps[0][0].endswith(SCOPE)
        if own:
            found = [root] if _fits(root, steps.pop(0)[0].removesuffix(SCOPE)) else []
        for simple, child in steps:
            found = list(dict.fromkeys(n for f in found for n in ((c for c in f.children if isinstance(c, Node)) if child else f.walk()) if _fits(n, simple)))
        out += [n for n in found if (own or n is not root) and not (id(n) in seen or seen.add(id(n)))]
    return out


def parse_html(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _cell(row: Node, column: str) -> str:
    m = _COLUMN.fullmatch(column)
    found = select(row, m["selector"].strip() or SCOPE)
    if not found:
        return ""
    return found[0].attrs.get(m["attr"].lower(), "") if m["attr"] else found[0].text().strip()


def each_row(html: str | None, row_selector: str, columns: dict[str, str]) -> Iterator[list[str]]:
    """The rows of ``extract_rows``, one at a time."""
    root = parse_html(html)
    try:
        for row in select(root, row_selector):
            yield [_cell(row, s) for s in columns.values()]
    finally:
        root.unlink()


def extract_rows(html: str | None, row_selector: str, columns: dict[str, str]) -> list[list[str]]:
    """A row per match of ``row_selector``: each column's first match below it as stripped text, else empty.

    ``:scope`` is the row's node itself (``a:scope``: if it is an a), and ``selector@name`` takes an
    attribute of the match and not its text; ``@name`` alone is an attribute of the row's node.
    """
    return list(each_row(html, row_selector, columns))


def next_link(html: str | None, base: str, selector: str) -> str | None:
    root = parse_html(html)
    found = select(root, selector)
    href = found[0].attrs.get("href") if found else None
    root.unlink()
    return urljoin(base, href) if href else None


def scraped(batch: pa.RecordBatch, row_selector: str, columns: dict[str, str], names: list[str], held: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (key, html) of pages, read page by page and given on in parts of about ``held`` characters."""
    page, number, cells, size = [], [], [[] for _ in columns], 0

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page, pa.int64())), pa.array(number, pa.int32()), *(pa.array(c, pa.string()) for c in cells)], names=names)

    for k in range(batch.num_rows):
        for i, row in enumerate(each_row(batch.column(1)[k].as_py(), row_selector, columns)):
            page.append(k)
            number.append(i)
            for c, x in zip(cells, row, strict=True):
                c.append(x)
            size += 100 + sum(map(len, row))
            if size >= held:
                yield part()
                page, number, cells, size = [], [], [[] for _ in columns], 0
    if page:
        yield part()


def scrape(pages: DataFrame, row_selector: str, columns: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (key, row, *columns) from stored pages: a map over pages, without a shuffle."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("row", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from scraped(batch, row_selector, columns, schema.names)

    return pages.select(key, html).mapInArrow(run, schema)


def follow(fetch: Callable[[str], str], start: str, next_selector: str, limit: int | None = None) -> Iterator[tuple[str, str]]:
    """(url, html) from ``start`` on, link by link; ends without a link, at a page seen before, or at the limit."""
    seen, url = set(), start
    while url and url not in seen and (limit is None or len(seen) < limit):
        seen.add(url)
        html = fetch(url)
        yield url, html
        url = next_link(html, url, next_selector)


class PagesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, fetch: Callable[[int, int], dict], per_page: int, last: int | None, limit: int) -> None:
        self.schema, self.fetch, self.per_page, self.last, self.limit = schema, fetch, per_page, last, limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, min(self.last, self.limit) + 1)] if self.last else [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value or 1
        while page <= self.limit:
            body = self.fetch(page, self.per_page)
            for record in body.get("data", []):
                yield tuple(record.get(f.name) for f in self.schema.fields)
            if partition.value or not body.get("has_next"):
                return
            page += 1


def paged_api(spark: SparkSession, fetch: Callable[[int, int], dict], schema: T.StructType, per_page: int = 100, max_pages: int = 10_000, name: str = "paged_api") -> DataFrame:
    """All records of an API of numbered pages ({data, total_pages?, has_next}); ``fetch(page, per_page)`` is the transport.

    Where the first page says how many there are, every page is a partition; else one task walks
    them while there is a next one.
    """
    first = fetch(1, per_page)
    last = first.get("total_pages")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PagesReader(schema, fetch, per_page, last, max_pages)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def retrying(fetch: Callable[[int, int], dict], attempts: int = 4, sleep: Callable[[float], None] | None = None) -> Callable[[int, int], dict]:
    """``fetch`` with waits of 0.5 s, doubled up to 5 s, after connection errors."""
    import time

    def run(page: int, per_page: int) -> dict:
        for k in range(attempts):
            try:
                return fetch(page, per_page)
            except ConnectionError:
                if k + 1 == attempts:
                    raise
                (sleep or time.sleep)(min(0.5 * 2**k, 5.0))
        raise AssertionError

    return run
