"""Extraction of operations from alert pages: a table function walks the document, Column functions do all else."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from marshlight.functions import constants as K
from marshlight.functions import text as X
from marshlight.session import stored
from marshlight.sources import archive

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
_LISTS, _HEADINGS, _BOLD, _INLINE = ("ul", "ol"), K.HEADING_ELEMENTS, K.BOLD_ELEMENTS, K.INLINE_ELEMENTS
_MID, _STATUS = re.compile(K.MID_PATTERN), re.compile(K.STATUS_WORD_PATTERN.replace("(?U)", ""))


class Node:
    """An element; text children are strings."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: frozenset[int] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.name not in _SILENT and id(node) not in without:
                stack += reversed(node.children)
        return "".join(out)

    def elements(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]


class _Builder(HTMLParser):
    """No implied end tags: an end tag closes to its nearest open match, without one it is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def document(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace(" ", " ").replace("’", "'").replace("​", "")).strip()


def _map_links(node: Node) -> list[Node]:
    return [a for a in node.walk() if a.name == "a" and _MID.search(a.attrs.get("href", ""))]


def _containers(root: Node) -> list[Node]:
    """Parents of the outermost lists that hold map links, in order; inside content modules if some hold any."""
    modules = [d for d in root.walk() if d.name == "div" and "DNNModuleContent" in d.attrs.get("class", "").split() and _map_links(d)]
    out: dict[int, Node] = {}
    for scope in modules or [root]:
        for link in _map_links(scope):
            top, node = None, link.parent
            while node is not None and node is not scope and node.name not in ("body", "html", ""):
                top = node if node.name in _LISTS else top
                node = node.parent
            if top is not None and top.parent is not None:
                out.setdefault(id(top.parent), top.parent)
    return list(out.values())


def _header(item: Node) -> str:
    """The item's text before its first list that has items; empty lists are passed over."""
    parts: list[str] = []
    for child in item.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.name not in _LISTS:
            parts.append(child.text() if child.name not in _SILENT else "")
        elif any(n.name == "li" for n in child.walk()):
            break
    return "".join(parts)


def _bold_run(item: Node) -> list[Node]:
    """Bold elements at the item's start; separators, line breaks and empty elements between them don't end the run."""
    run: list[Node] = []
    for child in item.children:
        if isinstance(child, str):
            if (text := _squeezed(child)) and text not in K.NAME_SEPARATORS:
                break
        elif child.name in _BOLD:
            run.append(child)
        elif child.name != "br" and _squeezed(child.text()):
            break
    return run


def _area(item: Node) -> tuple:
    run = _bold_run(item)
    named = {id(n) for r in run for n in (r, *r.walk())}
    status = next((n for n in item.walk() if n.name in _INLINE and id(n) not in named and (t := _squeezed(n.text())) and not re.search("[a-z]", t) and _STATUS.search(t)), None)
    links = [n for n in item.walk() if n.name == "a"]
    gone = frozenset(id(n) for n in (*run, *links, *([status] if status else [])))
    anchors = [(n.attrs["href"], n.text()) for n in links if "href" in n.attrs]
    return "".join(n.text() for n in run) if run else None, item.text(), status.text() if status else None, item.text(gone), anchors


AREAS = (
    "container int, op int, area int, headings array<string>, header string, bold_name string, full_text string, status_raw string, leftover string, "
    "anchors array<struct<href:string,text:string>>"
)
_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])
_AREAS = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), *(pa.string(),) * 5, pa.list_(_LINK))
#: Letters of pages that are read before their areas are given on.
MOST_READ = 4 << 20
_AREA_NAMES = [field.split()[0] for field in AREAS.split(", ")]


def areas_of(html: str) -> Iterator[tuple]:
    """Structure only: a row (as AREAS) for each area of each operation; one without areas has a row with a null area."""
    for c, container in enumerate(_containers(document(html or ""))):
        children = [x for x in container.children if isinstance(x, Node)]
        real = any(x.name in _HEADINGS for x in children)
        headings: list[str] = []
        op = 0
        for child in children:
            if child.name in _HEADINGS or (not real and child.name in ("p", "div", *_BOLD) and len(_squeezed(child.text())) <= K.HEADING_LETTERS):
                headings.append(child.text())
            elif child.name == "ul":
                for item in child.elements("li"):
                    areas = [li for sub in item.elements(*_LISTS) for li in sub.elements("li")]
                    for a, li in enumerate(areas):
                        yield (c, op, a, list(headings), _header(item), *_area(li))
                    if not areas:
                        yield (c, op, None, list(headings), _header(item), None, None, None, None, None)
                    op += 1


@arrow_udtf(returnType=f"source string, page_ord bigint, {AREAS}")
class ExtractAreas:
    """``marshlight_extract_areas(TABLE(source, page_ord, html))``: the areas of each page, a batch of pages at a time."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        sources, numbers, texts = pages.columns
        found, page, read = [], [], 0

        def table() -> pa.Table:
            took = pa.array(page, pa.int32())
            columns = [sources.take(took), numbers.take(took)]
            for k, kind in enumerate(_AREAS):
                values = (r[k] for r in found)
                if kind == _AREAS[-1]:
                    values = (None if v is None else [{"href": h, "text": t} for h, t in v] for v in values)
                columns.append(pa.array(list(values), kind))
            return pa.table(columns, names=["source", "page_ord", *_AREA_NAMES])

        for k, text in enumerate(texts):  # a page at a time: of a batch only its Arrow buffers are whole in memory
            html = text.as_py()
            for row in areas_of(html):
                found.append(row)
                page.append(k)
            read += len(html or "")
            if read >= MOST_READ:
                yield table()
                found, page, read = [], [], 0
                gc.collect()  # parents and children of a document hold each other
        yield table()


def pick_mid(anchors: Column) -> Column:
    """The map id of the link that mentions a map, else of one with text, else of any; the first of equals."""
    ranked = F.transform(
        anchors,
        lambda a, i: F.struct(
            F.when(X.clean(a["text"]).rlike(r"(?iU)\bmaps?\b"), 0).when(X.clean(a["text"]) != "", 1).otherwise(2).alias("rank"), i.alias("i"), X.mid_of_href(a["href"]).alias("mid")
        ),
    )
    return F.array_min(F.filter(ranked, lambda r: r["mid"].isNotNull()))["mid"]


def _without_first(text: Column, part: Column) -> Column:
    cut = lambda place: F.when(place > 0, F.concat(text.substr(F.lit(1), place - 1), F.lit(" "), text.substr(place + F.length(part), F.length(text)))).otherwise(text)
    return X.let(F.when(part != "", F.position(part, text)), cut)


def extract_areas(pages: DataFrame) -> DataFrame:
    """Pages (source, html, page_ord) to one row for each area or operation, with ``reason``: null for a good row, or no_date,
    no_areas, no_map. Filter pages before: predicates don't pass the table function."""
    raw = _lateral(pages)
    kinds = F.filter(F.transform("headings", X.section_kind), lambda k: k.isNotNull())
    rows = raw.withColumn("section", F.get(kinds, F.size(kinds) - 1)).withColumn("header", X.clean(F.col("header"))).withColumn("full_text", X.clean(F.col("full_text")))
    rows = rows.withColumns(X.header_fields(F.col("header")))
    rows = rows.select("*", X.canonical_products(F.col("products_raw")).alias("products"), "clock.*", F.col("first.date").alias("header_date")).drop("clock", "first")
    name = F.when(F.col("bold_name").isNotNull(), X.clean(F.col("bold_name"))).otherwise(X.clean(X.fallback_name(F.col("full_text"))))
    rows = rows.withColumn("area_name", F.nullif(F.trim(F.regexp_replace(name, r"\s*:\s*$", "")), F.lit("")))
    rows = stored(rows, "areas")  # read more than once, and the walk over the documents is the costly part
    by_text = X.status(_without_first(F.col("full_text"), F.col("area_name")))["status_text"]
    rows = rows.withColumn("area_status", X.status(F.coalesce("status_raw", by_text)))
    leftover = X.clean(F.col("leftover"))
    leftover = F.when(F.col("status_raw").isNull(), X.clean(_without_first(leftover, F.col("area_status.status_text")))).otherwise(leftover)
    rows = rows.withColumn("boundary_text", X.boundary(leftover)).withColumn("mid", X.corrected_mid(pick_mid(F.col("anchors"))))
    rows = rows.withColumn("final", X.inherit_status(F.col("area_status"), F.col("header_status")))
    date = X.resolve_date(F.col("header_date"), F.col("final.status"), F.col("final.status_text"))
    reason = F.when(F.col("header_date").isNull(), "no_date").when(F.col("area").isNull(), "no_areas").when(F.col("mid").isNull(), "no_map")
    return rows.withColumn("date", F.date_format(date, "yyyy-MM-dd")).withColumn("reason", reason)


def _lateral(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    spark.udtf.register("marshlight_extract_areas", ExtractAreas)
    plain = pages.select(F.col("source").cast("string").alias("source"), F.col("page_ord").cast("long").alias("page_ord"), F.col("html").cast("string").alias("html"))
    read = spark.sql("SELECT * FROM marshlight_extract_areas(TABLE(SELECT source, page_ord, html FROM {p}))", p=plain)
    return read.withColumn("page_ord", F.col("page_ord").cast(pages.schema["page_ord"].dataType))


def operations(areas: DataFrame, first_seen: Column) -> DataFrame:
    """The operations table of the good rows, with ``seq`` (page, container, operation, area) in document order."""
    seq = F.struct("page_ord", "container", "op", "area").alias("seq")
    good = areas.filter("reason is null")
    return good.select(
        F.concat_ws("|", "date", "mid").alias("id"), "date", "method", "target", "products", "products_raw", "period", "time_start", "time_end", "area_name",
        "boundary_text", "mid", archive.map_url(F.col("mid")).alias("map_url"), "final.status", "final.status_text", "section", "source", first_seen.alias("first_seen"), seq,
    )


def rejects(areas: DataFrame) -> DataFrame:
    """(reason, n); an operation without a date counts once whatever areas it has."""
    once = areas.filter("reason is not null").withColumn("area", F.when(F.col("reason") != "no_date", F.col("area")))
    return once.select("source", "page_ord", "container", "op", "area", "reason").distinct().groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
