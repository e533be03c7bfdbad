"""Line items, labelled values, tables and links out of document text and HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import item_text

# Nouns of materials, quantity words, standards, tax codes, labelled lines and unit cells.
MATERIAL_NOUN = r"(?i)\b(?:valve|pump|pipe|flange|bearing|gasket|compressor|motor|cable|transmitter|gauge|sensor|switchgear|transformer|panel|fitting|instrument|tank|filter|coupling)\b"
QUANTITY = r"(?i)\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(nos?\.?|sets?|kg|kgs|mt|tonne|mtr|meter|metre|km|litre|ltr|ea|each|pair|pairs|rolls?|spools?)\b"
STANDARD = r"(?i)\b(?:IS|IEC|BIS|ASTM|API|ANSI|ASME)\s*[-\s]?\d+[A-Za-z0-9/.-]*"
TAX_CODE = r"(?i)\b(?:HSN|SAC)\s*[:#-]?\s*(\d{4,8})\b"
VOLTAGE = r"(?i)(\d+(?:\.\d+)?)\s*(?:kV|kilo[- ]?volt)"
UNIT_CELL = r"(?i)^(?:nos?\.?|sets?|each|ea|kg|kgs|mt|m|mtr|metre|meter|lot|ltr|litre|pair|job)$"
NUMBER_CELL = r"^[\d,]+(?:\.\d+)?$"
ITEMS_PER_DOCUMENT = 25


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``line_no`` from 1, ``line`` trimmed) of every non-blank line."""
    split = docs.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("_i", "_l"))
    return split.select(key, (F.col("_i") + 1).alias("line_no"), F.regexp_replace("_l", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")


def line_items(docs: DataFrame, key: str, text: str, most: int | None = ITEMS_PER_DOCUMENT) -> DataFrame:
    """Lines of 12 characters or more that name a material and a quantity: ``line_no``, ``quantity``, ``uom``, ``hsn_code``, ``standards``, ``evidence``; the first ``most`` of each document (None: all)."""
    line = F.col("line")
    found = lines_of(docs, key, text).where((F.length(line) >= 12) & line.rlike(MATERIAL_NOUN) & line.rlike(QUANTITY))
    items = found.select(
        key, "line_no", F.substring(F.regexp_replace(line, r"(?U)\s+", " "), 1, 220).alias("short_description"),
        F.replace(F.regexp_extract(line, QUANTITY, 1), F.lit(","), F.lit("")).cast("double").alias("quantity"), F.regexp_extract(line, QUANTITY, 2).alias("uom"),
        F.regexp_extract(line, TAX_CODE, 1).alias("hsn_code"), F.array_join(F.regexp_extract_all(line, F.lit(STANDARD), F.lit(0)), " ").alias("standards"), line.alias("evidence"), F.lit(0.5).alias("confidence"),
    )
    if most is None:
        return items
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("_r") <= most).drop("_r")


def grounded(items: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Items whose evidence stands word for word in their document."""
    return items.join(docs.select(F.col(key), F.col(text).alias("_t")), key).where("instr(_t, evidence) > 0").drop("_t")


def specifications(docs: DataFrame, key: str, text: str) -> DataFrame:
    """First 5 voltages, 10 standards and 10 tax codes of each document."""
    every = lambda p, g, n: F.slice(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(g)), 1, n)
    return docs.select(key, F.transform(every(VOLTAGE, 1, 5), lambda v: v.cast("double")).alias("voltage_kv"), every(STANDARD, 0, 10).alias("standards"), every(TAX_CODE, 1, 10).alias("hsn_codes"))


# Labels of item lines with what may follow them, in order of search; those marked must name a material.
ITEM_LABELS = (
    ("item_category", r"(?i)Item Category\s*/?\s*Item Category\s*:?\s*(.{5,400})", True),
    ("gem_search_string", r"(?i)(?:Searched Strings? used in GeMARPTS|GeMARPTS\s*Searched Strings?)\s*:?\s*(.{5,400})", False),
    ("gem_search_result", r"(?i)(?:Searched Result generated in GeMARPTS|GeMARPTS\s*Searched Result)\s*:?\s*(.{5,400})", True),
    ("gem_category", r"(?i)(?:Relevant Categories selected for notification|GeMARPTS\s*Relevant Categories)\s*:?\s*(.{3,300})", True),
    ("primary_product_category", r"(?i)Primary product category\s*/?\s*Primary product category\s*:?\s*(.{5,400})", True),
    ("brief_description", r"(?i)Brief NIT Description\s*:?\s*(.{5,400})", False),
    ("tender_title", r"(?i)Tender Title\s*:?\s*(.{5,400})", False),
)
# A numbered line of a schedule, a comma-separated specification, nouns of materials, a size.
SCHEDULE = r"^\s*(?:Schedule|Item|BoQ|BOQ|Sl\.?\s*No\.?)\s*[-:]?\s*(\d{1,3})\s*[|\t]\s*(.{4,200}?)\s*[|\t]\s*([\d,]+(?:\.\d+)?)\s*(?:[|\t]\s*([A-Za-z]{2,12})\s*)?$"
SPECIFICATION = r"\b[A-Z0-9/]{2,}\s*(?:,\s*[A-Z0-9/.-]{1,20}\s*){3,}"
ITEM_NOUN = (
    r"(?i)\b(?:valve|pump|pipe|flange|bearing|gasket|compressor|motor|cable|gauge|sensor|transmitter|thermocouple|bolt|fitting|elbow|tee|reducer|strainer|filter|exchanger|boiler|turbine|blower|fan|vessel|tank|drum|column|"
    r"reactor|actuator|orifice|meter|analyser|analyzer|switchgear|breaker|relay|battery|transformer|conveyor|belt|insulator|arrester|coupling|gearbox|impeller|seal|stud|nut|washer|electrode|refractory|heater|ejector|"
    r"separator|chimney|crane|hoist|generator|panel|starter|contactor)\b"
)
SIZE = r"\b\d{1,4}\s*(?:mm|MM|inch|INCH|\"|kv|KV|MW|kg|KG|mt|MT|bar|BAR|HP|hp|TPD|TPH)\b"
SENTENCE_LENGTHS = (19, 299)
VALUE_LENGTHS = (4, 500)


def item_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every reading of every line: ``line_no``, ``pattern``, ``item_text``, ``quantity``, ``unit``; a document's first reading of a text under a pattern stays.

    Patterns are the labels of ``ITEM_LABELS``, ``boq_schedule_line``, ``spec_string`` and ``spec_sentence`` (a
    material and a size in a line of moderate length). All readings of a line come from one pass of expressions.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("_i", "_l")).select(key, (F.col("_i") + 1).alias("line_no"), item_text(F.col("_l")).alias("line")).where("line <> ''")
    line, none = F.col("line"), F.lit("")
    reading = lambda name, value, quantity=none, unit=none: F.struct(F.lit(name).alias("pattern"), item_text(value).alias("item_text"), quantity.alias("quantity"), unit.alias("unit"))
    found = []
    for name, pattern, gated in ITEM_LABELS:
        value = F.regexp_extract(line, pattern, 1)
        found.append(F.when((value != "") & (value.rlike(ITEM_NOUN) if gated else F.lit(True)), reading(name, value)))
    part = lambda g: F.regexp_extract(line, SCHEDULE, g)
    found.append(F.when(part(2) != "", reading("boq_schedule_line", part(2), part(3), part(4))))
    found.append(F.when(line.rlike(ITEM_NOUN) & line.rlike(SIZE) & F.length(line).between(*SENTENCE_LENGTHS), reading("spec_sentence", line)))
    specs = F.transform(F.filter(F.regexp_extract_all(line, F.lit(SPECIFICATION), F.lit(0)), lambda x: x.rlike(ITEM_NOUN)), lambda x: reading("spec_string", x))
    every = lines.select(key, "line_no", F.explode(F.concat(F.array_compact(F.array(*found)), specs)).alias("r")).select(key, "line_no", "r.*")
    sized = every.where(F.length("item_text").between(*VALUE_LENGTHS))
    first = sized.groupBy(key, "pattern", F.lower("item_text").alias("_low")).agg(F.min(F.struct("line_no", "item_text", "quantity", "unit")).alias("r"))
    return first.select(key, "pattern", "r.*")


def labelled_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Values behind the labels of ``ITEM_LABELS``: ``line_no``, ``label``, ``value``."""
    names = [name for name, *_ in ITEM_LABELS]
    return item_lines(docs, key, text).where(F.col("pattern").isin(*names)).select(key, "line_no", F.col("pattern").alias("label"), F.col("item_text").alias("value"))


def schedule_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of bills of quantities, ``no. description quantity unit``: ``item_no``, ``description``, ``quantity``, ``unit``."""
    pattern = r"(?i)^(\d{1,3})[.)]?\s+(\D.{5,}?)[\s,|-]+(\d+(?:\.\d+)?)\s*(nos?\.?|sets?|each|kg|mt|mtr?|metres?|lots?|ltr|pairs?)\s*$"
    hit = lines_of(docs, key, text).where(F.col("line").rlike(pattern))
    part = lambda g: F.regexp_extract("line", pattern, g)
    return hit.select(key, "line_no", part(1).cast("int").alias("item_no"), part(2).alias("description"), part(3).cast("double").alias("quantity"), F.lower(part(4)).alias("unit"))


def plan_row(cells: Column) -> Column:
    """STRUCT<item, unit, quantity, value> of a plan table's row of cells: the longest text cell, the first unit cell, the first number, the last number if there are two."""
    trimmed = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    texts = F.filter(trimmed, lambda c: (F.length(c) >= 6) & ~c.rlike(NUMBER_CELL) & ~c.rlike(UNIT_CELL))
    numbers = F.transform(F.filter(trimmed, lambda c: c.rlike(NUMBER_CELL)), lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double"))
    longest = F.aggregate(texts, F.lit(None).cast("string"), lambda best, c: F.when(best.isNull() | (F.length(c) > F.length(best)), c).otherwise(best))
    return F.struct(
        longest.alias("item"), F.try_element_at(F.filter(trimmed, lambda c: c.rlike(UNIT_CELL)), F.lit(1)).alias("unit"),
        F.try_element_at(numbers, F.lit(1)).alias("quantity"), F.when(F.size(numbers) > 1, F.try_element_at(numbers, F.lit(-1))).alias("value"),
    )


def table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of text tables with cells between bars: ``line_no``, ``cells``, and the parsed plan row."""
    rows = lines_of(docs, key, text).where(F.size(F.split("line", r"\|")) > 2)
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select(key, "line_no", cells.alias("cells")).withColumn("row", plan_row(F.col("cells"))).select(key, "line_no", "cells", "row.*")


class _Page(HTMLParser):
    """Text lines, links and tables of one page."""

    BREAKS = {"p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.hidden = 0
        self.open: list[list[list[str]]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a" and a.get("href"):
            self.links.append((a["href"], ""))
        elif tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            (self.open[-1] or self.open[-1].append([]) or self.open[-1])[-1].append("")
        if tag in self.BREAKS:
            self.pieces.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        if tag in self.BREAKS:
            self.pieces.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        self.pieces.append(data)
        if self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data


def pages(docs: DataFrame, key: str, html: str, base_url: str | None = None) -> DataFrame:
    """(``key``, ``text``, ``links`` absolute, http only, distinct in order, ``tables``) of HTML pages; null and empty pages give empty results."""
    address = F.col(base_url) if base_url else F.lit("")
    key_type = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h, b in zip(pdf["_k"], pdf["_h"], pdf["_b"]):
                p = _Page()
                p.feed(h or "")
                p.close()
                text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.pieces).split("\n")) if x)
                links = [u for u in (urljoin(b or "", href) for href, _ in p.links) if u.startswith(("http://", "https://"))]
                tables = [[[" ".join(c.split()) for c in row] for row in t if row] for t in p.tables]
                rows.append((k, text, list(dict.fromkeys(links)), tables))
            yield pd.DataFrame(rows, columns=[key, "text", "links", "tables"])

    return docs.select(F.col(key).alias("_k"), F.col(html).alias("_h"), address.alias("_b")).mapInPandas(run, f"{key} {key_type}, text string, links array<string>, tables array<array<array<string>>>")


def page_table_rows(parsed: DataFrame, key: str, headers: tuple[str, ...]) -> DataFrame:
    """Rows of those tables of ``pages`` whose first row names all of ``headers`` (apart from case): ``table_no``, ``row_no``, and ``values`` as a MAP from header to cell. Rows of another width are left out."""
    tables = parsed.select(key, F.posexplode("tables").alias("table_no", "t")).where(F.size("t") > 1)
    head = F.transform(F.col("t")[0], lambda c: F.lower(F.trim(c)))
    named = tables.withColumn("_h", head).where(F.size(F.array_except(F.array(*[F.lit(h.lower()) for h in headers]), "_h")) == 0)
    rows = named.select(key, "table_no", "_h", F.posexplode(F.slice("t", 2, F.size("t"))).alias("row_no", "_r")).where(F.size("_r") == F.size("_h"))
    return rows.select(key, "table_no", "row_no", F.map_from_arrays("_h", "_r").alias("values"))


def tender_links(links: DataFrame, column: str = "links") -> DataFrame:
    """Sorted distinct links that have to do with tenders, bids or downloads."""
    one = links.select(F.explode(column).alias("link")).distinct()
    return one.where(F.lower("link").rlike("tender|bid|download")).orderBy("link")


def advertised_bytes(text: Column) -> Column:
    """Bytes of a size such as ``1.5 MB``; null if the text has none."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*([KMGT]?)B\b"
    power = F.instr(F.lit("KMGT"), F.upper(F.regexp_extract(text, pattern, 2)))
    scale = F.pow(F.lit(1024.0), F.when(F.regexp_extract(text, pattern, 2) == "", 0).otherwise(power))
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double") * scale
