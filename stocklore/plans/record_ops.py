"""Queries on records, unions, lookups, page tables, item lines, attributes by value and gold evaluation, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes as att
from ..operators import corpus, documents_extract, evaluation, identity, matching, records, retrieval, weak_labels
from ..session import spread
from ..sources import writers
from .registry import query, read

CORPUS, UNITS, EVENTS, ATTRS, DOCS = "material_description_corpus", "unit_normalisation", "feedback_event", "material_attributes", "documents"
_EDGE = r"[\s\x0b\x{85}\p{Z}]+"


def _given(*names: str) -> str:
    return f"regexp_replace(coalesce({', '.join(f'nullif({n}, $$$$)' for n in names)}, ''), '^{_EDGE}|{_EDGE}$', '', 'g')".replace("$$$$", "''")


@query(
    f"""WITH r AS (SELECT *, replace(trim({_given('quantity')}), ',', '') AS q FROM material_description_corpus)
SELECT {_given('corpus_id')} AS material_code, coalesce(nullif({_given('source_system')}, ''), 'unknown') AS source_system, {_given('organization')} AS source_organization,
  {_given('tender_id', 'tender_reference', 'corpus_id')} AS source_record_id, {_given('document_url')} AS source_document, {_given('description')} AS raw_description,
  CASE WHEN isfinite(try_cast(q AS DOUBLE)) THEN try_cast(q AS DOUBLE) END AS quantity, {_given('unit')} AS unit, location AS original_location FROM r"""
)
def material_records(spark: SparkSession, sf: str) -> DataFrame:
    found = records.material_records(read(spark, sf, CORPUS), F.col("document_url"))
    return found.select("material_code", "source_system", "source_organization", "source_record_id", "source_document", "raw_description", "quantity", "unit", F.col("metadata")["location"].alias("original_location"))


def _attribute_input(spark: SparkSession, sf: str) -> DataFrame:
    return records.projected(read(spark, sf, "part"), {"organization": "p_brand", "source_system": F.lit("parts"), "description": "p_name", "description_kind": F.lit("part_name"), "tender_id": F.col("p_partkey")})


_CLEAN = r"""regexp_replace(regexp_replace(coalesce({0}, ''), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'), '^[ |:-]+|[ |:-]+$', '', 'g')"""
_HALF = "lower(regexp_replace({0}, '[\\s\\x0b\\x{{85}}\\p{{Z}}.,()-]+', '', 'g'))"
_LEFT, _RIGHT = _HALF.format("substr(w, 1, c)"), _HALF.format("substr(w, c + 1)")


def _cleaned(source: str, text: str) -> str:
    """CTEs ``k0`` .. ``k``: rows of a source with the cleaned text as ``d``."""
    return f"""k0 AS (SELECT *, {_CLEAN.format(text)} AS one FROM {source}),
k1 AS (SELECT * EXCLUDE (one), trim(coalesce(nullif(regexp_extract(one, '^.*?\\.{{3}}\\s*(.{{10,}})$', 1), ''), one)) AS w FROM k0),
k2 AS (SELECT *, CASE WHEN length(w) >= 20 THEN list_filter(range(length(w) // 2 - 2, length(w) // 2 + 3), lambda c: c > 8 AND {_LEFT} <> '' AND {_LEFT} = {_RIGHT}) END AS cuts FROM k1),
k AS (SELECT * EXCLUDE (w, cuts), regexp_replace(CASE WHEN len(cuts) > 0 THEN trim(substr(w, 1, cuts[1])) ELSE w END, '^[ \\t|:.-]+|[ \\t|:.-]+$', '', 'g') AS d FROM k2)"""


@query(f"WITH {_cleaned('material_description_corpus', 'description')} SELECT organization, d AS description, description_kind, min(corpus_id) AS corpus_id FROM k WHERE length(d) BETWEEN 8 AND 1200 GROUP BY 1, 2, 3")
def corpus_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    built = corpus.build_corpus(read(spark, sf, CORPUS).select("corpus_id", "organization", "description", "description_kind"))
    return built.select("organization", "description", "description_kind", "corpus_id")


@query(
    """WITH p AS (SELECT coalesce(p_brand, '') AS organization, trim(regexp_replace(coalesce(p_name, ''), '\\s+', ' ', 'g')) AS description, 'part_name' AS description_kind, CAST(p_partkey AS VARCHAR) AS tender_id FROM part),
o AS (SELECT organization, description, description_kind, min(tender_id) AS tender_id FROM p WHERE length(description) BETWEEN 8 AND 1200 GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT coalesce(s_name, '') AS organization, 'supplier of parts' AS description, 'supplier' AS description_kind, '' AS tender_id FROM supplier)
SELECT * FROM o UNION ALL SELECT * FROM s"""
)
def corpus_of_inputs(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = records.projected(read(spark, sf, "supplier"), {"organization": "s_name", "description": F.lit("supplier of parts"), "description_kind": F.lit("supplier")})
    parts = _attribute_input(spark, sf)
    return records.corpus_union(parts, suppliers, parts).select("organization", "description", "description_kind", "tender_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'stored' FROM part WHERE p_partkey % 3 = 0")
def listed_with_stored(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    listed = parts.where("cast(id as bigint) % 3 <> 0")
    return records.with_stored(listed, parts.select("id", F.lit("stored").alias("name")), "id")


@query("""SELECT c.corpus_id, d.encoding, d.records_seen FROM material_description_corpus c JOIN (SELECT source_path, min(encoding) AS encoding, max(records_seen) AS records_seen FROM data_quality_report GROUP BY 1) d ON d.source_path = c.document_url""")
def records_with_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS).select("corpus_id", F.col("document_url").alias("source_path"))
    files = read(spark, sf, "data_quality_report").groupBy("source_path").agg(F.min("encoding").alias("encoding"), F.max("records_seen").alias("records_seen"))
    return records.with_artifacts(rows, files, "source_path").select("corpus_id", "encoding", "records_seen")


@query("SELECT corpus_id, organization, description FROM material_description_corpus WHERE corpus_id IN ('M00000001', 'M00000017', 'M00000123', 'none')")
def material_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return records.looked_up(read(spark, sf, CORPUS), "corpus_id", "M00000001", "M00000017", "M00000123", "none").select("corpus_id", "organization", "description")


@query("SELECT 'unique' AS rule, 'organization,description' AS columns, CAST(sum(n - 1) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM material_description_corpus WHERE organization IS NOT NULL AND description IS NOT NULL GROUP BY organization, description) UNION ALL SELECT 'required', 'description', count(*) FROM material_description_corpus WHERE description IS NULL UNION ALL SELECT 'required', 'unit', count(*) FROM material_description_corpus WHERE unit IS NULL")
def table_violations(spark: SparkSession, sf: str) -> DataFrame:
    return records.violations(read(spark, sf, CORPUS), ("organization", "description"), ("corpus_id", "description", "unit")).withColumn("rows", F.col("rows").cast("bigint"))


@query("SELECT c_custkey AS customer, count(*) AS rows, round(sum(coalesce(o_totalprice, 0)), 2) AS spend FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def spend_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("customer")), F.col("o_custkey") == F.col("customer"))
    return records.spend(rows, "customer", "o_totalprice")


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(doc_name, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label, substr(regexp_replace(trim(coalesce(doc_name, '')), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS slug,
array_to_string(list_transform(regexp_extract_all('[' || coalesce(source, '') || '] x [ ' || coalesce(lang, '') || ' ]', '\[([^\[\]]*)\]', 1), lambda x: trim(x)), '|') AS bracketed FROM documents"""
)
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("] x [ "), F.coalesce("lang", F.lit("")), F.lit(" ]"))
    return read(spark, sf, DOCS).select("doc_id", records.snake_case(F.col("doc_name")).alias("label"), records.file_slug(F.col("doc_name")).alias("slug"), F.array_join(records.bracketed(marked), "|").alias("bracketed"))


_ITEM = r"""regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace({0}, '\(cid:\d+\)', ' ', 'g'), '[\x{{900}}-\x{{97F}}]+', ' ', 'g'), '’‘', chr(39) || chr(39)), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'), '^[ \t|:-]+|[ \t|:-]+$', '', 'g')"""
_NOUNS = "(?i)\\b(?:valve|pump|pipe|flange|bearing|gasket|compressor|motor|cable|gauge|sensor|transmitter|thermocouple|bolt|fitting|elbow|tee|reducer|strainer|filter|exchanger|boiler|turbine|blower|fan|vessel|tank|drum|column|reactor|actuator|orifice|meter|analyser|analyzer|switchgear|breaker|relay|battery|transformer|conveyor|belt|insulator|arrester|coupling|gearbox|impeller|seal|stud|nut|washer|electrode|refractory|heater|ejector|separator|chimney|crane|hoist|generator|panel|starter|contactor)\\b"


@query(
    f"""WITH l AS (SELECT doc_id, i AS line_no, {_ITEM.format("string_split_regex(text, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10))[i]")} AS line
  FROM documents, unnest(range(1, len(string_split_regex(text, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10))) + 1)) AS x(i) WHERE text IS NOT NULL),
s AS (SELECT doc_id, line_no, line FROM l WHERE length(line) BETWEEN 19 AND 299 AND regexp_matches(line, '{_NOUNS}')
  AND regexp_matches(line, '\\b\\d{{1,4}}\\s*(?:mm|MM|inch|INCH|"|kv|KV|MW|kg|KG|mt|MT|bar|BAR|HP|hp|TPD|TPH)\\b'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line AS item_text FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY line_no) = 1"""
)
def document_spec_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return documents_extract.item_lines(read(spark, sf, DOCS), "doc_id", "text").where("pattern = 'spec_sentence'").select("doc_id", "line_no", "item_text")


# A form of labelled lines for every corpus row: what is read must be what was written (the SQL gives the cleaned values of rows that name a material where that is asked).
@query(
    f"""WITH v AS (SELECT corpus_id, {_ITEM.format("coalesce(description, '')")} AS d, {_ITEM.format("coalesce(tender_reference, '')")} AS t FROM material_description_corpus),
r AS (SELECT corpus_id, 'item_category' AS label, {_ITEM.format("substr(d, 1, 400)")} AS value FROM v WHERE length(d) >= 5 AND regexp_matches(substr(d, 1, 400), '{_NOUNS}')
UNION ALL SELECT corpus_id, 'tender_title', {_ITEM.format("substr(t, 1, 400)")} FROM v WHERE length(t) >= 5)
SELECT corpus_id, label, value FROM r WHERE length(value) BETWEEN 4 AND 500"""
)
def labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS).select("corpus_id", records.item_text(F.col("description")).alias("d"), records.item_text(F.col("tender_reference")).alias("t"))
    form = rows.select("corpus_id", F.concat(F.lit("Item Category / Item Category : "), F.col("d"), F.lit("\nTender Title: "), F.col("t"), F.lit("\n")).alias("text"))
    return documents_extract.labelled_lines(form, "corpus_id", "text").select("corpus_id", "label", "value")


# A page for every tender with a table of its rows, and the rows read back from the page.
@query("SELECT tender_id, corpus_id, coalesce(trim(regexp_replace(unit, '\\s+', ' ', 'g')), '') AS unit FROM material_description_corpus WHERE tender_id <> '' AND tender_reference IS NOT NULL")
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = read(spark, sf, CORPUS).where("tender_id <> '' and tender_reference is not null").select("tender_id", "corpus_id", "unit")
    pages_of = rows.groupBy("tender_id").agg(F.ceil(F.count("*") / 200).alias("pages"))  # about 200 rows a page, however long a tender runs
    rows = rows.join(pages_of, "tender_id").withColumn("part", F.pmod(F.xxhash64("corpus_id"), F.col("pages")))
    line = F.concat(F.lit("<tr><td>"), F.col("corpus_id"), F.lit("</td><td><b>"), escaped(F.col("unit")), F.lit("</b></td></tr>"))
    html = F.concat(F.lit("<html><body><table><tr><th>x</th></tr><tr><td>1</td></tr></table><table><tr><th>Record</th><th>UNIT</th></tr>"), F.array_join(F.collect_list(line), ""), F.lit("</table></body></html>"))
    pages = documents_extract.pages(rows.groupBy("tender_id", "part").agg(html.alias("html")), "tender_id", "html")
    return documents_extract.page_table_rows(pages, "tender_id", ("record", "unit")).select("tender_id", F.col("values")["record"].alias("corpus_id"), F.col("values")["unit"].alias("unit"))


@query("SELECT DISTINCT 'https://x.example/' || source || '/tender/' || CAST(doc_id AS VARCHAR) AS link FROM documents WHERE source IS NOT NULL")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<p><a href='tender/"), F.col("doc_id").cast("string"), F.lit("'>t</a><a href='mailto:x'>m</a><a href='/about'>a</a></p>"))
    docs = read(spark, sf, DOCS).where("source is not null").select("doc_id", html.alias("html"), F.concat(F.lit("https://x.example/"), F.col("source"), F.lit("/")).alias("url"))
    return documents_extract.tender_links(documents_extract.pages(docs, "doc_id", "html", "url"))


@query(f"""WITH l AS (SELECT doc_id, i AS line_no, regexp_replace(string_split_regex(text, '\r\n|\r|\n')[i], '^{_EDGE}|{_EDGE}$', '', 'g') AS line FROM documents, unnest(range(1, len(string_split_regex(text, '\r\n|\r|\n')) + 1)) AS x(i) WHERE text IS NOT NULL),
f AS (SELECT doc_id, line_no FROM l WHERE length(line) >= 12 AND regexp_matches(line, '{documents_extract.MATERIAL_NOUN}') AND regexp_matches(line, '{documents_extract.QUANTITY}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 25)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM f WHERE line_no % 2 = 0""")
def grounded_items(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, DOCS)
    items = documents_extract.line_items(docs, "doc_id", "text")
    invented = items.withColumn("evidence", F.when(F.col("line_no") % 2 == 0, F.col("evidence")).otherwise(F.concat(F.col("evidence"), F.lit(" (not said)"))))
    return documents_extract.grounded(invented, docs, "doc_id", "text").select("doc_id", "line_no")


# The SQL engine's word characters and blanks are ASCII only: other letters and digits count as "_", other blanks as " ", other signs as "~".
_PLAIN = "d AS (SELECT corpus_id, regexp_replace(regexp_replace(regexp_replace(coalesce(description, ''), '\\p{Z}', ' ', 'g'), '[^\\x00-\\x7F\\p{L}\\p{N}]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS t FROM material_description_corpus)"
# Patterns written by hand, apart from the module's; spans are counted, values are compared.
_VALUES = {
    "frequency": (r"(?i)\b(\d+(?:\.\d+)?)\s*hz\b", "CAST({0} AS DOUBLE)"), "cores": (r"(?i)\b(\d+)\s*(?:core|cores|c)\b", "CAST({0} AS DOUBLE)"),
    "voltage_kv": (r"(?i)\b(\d+(?:\.\d+)?)\s*(?:k\s*v|kilovolts?)\b", "CAST({0} AS DOUBLE)"), "voltage_v": (r"(?i)\b(\d+(?:\.\d+)?)\s*(?:v|volts?)\b", "CAST({0} AS DOUBLE) / 1000"),
    "rating": (r"(?i)\b(\d+(?:\.\d+)?)\s*(?:kva|kw|hp)\b", "CAST({0} AS DOUBLE)"), "rating_m": (r"(?i)\b(\d+(?:\.\d+)?)\s*(?:mva|mw)\b", "CAST({0} AS DOUBLE) * 1000"),
    "nominal_diameter": (r"(?i)\b(?:dn\s*)?(\d+(?:\.\d+)?)\s*(?:mm|inch|inches|in\b|\x22|nb|nps)(?:\b)", "CAST({0} AS DOUBLE)"),
}


@query(
    f"WITH {_PLAIN}, v AS ("
    + " UNION ALL ".join(f"SELECT corpus_id, '{name.split('_v')[0].split('_k')[0].removesuffix('_m')}' AS attribute_name, {value.format('x')} AS number FROM (SELECT corpus_id, unnest(regexp_extract_all(t, '{pattern}', 1)) AS x FROM d)" for name, (pattern, value) in _VALUES.items())
    + ") SELECT corpus_id, attribute_name, round(number, 6) AS number, count(*) AS times FROM v GROUP BY 1, 2, 3"
)
def attribute_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description"))
    one = rows.select("corpus_id", F.explode("attributes").alias("a")).where(F.col("a.name").isin("frequency", "cores", "voltage", "rating", "nominal_diameter"))
    return one.groupBy("corpus_id", F.col("a.name").alias("attribute_name"), F.round(F.coalesce("a.number", F.col("a.value").cast("double")), 6).alias("number")).agg(F.count("*").alias("times"))


_TERMS = {
    "valve_type": r"(?i)\b(ball|gate|globe|butterfly|check|control|safety|relief|needle|plug|diaphragm)\s+valve\b", "insulation": r"(?i)\b(xlpe|pvc|epr|pilc|paper insulated)\b", "armour": r"(?i)\b(armou?red|unarmou?red|swa|awa)\b",
    "end_connection": r"(?i)\b(flanged|flange|butt[- ]?weld|socket[- ]?weld|threaded|npt|bsp|wafer|lug)\b", "cooling_type": r"(?i)\b(onan|onaf|ofaf|odaf|an|af|wf)\b", "schedule": r"(?i)\b(?:schedule|sch\.?)\s*(\d{1,3}s?)\b",
    "phase": r"(?i)\b(single|three|1|3)\s*[- ]?phase\b", "hsn_sac": r"(?i)\b(?:hsn|sac)\s*[:#-]?\s*(\d{4,8})\b", "model": r"(?i)\b(?:model|type)\s*[:#-]?\s*([a-z0-9][a-z0-9./_-]+)",
}


@query(
    f"WITH {_PLAIN}, v AS ("
    + " UNION ALL ".join(f"SELECT corpus_id, '{name}' AS attribute_name, upper(x) AS value FROM (SELECT corpus_id, unnest(regexp_extract_all(t, '{pattern}', 1)) AS x FROM d)" for name, pattern in _TERMS.items())
    + ") SELECT corpus_id, attribute_name, value, count(*) AS times FROM v GROUP BY 1, 2, 3"
)
def attribute_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description"))
    one = rows.select("corpus_id", F.explode("attributes").alias("a")).where(F.col("a.name").isin(*_TERMS))
    return one.groupBy("corpus_id", F.col("a.name").alias("attribute_name"), F.col("a.text").alias("value")).agg(F.count("*").alias("times"))


@query("SELECT attribute_id, round(least(greatest(0.35 * coalesce(confidence, 0) + 0.25 * (length(coalesce(value, '')) % 5) / 4.0 + 0.30 * CASE WHEN unit IS NULL THEN 0 ELSE 1 END, 0), 1), 6) AS score, 'Human Review' AS band FROM material_attributes")
def hybrid_scores(spark: SparkSession, sf: str) -> DataFrame:
    sparse = F.pmod(F.length(F.coalesce("value", F.lit(""))), F.lit(5)) / F.lit(4.0)
    score = matching.hybrid_score(F.col("confidence"), sparse, F.when(F.col("unit").isNotNull(), 1.0), F.lit(None).cast("double"))
    return read(spark, sf, ATTRS).select("attribute_id", F.round(score, 6).alias("score")).withColumn("band", matching.score_band(F.col("score")))


_GOLD = "g AS (SELECT entity_id, CAST(accepted AS INTEGER) AS label, (length(material_a) + length(coalesce(created_at, ''))) % 10 / 10.0 AS score FROM feedback_event WHERE accepted IS NOT NULL AND material_a IS NOT NULL AND trim(entity_id) <> '')"


@query(
    f"""WITH {_GOLD}, s AS (SELECT entity_id, CAST(concat('0x', substr(sha256('42:' || entity_id), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551615.0 AS h FROM g GROUP BY 1),
t AS (SELECT g.*, h < 0.2 AS test FROM g JOIN s USING (entity_id)),
c AS (SELECT count(*) FILTER (test AND label = 1 AND score >= 0.5) AS tp, count(*) FILTER (test AND label = 0 AND score >= 0.5) AS fp, count(*) FILTER (test AND label = 1 AND score < 0.5) AS fn, count(*) FILTER (test AND label = 0 AND score < 0.5) AS tn, count(*) FILTER (NOT test) AS training_rows, count(*) FILTER (test) AS test_rows FROM t)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, training_rows, test_rows FROM c"""
)
def gold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    score = F.pmod(F.length("material_a") + F.length(F.coalesce("created_at", F.lit(""))), F.lit(10)) / F.lit(10.0)
    rows = read(spark, sf, EVENTS).where("accepted is not null and material_a is not null and trim(entity_id) <> ''").select("entity_id", F.col("accepted").cast("int").alias("label"), score.alias("score"), F.lit(evaluation.GOLD).alias("label_source"))
    found = evaluation.evaluated(rows, "label", "score", "entity_id")
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("training_rows").cast("bigint").alias("training_rows"), F.col("test_rows").cast("bigint").alias("test_rows"))


@query(
    """WITH h AS (SELECT attribute_id, material_id, value FROM material_attributes WHERE material_id IS NOT NULL), n AS (SELECT material_id, value || ' (new)' AS value, 'n' || attribute_id AS attribute_id FROM h WHERE substr(material_id, length(material_id)) = '7')
SELECT attribute_id, material_id, value FROM h WHERE material_id NOT IN (SELECT material_id FROM n) UNION ALL SELECT attribute_id, material_id, value FROM n"""
)
def children_replaced(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, ATTRS).select("attribute_id", "material_id", "value").where("material_id is not null")
    fresh = held.where(F.col("material_id").endswith("7")).select(F.concat(F.lit("n"), "attribute_id").alias("attribute_id"), "material_id", F.concat("value", F.lit(" (new)")).alias("value"))
    return writers.replaced_children(held, fresh, "material_id")


@query(
    """WITH n AS (SELECT attribute_id, max(value || ' v2') AS value FROM material_attributes WHERE attribute_name = 'size' GROUP BY 1)
SELECT a.attribute_id, CASE WHEN n.attribute_id IS NOT NULL THEN n.value ELSE a.value END AS value FROM material_attributes a LEFT JOIN n USING (attribute_id)"""
)
def rows_upserted(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, ATTRS).select("attribute_id", "value")
    news = read(spark, sf, ATTRS).where("attribute_name = 'size'").select("attribute_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "value")
    return writers.upserted(held, news.withColumn("value", F.concat("value", F.lit(" v"), F.col("version").cast("string"))), "attribute_id", "version").select("attribute_id", "value")


@query(
    """SELECT material_id, array_to_string(list_sort(list_distinct(list(coalesce(attribute_name, '') || '=' || coalesce(value, '')))), '|') AS attributes FROM material_attributes WHERE material_id IS NOT NULL GROUP BY 1"""
)
def attributes_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = att.nested(read(spark, sf, ATTRS).where("material_id is not null"))
    pair = lambda a: F.concat(F.coalesce(a["attribute_name"], F.lit("")), F.lit("="), F.coalesce(a["value"], F.lit("")))
    return nested.select("material_id", F.array_join(F.array_sort(F.array_distinct(F.transform("attributes", pair))), "|").alias("attributes"))


@query(
    """WITH f AS (SELECT description, organization, corpus_id FROM material_description_corpus),
t AS (SELECT corpus_id, nullif(trim(regexp_replace(replace(lower(description), 'ß', 'ss'), '[\\s\\x0b\\x{85}\\p{Z}\\x{200B}\\x{FEFF}]+', ' ', 'g')), '') AS t, trim(regexp_replace(replace(lower(coalesce(organization, '')), 'ß', 'ss'), '[\\s\\x0b\\x{85}\\p{Z}\\x{200B}\\x{FEFF}]+', ' ', 'g')) AS o FROM f),
r AS (SELECT t, o, min(corpus_id) AS r FROM t WHERE t IS NOT NULL GROUP BY 1, 2), c AS (SELECT t, min(r) AS a FROM r GROUP BY t HAVING count(*) > 1)
SELECT least(a, r) AS material_a, greatest(a, r) AS material_b, 'EXACT' AS relation, 0.9::DOUBLE AS confidence, 'pair_' || substr(sha256('["pair","' || least(a, r) || '","' || greatest(a, r) || '"]'), 1, 24) AS pair_id FROM r JOIN c USING (t) WHERE r <> a"""
)
def exact_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.exact_labels(read(spark, sf, CORPUS)).orderBy("pair_id")


@query(
    """SELECT n AS document_no, 'M' || lpad(CAST(n AS VARCHAR), 3, '0') AS short FROM (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 9"""
)
def numbered_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.numbering import numbered

    rows = numbered(read(spark, sf, DOCS).select("source", "doc_id"), ["doc_id"], "document_no", ("source",)).where("document_no <= 9")
    return rows.select("document_no", F.format_string("M%03d", "document_no").alias("short"))
