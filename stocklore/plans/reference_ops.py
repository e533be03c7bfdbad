"""Queries for the material-data operators, each over its whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes as att
from ..operators import audit, canonical_codes, corpus, documents_extract, evaluation, identity, lineage, matching, normalize, quality, retrieval, weak_labels
from ..session import spread
from ..streaming import feeds
from .registry import query, read

CORPUS, UNITS, EVENTS, ATTRS, DOCS = "material_description_corpus", "unit_normalisation", "feedback_event", "material_attributes", "documents"

_EDGE = r"[\s\x0b\x{85}\p{Z}]+"
_WS = r"[\s\x0b\x{85}\p{Z}\x{200B}\x{FEFF}]+"


def _fold(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '{_WS}', ' ', 'g'))"


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_EDGE}|{_EDGE}$', '', 'g')"


def _tok(c: str) -> str:
    return f"regexp_extract_all(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[a-z0-9]+')"


_FLAGS = f"""
b AS (SELECT *, {_trim('description')} AS t, nullif({_fold('description')}, '') AS f, {_fold("coalesce(organization, '')")} AS o FROM material_description_corpus),
d AS (SELECT f, count(*) AS n, count(DISTINCT o) AS orgs FROM b WHERE f IS NOT NULL GROUP BY f),
ti AS (SELECT lower({_trim('tender_id')}) AS tn, f, count(*) AS n FROM b WHERE description_kind IN ('tender_title', 'nit_brief_description') AND {_trim('tender_id')} <> '' AND f IS NOT NULL GROUP BY 1, 2),
u AS (SELECT DISTINCT lower(trim(surface_form)) AS k FROM unit_normalisation),
q AS (SELECT *, {_trim('quantity')} AS qt, try_cast(replace(trim({_trim('quantity')}), ',', '') AS DOUBLE) AS qn FROM b),
fl AS (
  SELECT corpus_id AS row_id, 'ERROR' AS severity, 'empty_description' AS check_code FROM b WHERE t = ''
  UNION ALL SELECT corpus_id, 'ERROR', 'numeric_only_description' FROM b WHERE t <> '' AND NOT regexp_matches(t, '[\\p{{L}}\\p{{M}}\\p{{Nl}}]')
  UNION ALL SELECT corpus_id, 'WARNING', 'administrative_text' FROM b WHERE regexp_matches(t, '{quality.ADMIN_TERMS}')
  UNION ALL SELECT corpus_id, 'WARNING', 'missing_provenance_url' FROM b WHERE {_trim('source_url')} = '' AND {_trim('document_url')} = ''
  UNION ALL SELECT corpus_id, 'WARNING', 'missing_source_system' FROM b WHERE {_trim('source_system')} = ''
  UNION ALL SELECT corpus_id, 'ERROR', 'invalid_quantity' FROM q WHERE qt <> '' AND (qn IS NULL OR isnan(qn) OR isinf(qn) OR qn < 0)
  UNION ALL SELECT corpus_id, 'WARNING', 'malformed_specification' FROM b WHERE length(t) > 1200
  UNION ALL SELECT corpus_id, 'WARNING', 'invalid_unit' FROM b WHERE {_trim('unit')} <> '' AND lower({_trim('unit')}) NOT IN (SELECT k FROM u)
  UNION ALL SELECT corpus_id, 'INFO', CASE WHEN orgs > 1 THEN 'cross_organization_duplicate' ELSE 'duplicate_description' END FROM b JOIN d USING (f) WHERE d.n > 1
  UNION ALL SELECT corpus_id, 'WARNING', 'repeated_tender_title' FROM b JOIN ti ON ti.f = b.f AND ti.tn = lower({_trim('b.tender_id')}) WHERE ti.n > 1 AND b.description_kind IN ('tender_title', 'nit_brief_description'))
"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return quality.flagged(read(spark, sf, CORPUS), read(spark, sf, UNITS))


@query(f"WITH {_FLAGS} SELECT row_id, severity, check_code FROM fl")
def dq_findings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.findings(_flags(spark, sf)).select("row_id", "severity", "check_code")


@query(f"WITH {_FLAGS} SELECT severity, check_code, count(*) AS findings FROM fl GROUP BY 1, 2")
def dq_counters(spark: SparkSession, sf: str) -> DataFrame:
    return quality.counters(_flags(spark, sf))


@query(
    f"""WITH {_FLAGS}, s AS (SELECT row_id, bool_or(severity = 'ERROR') AS bad FROM fl GROUP BY row_id)
SELECT corpus_id, CASE WHEN bad THEN 'quarantined' WHEN bad IS NOT NULL THEN 'clean_with_warnings' ELSE 'clean' END AS quality_status FROM material_description_corpus LEFT JOIN s ON row_id = corpus_id"""
)
def dq_status(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).select("corpus_id", "quality_status")


@query(
    f"""WITH {_FLAGS}, x AS (SELECT document_url AS p, severity, check_code, count(*) AS n FROM fl JOIN material_description_corpus ON corpus_id = row_id GROUP BY ALL),
m AS (SELECT p, {", ".join(f"array_to_string(list_sort(list(check_code || '=' || n) FILTER (severity = '{k}')), '|') AS {k.lower()}_counts" for k in ("WARNING", "ERROR", "INFO"))} FROM x GROUP BY p),
s AS (SELECT document_url AS p, count(*) AS records_seen, count(*) FILTER (NOT coalesce(bad, false)) AS records_valid, count(*) FILTER (bad) AS records_quarantined FROM material_description_corpus LEFT JOIN (SELECT row_id, bool_or(severity = 'ERROR') AS bad FROM fl GROUP BY 1) ON row_id = corpus_id GROUP BY 1)
SELECT s.p AS source_path, records_seen, records_valid, records_quarantined, coalesce(warning_counts, '') AS warning_counts, coalesce(error_counts, '') AS error_counts, coalesce(info_counts, '') AS info_counts FROM s LEFT JOIN m ON s.p IS NOT DISTINCT FROM m.p"""
)
def dq_file_report(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.file_report(_flags(spark, sf))
    listed = lambda m: F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|"), F.lit(""))
    return report.select("source_path", "records_seen", "records_valid", "records_quarantined", *[listed(c).alias(c) for c in ("warning_counts", "error_counts", "info_counts")])


@query(
    f"""WITH {_FLAGS}, e AS (SELECT DISTINCT row_id, lower(trim(check_code)) AS c FROM quality_issue WHERE row_id IS NOT NULL AND trim(check_code) <> ''),
n AS (SELECT DISTINCT row_id, check_code AS c FROM fl)
SELECT coalesce(e.c, n.c) AS check_code, count(*) FILTER (e.c IS NOT NULL AND n.c IS NOT NULL) AS both, count(*) FILTER (n.c IS NULL) AS only_earlier, count(*) FILTER (e.c IS NULL) AS only_now
FROM e FULL JOIN n ON e.row_id = n.row_id AND e.c = n.c GROUP BY 1"""
)
def dq_against_earlier(spark: SparkSession, sf: str) -> DataFrame:
    earlier = read(spark, sf, "quality_issue").where("row_id is not null and trim(check_code) <> ''").select("row_id", F.lower(F.trim("check_code")).alias("check_code")).distinct().withColumn("e", F.lit(1))
    now = quality.findings(_flags(spark, sf)).select("row_id", "check_code").distinct().withColumn("n", F.lit(1))
    both = earlier.join(now, ["row_id", "check_code"], "full")
    return both.groupBy("check_code").agg(F.count_if(F.col("e").isNotNull() & F.col("n").isNotNull()).alias("both"), F.count_if(F.col("n").isNull()).alias("only_earlier"), F.count_if(F.col("e").isNull()).alias("only_now"))


@query(
    f"""WITH b AS (SELECT nullif({_fold('description')}, '') AS text, nullif({_trim('organization')}, '') AS o FROM material_description_corpus)
SELECT text, count(*) AS records, array_to_string(list_sort(list_distinct(list(o) FILTER (o IS NOT NULL))), '|') AS organizations FROM b WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1"""
)
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_groups(read(spark, sf, CORPUS)).withColumn("organizations", F.array_join("organizations", "|"))


@query(
    "SELECT count(*) AS records, "
    + ", ".join(f"count(*) FILTER ({_trim(c)} <> '') AS {a}" for c, a in (("tender_id", "with_tender"), ("unit", "with_unit"), ("quantity", "with_quantity"), ("item_type_hint", "with_hint")))
    + f", count(*) FILTER ({_trim('source_url')} <> '' OR {_trim('document_url')} <> '') AS with_provenance FROM material_description_corpus"
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.coverage(read(spark, sf, CORPUS))


_HINT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(description, '')), '{p}') THEN '{h}'" for h, p in corpus.HINTS) + " ELSE '' END"


@query(f"SELECT corpus_id, {_HINT_SQL} AS hint FROM material_description_corpus")
def type_hints(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, CORPUS).select("corpus_id", "description")).select("corpus_id", corpus.type_hint(F.col("description")).alias("hint"))


@query("SELECT coalesce(item_type_hint, '') AS value, count(*) AS records FROM material_description_corpus GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def hint_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.value_counts(read(spark, sf, CORPUS), "item_type_hint")


@query()
def corpus_built(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.build_corpus(read(spark, sf, CORPUS))


@query("SELECT organization, description, description_kind, min(corpus_id) AS corpus_id FROM material_description_corpus GROUP BY 1, 2, 3")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["organization", "description", "description_kind"]
    return corpus.first_of_each(read(spark, sf, CORPUS), keys, "corpus_id").select(*keys, "corpus_id")


@query("SELECT corpus_id, printf('M%06d', row_number() OVER (ORDER BY organization NULLS FIRST, description_kind NULLS FIRST, description NULLS FIRST, corpus_id)) AS surrogate_id FROM material_description_corpus")
def surrogate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS).select("corpus_id", "organization", "description_kind", "description")
    return corpus.surrogate_ids(rows, "organization", "description_kind", "description", "corpus_id").select("corpus_id", "surrogate_id")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), 're') ORDER BY p_partkey LIMIT 25")
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.search_names(read(spark, sf, "part"), "re", "p_brand", "p_name", "p_partkey").select("p_partkey", "p_name", "p_brand")


@query(
    """SELECT corpus_id, 'src_' || substr(sha256(CAST(to_json(['src', coalesce(source_system, ''), coalesce(organization, ''), coalesce(nullif(document_url, ''), source_url, '')]) AS VARCHAR)), 1, 24) AS artifact_id FROM material_description_corpus"""
)
def artifact_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, CORPUS).select("corpus_id", identity.artifact_id().alias("artifact_id"))


@query()
def material_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS)
    return rows.select("corpus_id", identity.material_id(rows).alias("material_id"))


_BM25_SQL = f"""
d AS (SELECT corpus_id AS doc, {_tok('description')} AS w FROM material_description_corpus),
qs AS (SELECT DISTINCT item_type_hint AS query FROM material_description_corpus WHERE item_type_hint <> ''),
st AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS avgdl FROM d),
p AS (SELECT doc, len(w) AS l, token, count(*) AS tf FROM (SELECT doc, w, unnest(w) AS token FROM d) GROUP BY ALL),
t AS (SELECT query, token, count(*) AS qf FROM (SELECT query, unnest({_tok('query')}) AS token FROM qs) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM p WHERE token IN (SELECT token FROM t) GROUP BY token),
s AS (SELECT query, doc, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))), 6) AS lexical FROM p JOIN t USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query, doc),
top AS (SELECT query, doc, lexical, row_number() OVER (PARTITION BY query ORDER BY lexical DESC, doc) AS rank FROM s QUALIFY rank <= 10)
"""


def _hint_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("item_type_hint").alias("q")).where("q <> ''").distinct()


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS)
    scores = retrieval.bm25(_hint_queries(rows), rows, "q", "q", "corpus_id", "description").withColumn("lexical", F.round("lexical", 6))
    return retrieval.best(scores, "lexical", 10)


@query(f"WITH {_BM25_SQL} SELECT query, doc, lexical, rank FROM top")
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select("query", "doc", "lexical", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {_BM25_SQL}, rel AS (SELECT item_type_hint AS query, corpus_id AS doc FROM material_description_corpus WHERE item_type_hint <> ''),
w AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
g AS (SELECT top.query, count(*) FILTER (rel.doc IS NOT NULL AND rank <= 1) AS h1, count(*) FILTER (rel.doc IS NOT NULL AND rank <= 5) AS h5, count(*) FILTER (rel.doc IS NOT NULL AND rank <= 10) AS h10,
  min(rank) FILTER (rel.doc IS NOT NULL) AS first, sum(CASE WHEN rel.doc IS NOT NULL THEN 1.0 / log2(rank + 1.0) END) AS dcg, max(rank) AS len FROM top LEFT JOIN rel ON rel.query = top.query AND rel.doc = top.doc GROUP BY top.query),
i AS (SELECT w.query, n, h1, h5, h10, first, dcg, (SELECT sum(1.0 / log2(k + 1.0)) FROM generate_series(1, greatest(least(n, coalesce(len, n)), 1)) AS x(k)) AS ideal FROM w LEFT JOIN g USING (query))
SELECT count(*) AS queries, round(avg(coalesce(h1 / n, 0)), 6) AS recall_at_1, round(avg(coalesce(h5 / n, 0)), 6) AS recall_at_5, round(avg(coalesce(h10 / n, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM i"""
)
def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    relevant = read(spark, sf, CORPUS).where("item_type_hint <> ''").select(F.col("item_type_hint").alias("query"), F.col("corpus_id").alias("doc"))
    found = evaluation.retrieval_metrics(_bm25(spark, sf), relevant)
    return found.select("queries", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg")])


@query(
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, e.vec_id AS doc, round(list_dot_product(v, e.embedding::DOUBLE[]) / sqrt(list_dot_product(v, v) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS dense FROM q CROSS JOIN embeddings e)
SELECT query, doc, round(dense, 6) AS dense FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dense DESC, doc) AS r FROM s) WHERE r <= 10"""
)
def dense_top(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    return retrieval.dense_best(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), 10).select("query", "doc", F.round("dense", 6).alias("dense"))


@query()
def hybrid_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS)
    return retrieval.hybrid(_hint_queries(rows), rows, "q", "q", "corpus_id", "description")


@query()
def index_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.index_checksum(read(spark, sf, CORPUS), "corpus_id", "description")


_FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(description, '')), '{p}') THEN '{n}'" for n, p in att.FAMILIES) + " ELSE 'unknown' END"


@query(f"SELECT corpus_id, {_FAMILY_SQL} AS family FROM material_description_corpus")
def families(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, CORPUS).select("corpus_id", "description")).select("corpus_id", att.family(F.col("description")).alias("family"))


@query()
def attribute_rows(spark: SparkSession, sf: str) -> DataFrame:
    return att.flattened(att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description")), "corpus_id")


@query()
def attribute_view(spark: SparkSession, sf: str) -> DataFrame:
    return att.flat_view(att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description"))).drop("description").withColumn("attributes", att.serialized(F.col("attributes"), F.col("family")))


@query("SELECT c.corpus_id, count(a.attribute_id) AS stored FROM material_description_corpus c LEFT JOIN material_attributes a ON a.material_id = c.corpus_id GROUP BY 1")
def stored_attributes(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, ATTRS).groupBy("material_id").agg(F.count("*").alias("stored"))
    return read(spark, sf, CORPUS).select("corpus_id").join(counts, F.col("corpus_id") == F.col("material_id"), "left").select("corpus_id", F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"))


@query("SELECT material_id, attribute_name, count(DISTINCT normalized_value) AS distinct_values FROM material_attributes WHERE material_id IS NOT NULL AND attribute_name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT normalized_value) > 1")
def attribute_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, ATTRS).where("material_id is not null and attribute_name is not null").groupBy("material_id", "attribute_name").agg(F.countDistinct("normalized_value").alias("distinct_values")).where("distinct_values > 1")


@query()
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalized(read(spark, sf, CORPUS).select("corpus_id", "description"), read(spark, sf, UNITS))


# The table of symbols once more, by hand: symbols of one unit, its name, dimension and factor.
_SYMBOLS = """
t AS (SELECT unnest(string_split(k, ' ')) AS k, name, dim, f FROM (VALUES
  ('kg kgs kilogram kilograms', 'kilogram', 'mass', 1.0), ('gm g gram', 'gram', 'mass', 0.001), ('ton tonne mt metric_ton', 'metric_ton', 'mass', 1000.0),
  ('l litre liter ltr liters', 'liter', 'volume', 0.001), ('kl kiloliter', 'kiloliter', 'volume', 1.0), ('m3 m^3 cu.m cum cubic_meter', 'cubic_meter', 'volume', 1.0),
  ('mm millimeter', 'millimeter', 'length', 0.001), ('cm centimeter', 'centimeter', 'length', 0.01), ('m meter', 'meter', 'length', 1.0), ('in inch', 'inch', 'length', 0.0254),
  ('mm2 sqmm square_millimeter', 'square_millimeter', 'area', 0.000001), ('cm2 square_centimeter', 'square_centimeter', 'area', 0.0001), ('sqm m2 square_meter', 'square_meter', 'area', 1.0),
  ('kw kilowatt', 'kilowatt', 'power', 1000.0), ('kva kilovolt_ampere', 'kilovolt_ampere', 'power', 1000.0), ('mva megavolt_ampere', 'megavolt_ampere', 'power', 1000000.0),
  ('kv kilovolt', 'kilovolt', 'voltage', 1000.0), ('v volt', 'volt', 'voltage', 1.0), ('amp a ampere', 'ampere', 'current', 1.0)) AS x(k, name, dim, f))"""


@query(
    f"""WITH {_SYMBOLS}, u AS (SELECT surface_form, canonical_unit, replace(lower(trim(surface_form)), ' ', '') AS a, replace(lower(trim(canonical_unit)), ' ', '') AS b FROM unit_normalisation)
SELECT surface_form AS source, canonical_unit AS target, coalesce(x.name, a) AS symbol, coalesce(x.dim = y.dim, false) AS convertible, CASE WHEN x.dim = y.dim THEN CAST(x.f AS DOUBLE) / CAST(y.f AS DOUBLE) END AS one_in_target
FROM u LEFT JOIN t x ON x.k = a LEFT JOIN t y ON y.k = b"""
)
def unit_conversions(spark: SparkSession, sf: str) -> DataFrame:
    units = read(spark, sf, UNITS)
    b = F.col("canonical_unit")
    return units.select(F.col("surface_form").alias("source"), b.alias("target"), normalize.unit_symbol(F.col("surface_form")).alias("symbol"), normalize.convertible(F.col("surface_form"), b).alias("convertible"), normalize.convert(F.lit(1.0), F.col("surface_form"), b).alias("one_in_target"))


def _event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, EVENTS).select(F.upper(F.trim("material_a")).alias("a"), F.upper(F.trim("material_b")).alias("b"))


@query(
    f"""WITH p AS (SELECT DISTINCT least(upper(trim(material_a)), upper(trim(material_b))) AS a, greatest(upper(trim(material_a)), upper(trim(material_b))) AS b FROM feedback_event WHERE material_a IS NOT NULL AND material_b IS NOT NULL),
c AS (SELECT corpus_id, list_distinct({_tok('description')}) AS w FROM material_description_corpus)
SELECT a, b, round(len(list_intersect(x.w, y.w)) / greatest(len(list_distinct(list_concat(x.w, y.w))), 1), 6) AS lexical_similarity FROM p JOIN c x ON x.corpus_id = a JOIN c y ON y.corpus_id = b WHERE a <> b"""
)
def pair_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, CORPUS)
    pairs = _event_pairs(spark, sf).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ((F.col("a").isNotNull()) & F.col("b").isNotNull()).alias("k")).where("k and a <> b").drop("k").distinct()
    side = lambda s: rows.select(F.col("corpus_id").alias(s), F.col("description").alias(f"t_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(matching.jaccard(F.col("t_a"), F.col("t_b")), 6).alias("lexical_similarity"))


@query()
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _event_pairs(spark, sf)
    records = att.with_attributes(matching.members_of(pairs, read(spark, sf, CORPUS).select("corpus_id", "description")))
    return matching.scored_pairs(pairs, records)


@query()
def canonical_code_rows(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_codes.canonical_codes(att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description")))


@query()
def canonical_code_registry(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_codes.code_registry(canonical_codes.canonical_codes(att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description"))))


@query(
    f"""WITH b AS (SELECT corpus_id, nullif({_fold('description')}, '') AS t, {_fold("coalesce(organization, '')")} AS o FROM material_description_corpus),
r AS (SELECT t, o, min(corpus_id) AS representative FROM b WHERE t IS NOT NULL GROUP BY 1, 2), c AS (SELECT t, min(representative) AS class_id FROM r GROUP BY t HAVING count(*) > 1)
SELECT corpus_id, class_id, representative FROM b JOIN r USING (t, o) JOIN c USING (t)"""
)
def exact_text_classes(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.exact_classes(read(spark, sf, CORPUS))


@query()
def weak_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    records = att.with_attributes(read(spark, sf, CORPUS).select("corpus_id", "description", "organization"))
    return weak_labels.weak_labels(records)


@query("SELECT count(accepted) AS total, count(*) FILTER (accepted) AS positives, round(coalesce(count(*) FILTER (accepted) / nullif(count(accepted), 0), 1.0), 6) AS quality, count(accepted) >= 1 AND coalesce(count(*) FILTER (accepted) / nullif(count(accepted), 0), 1.0) >= 0.8 AS promote FROM feedback_event")
def shadow_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.shadow_evaluation(read(spark, sf, EVENTS)).withColumn("quality", F.round("quality", 6))


@query("SELECT material_a AS a, material_b AS b, CAST(accepted AS INTEGER) AS label FROM feedback_event WHERE material_a IS NOT NULL AND material_b IS NOT NULL AND accepted IS NOT NULL")
def feedback_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.feedback_pairs(read(spark, sf, EVENTS))


@query(
    """WITH s AS (SELECT coalesce(source, '') AS g, CAST(concat('0x', substr(sha256('42:' || coalesce(source, '')), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551615.0 AS h FROM documents GROUP BY source),
e AS (SELECT min(h) AS lo, max(h) AS hi, count(*) AS n, count(*) FILTER (h < 0.2) AS t FROM s)
SELECT doc_id, CASE WHEN (CASE WHEN t = 0 THEN h = hi WHEN t = n AND n > 1 THEN h <> lo ELSE h < 0.2 END) THEN 'test' ELSE 'train' END AS partition FROM documents JOIN s ON g = coalesce(source, '') CROSS JOIN e"""
)
def source_split(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.group_split(read(spark, sf, DOCS).select("doc_id", "source"), "source").select("doc_id", "partition")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, ATTRS).select("attribute_id", F.col("confidence").alias("score"), F.when(F.col("method") == "manual", 1).otherwise(0).alias("label"))


_JUDGED = "j AS (SELECT attribute_id, confidence AS score, CASE WHEN method = 'manual' THEN 1 ELSE 0 END AS label FROM material_attributes)"


@query(
    f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM j WHERE score IS NOT NULL)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.classification(_judged(spark, sf), "label", "score")
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {_JUDGED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, attribute_id) AS k, sum(label) OVER (ORDER BY score DESC, attribute_id ROWS UNBOUNDED PRECEDING) AS tp FROM j WHERE score IS NOT NULL)
SELECT CAST(sum(label) AS BIGINT) AS positives, round(coalesce(sum(CASE WHEN label = 1 THEN tp / k END) / sum(label), 0), 6) AS average_precision FROM r"""
)
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.average_precision(_judged(spark, sf), "label", "score", "attribute_id")
    return found.select(F.col("positives").cast("bigint").alias("positives"), F.round("average_precision", 6).alias("average_precision"))


@query(
    f"""WITH {_JUDGED}, k AS (SELECT * FROM j WHERE score BETWEEN 0 AND 1), b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(label) AS a FROM k GROUP BY 1)
SELECT round((SELECT avg((score - label) ** 2) FROM k), 6) AS brier, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b"""
)
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration_error(_judged(spark, sf), "label", "score").select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query()
def calibrated_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.group_split(_judged(spark, sf).join(read(spark, sf, ATTRS).select("attribute_id", "material_id"), "attribute_id"), "material_id", 0.5)
    fitted = {m: evaluation.Calibrator.fit(rows.where("partition = 'train'"), "label", "score", m) for m in ("platt", "isotonic")}
    return rows.where("partition = 'test'").select("attribute_id", "score", *[F.round(c.apply(F.col("score")), 6).alias(m) for m, c in fitted.items()])


_LINES = r"l AS (SELECT doc_id, i AS line_no, regexp_replace(string_split_regex(text, '\r\n|\r|\n')[i], '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') AS line FROM documents, unnest(range(1, len(string_split_regex(text, '\r\n|\r|\n')) + 1)) AS x(i) WHERE text IS NOT NULL)"


@query(
    f"""WITH {_LINES}, f AS (SELECT doc_id, line_no, line FROM l WHERE length(line) >= 12 AND regexp_matches(line, '{documents_extract.MATERIAL_NOUN}') AND regexp_matches(line, '{documents_extract.QUANTITY}'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(replace(regexp_extract(line, '{documents_extract.QUANTITY}', 1), ',', '') AS DOUBLE) AS quantity, regexp_extract(line, '{documents_extract.QUANTITY}', 2) AS uom FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM f) WHERE r <= 25"""
)
def line_items(spark: SparkSession, sf: str) -> DataFrame:
    return documents_extract.line_items(read(spark, sf, DOCS), "doc_id", "text").select("doc_id", "line_no", "quantity", "uom")


@query(
    f"""SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '{documents_extract.VOLTAGE}', 1)[1:5], lambda v: CAST(CAST(v AS DOUBLE) * 1000 AS BIGINT)), '|'), '') AS volts,
coalesce(array_to_string(regexp_extract_all(coalesce(text, ''), '{documents_extract.STANDARD}')[1:10], '|'), '') AS standards FROM documents"""
)
def document_specifications(spark: SparkSession, sf: str) -> DataFrame:
    found = documents_extract.specifications(read(spark, sf, DOCS), "doc_id", "text")
    return found.select("doc_id", F.array_join(F.transform("voltage_kv", lambda v: F.round(v * 1000).cast("bigint").cast("string")), "|").alias("volts"), F.array_join("standards", "|").alias("standards"))


@query(
    f"""WITH {_LINES}, h AS (SELECT doc_id, line_no, regexp_extract(line, '(?i)^(\\d{{1,3}})[.)]?\\s+(\\D.{{5,}}?)[\\s,|-]+(\\d+(?:\\.\\d+)?)\\s*(nos?\\.?|sets?|each|kg|mt|mtr?|metres?|lots?|ltr|pairs?)\\s*$', ['n', 'd', 'q', 'u']) AS r FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(r.n AS INTEGER) AS item_no, r.d AS description, CAST(r.q AS DOUBLE) AS quantity, lower(r.u) AS unit FROM h WHERE r.n <> ''"""
)
def document_schedule_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents_extract.schedule_lines(read(spark, sf, DOCS), "doc_id", "text")


@query()
def document_labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents_extract.labelled_lines(read(spark, sf, DOCS), "doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, len(string_split(line, '|')) AS cells FROM l WHERE line <> '' AND len(string_split(line, '|')) > 2 AND NOT (line LIKE '|%' OR line LIKE '%|') ")
def document_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents_extract.table_rows(read(spark, sf, DOCS), "doc_id", "text")
    return rows.select("doc_id", "line_no", F.size("cells").cast("bigint").alias("cells"))


@query("SELECT DISTINCT source_url AS link FROM material_description_corpus WHERE regexp_matches(lower(source_url), 'tender|bid|download')")
def tender_links(spark: SparkSession, sf: str) -> DataFrame:
    return documents_extract.tender_links(read(spark, sf, CORPUS).select(F.array("source_url").alias("links")))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as audit events, one log a user, in the order of their ids."""
    rows = read(spark, sf, "events").where("user_id is not null")
    details = F.create_map(F.lit("input"), F.col("props"), F.lit("output"), F.col("value").cast("string"))
    given = rows.select("user_id", F.col("event_id").alias("seq"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), "event_type", F.lit("feed").alias("actor"), details.alias("details"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return audit.appended(given, "user_id", "seq")


# Of the logs with user_id % 5 = 0 every event whose id is divisible by 3 gets another actor afterwards; of those with 1 all such events are dropped;
# of those with 2 such an event gets another actor and a new hash and id, so that the link after it breaks. What must then fail is counted from the table alone.
@query(
    """WITH e AS (SELECT user_id, event_id, user_id % 5 AS m, event_id % 3 = 0 AS hit, lag(event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS hit_before FROM events WHERE user_id IS NOT NULL),
b AS (SELECT *, CASE WHEN m = 0 THEN hit WHEN m = 1 THEN coalesce(hit_before, false) WHEN m = 2 THEN coalesce(hit_before, false) ELSE false END AS bad FROM e WHERE NOT (m = 1 AND hit))
SELECT user_id, count(*) AS events, count(*) FILTER (bad) AS broken, min(event_id) FILTER (bad) AS first_broken, count(*) FILTER (bad) = 0 AS valid FROM b GROUP BY user_id"""
)
def chain_verified(spark: SparkSession, sf: str) -> DataFrame:
    kind, hit = F.pmod("user_id", F.lit(5)), F.pmod("seq", F.lit(3)) == 0
    edited = _log(spark, sf).where(~((kind == 1) & hit)).withColumn("actor", F.when(hit & kind.isin(0, 2), "other").otherwise(F.col("actor")))
    again = edited.withColumn("_h", audit.rehashed(edited))
    redone = again.withColumn("event_hash", F.when(hit & (kind == 2), F.col("_h")).otherwise(F.col("event_hash")))
    redone = redone.withColumn("event_id", F.when(hit & (kind == 2), F.concat(F.lit(audit.EVENT_ID), F.substring("_h", 1, audit.ID_DIGITS))).otherwise(F.col("event_id")))
    return audit.verified(redone.drop("_h"), "user_id", "seq")


@query("SELECT event_id AS seq, user_id, event_type FROM events WHERE user_id % 100 = 7")
def audit_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    chain = _log(spark, sf).where("cast(entity_id as bigint) % 100 = 7")
    return audit.history(chain, "seq", "user").select("seq", "user_id", "event_type")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, count(*) AS signals, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2")
def signal_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = lineage.signal_graph(read(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    return edges.groupBy("source", "target").agg(F.count("*").alias("signals"), F.round(F.sum("value"), 2).alias("quantity"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT upper(trim(material_a)) AS s, upper(trim(material_b)) AS t FROM feedback_event WHERE material_a IS NOT NULL AND material_b IS NOT NULL),
r AS (SELECT DISTINCT corpus_id AS url, 0 AS depth FROM material_description_corpus WHERE CAST(substr(corpus_id, 2) AS BIGINT) % 20 = 0 UNION SELECT t, depth + 1 FROM r JOIN e ON e.s = r.url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM r GROUP BY url"""
)
def link_frontier(spark: SparkSession, sf: str) -> DataFrame:
    links = _event_pairs(spark, sf).withColumnsRenamed({"a": "source", "b": "target"})
    seeds = read(spark, sf, CORPUS).where("cast(substr(corpus_id, 2) as bigint) % 20 = 0").select(F.col("corpus_id").alias("url"))
    return lineage.frontier(links, seeds, 3)


@query()
def message_clusters(spark: SparkSession, sf: str) -> DataFrame:
    issues = read(spark, sf, "quality_issue").withColumn("check_code", F.lower(F.trim("check_code")))
    return lineage.leader_clusters(issues.select("row_id", "check_code", "message"), "row_id", "message", "check_code")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3"""
)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.windowed_counts(read(spark, sf, "events"), "ts", "event_type")


@query(
    """WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP >= lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sessions(read(spark, sf, "events"), "ts", "user_id")


@query(
    """WITH k AS (SELECT least(upper(trim(material_a)), upper(trim(material_b))) AS a, greatest(upper(trim(material_a)), upper(trim(material_b))) AS b, accepted, substr(replace(created_at, ' ', 'T'), 1, 26) AS w FROM feedback_event WHERE material_a IS NOT NULL AND material_b IS NOT NULL AND accepted IS NOT NULL AND created_at IS NOT NULL),
m AS (SELECT a, b, max(w) AS w FROM k GROUP BY a, b) SELECT a, b, bool_or(accepted) AS accepted FROM k JOIN m USING (a, b, w) GROUP BY a, b"""
)
def latest_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    at = F.substring(F.replace(F.col("created_at"), F.lit(" "), F.lit("T")), 1, 26)
    rows = read(spark, sf, EVENTS).where("material_a is not null and material_b is not null and accepted is not null and created_at is not null")
    keyed = rows.select(F.upper(F.trim("material_a")).alias("x"), F.upper(F.trim("material_b")).alias("y"), F.struct(at.alias("at"), F.col("accepted").alias("accepted")).alias("v"))
    return keyed.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("v").alias("v")).select("a", "b", F.col("v.accepted").alias("accepted"))
