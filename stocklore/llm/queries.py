"""Queries of the subpackage; ``register`` adds them to the driver's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from .link_groups import material_groups

    return material_groups(_read(spark, sf, "feedback_event"), _read(spark, sf, "material_description_corpus"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from .format_duplicates import format_copies

    return format_copies(_read(spark, sf, "material_description_corpus"), "corpus_id", "description", "tender_reference")


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    from .format_duplicates import collapsed

    return collapsed(_read(spark, sf, "material_description_corpus"), "corpus_id", "description", "tender_reference")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    from .canonical_values import mapped_rows

    units = mapped_rows(_read(spark, sf, "material_description_corpus"), "corpus_id", "unit", _read(spark, sf, "unit_normalisation"), "surface_form")
    grades = _read(spark, sf, "material_attributes").where("attribute_name = 'grade'")
    return units.unionByName(mapped_rows(grades, "attribute_id", "value", _read(spark, sf, "material_grades"), "grade_token"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("entry_id", "reference_entry")


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    from .canonical_values import unmatched_report

    return unmatched_report(_mapped(spark, sf))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    from .encoding_repair import garbled_rows

    return garbled_rows(_read(spark, sf, "material_description_corpus"), "corpus_id", "description", "document_url", _read(spark, sf, "data_quality_report"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("corpus_id")


def p7_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf)


CAPACITY = 2048


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    from .tokens import token_count

    return spread(_read(spark, sf, "documents")).withColumn("n_tokens", token_count(F.col("text")))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.durable import durable
    from .packing import pack

    return pack(durable(_sized(spark, sf).select("doc_id", "n_tokens")), CAPACITY)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import fill_report

    return fill_report(p8_packed(spark, sf), CAPACITY)


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.durable import durable

    return durable(_sized(spark, sf).select("doc_id", "source", "n_tokens"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    from .mixture import mixture

    return mixture(_read(spark, sf, "documents"), _slim(spark, sf), _read(spark, sf, "source_weights"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    from .mixture import mixed_sizes, shares

    weights = _read(spark, sf, "source_weights")
    return shares(mixed_sizes(_slim(spark, sf), weights), weights)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from .sentences import sentences

    return sentences(_read(spark, sf, "documents"), with_text=False).select("doc_id", "end_char")


def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    from .sentences import sentences

    return sentences(_read(spark, sf, "documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from .product_groups import product_groups

    return product_groups(_read(spark, sf, "material_description_corpus"), _read(spark, sf, "material_grades"))


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with tokens, and whether its pieces follow one another without gap, are split only beyond the capacity, and stand in containers that hold no more than it."""
    from ..operators.durable import durable
    from .packing import pack

    sized = durable(_sized(spark, sf).select("doc_id", "n_tokens"))
    packed = durable(pack(sized, CAPACITY))
    fits = packed.groupBy("container_id").agg((F.sum("length") <= CAPACITY).alias("fits"))
    per = packed.join(fits, "container_id").groupBy("doc_id").agg(F.sum("length").alias("t"), F.count("*").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.countDistinct("start").alias("starts"), F.bool_and("fits").alias("fits"))
    whole = (F.col("t") == F.col("n_tokens")) & (F.col("end") == F.col("t")) & (F.col("starts") == F.col("n")) & (F.col("n") == F.ceil(F.col("t") / CAPACITY)) & F.col("fits")
    return sized.where("n_tokens > 0").join(per, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"))


def p9_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Every source, and whether its documents keep within their repeats and its share is nearer to the target than one of its documents.

    Targets are those of the mixture: shares of the sources that can come (with tokens, a share and repeats), scaled to sum to 1; of others nothing may come.
    """
    from .mixture import mixed_sizes, shares

    weights, sized = _read(spark, sf, "source_weights"), _slim(spark, sf)
    longest = sized.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    found = shares(mixed_sizes(sized, weights), weights).join(longest, "source", "left")
    comes = F.col("longest").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every, wanted = (F.sum(x).over(Window.partitionBy()) for x in ("tokens", F.when(comes, F.col("target_share"))))  # one row a source
    near = F.when(comes, F.abs(F.col("tokens") - F.col("target_share") / wanted * every) <= F.col("longest") + 1).otherwise(F.col("tokens") == 0)
    return found.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), near.alias("share_kept"))


def p10_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Characters that aren't blank, by document, counted in its sentences."""
    from .sentences import sentences

    found = sentences(_read(spark, sf, "documents"))
    return found.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"[\s\x{85}\p{Z}\x{200B}\x{FEFF}]+", ""))).alias("characters"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_copies, p4_found, p6_found, p6_unmatched, p7_found, p7_restored, p8_packed, p8_report, p8_whole, p9_mixture, p9_shares, p9_limits, p10_found, p10_sentences, p10_covered)}
ORACLES: dict[str, str] = {}
ORACLES["p1_found"] = """
WITH RECURSIVE k AS (
  SELECT upper(regexp_replace(material_a, '^\\s+|\\s+$', '', 'g')) AS a, upper(regexp_replace(material_b, '^\\s+|\\s+$', '', 'g')) AS b
  FROM feedback_event WHERE accepted AND material_a IS NOT NULL AND material_b IS NOT NULL),
e AS (SELECT a, b FROM k WHERE a <> b UNION SELECT b, a FROM k WHERE a <> b),
r AS (SELECT a AS material_id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.material_id AND r.m < e.b)
SELECT min(m) AS group_id, material_id FROM r GROUP BY material_id
"""

# Both texts folded to letters and digits; of the description the words, sorted (fields in any order). A decimal point stays with its number.
ORACLES["p2_found"] = """
WITH k AS (SELECT corpus_id, array_to_string(regexp_extract_all(lower(tender_reference), '[\\p{L}\\p{M}\\p{N}]+'), '') AS r,
    array_to_string(list_sort(regexp_extract_all(lower(description), '[\\p{L}\\p{M}]+|[0-9]+(?:\\.[0-9]+)?')), ' ') AS w
  FROM material_description_corpus WHERE regexp_matches(description, '[^\\s]') AND regexp_matches(tender_reference, '[^\\s]')),
f AS (SELECT r, w, min(corpus_id) AS first_id FROM k GROUP BY r, w HAVING count(*) > 1)
SELECT first_id, corpus_id AS copy_id FROM k JOIN f USING (r, w) WHERE corpus_id <> first_id
"""

ORACLES["p2_copies"] = ORACLES["p2_found"].split("SELECT first_id, corpus_id")[0] + """
, c AS (SELECT k.corpus_id, f.first_id FROM k JOIN f USING (r, w)), n AS (SELECT first_id, count(*) AS copies FROM c GROUP BY 1)
SELECT m.corpus_id AS first_id, coalesce(n.copies, 1) AS copies FROM material_description_corpus m LEFT JOIN n ON n.first_id = m.corpus_id WHERE m.corpus_id NOT IN (SELECT corpus_id FROM c WHERE corpus_id <> first_id)
"""

# What must hold of every document and source, whatever the tokenizer counts.
ORACLES["p8_whole"] = "SELECT doc_id, true AS whole FROM documents WHERE length(text) > 0"
ORACLES["p9_limits"] = "SELECT source, true AS repeats_kept, true AS share_kept FROM source_weights"
ORACLES["p10_covered"] = "SELECT doc_id, length(regexp_replace(text, '[\\s\\x0b\\x{85}\\p{Z}\\x{200B}\\x{FEFF}]+', '', 'g')) AS characters FROM documents WHERE regexp_matches(text, '[^\\s\\x0b\\x{85}\\p{Z}\\x{200B}\\x{FEFF}]')"
