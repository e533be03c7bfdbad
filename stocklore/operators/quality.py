"""Quality checks of corpus rows: findings, counters, and the split into clean and quarantined rows.

All checks are column expressions over one scan. Only the duplicate checks need a
shuffle: per-text and per-title counts are aggregated first (partial sums before the
shuffle) and joined back, so a text that makes up a third of all rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, finite_number, first_filled, folded, form_key

# Wording of administrative notices, and the longest plausible specification.
ADMIN_TERMS = r"(?i)\b(?:tender|bid submission|earnest money|emd|corrigendum|pre[- ]bid meeting|contractor registration|vendor enlistment)\b"
NO_LETTERS = r"(?U)^[\W\d.,/+_-]+$"
MAX_LENGTH = 1200
TITLE_KINDS = ("tender_title", "nit_brief_description")

# Code -> (severity, field, message).
CHECKS = {
    "empty_description": ("ERROR", "description", "The record has no description."),
    "numeric_only_description": ("ERROR", "description", "The description holds no letters."),
    "administrative_text": ("WARNING", "description", "The text seems to be about a notice, not a material."),
    "missing_provenance_url": ("WARNING", "source_url", "Neither a source address nor a document is given."),
    "missing_source_system": ("WARNING", "source_system", "The source system isn't given."),
    "invalid_quantity": ("ERROR", "quantity", "The quantity isn't a finite, non-negative number."),
    "malformed_specification": ("WARNING", "description", "The description is longer than a specification should be."),
    "invalid_unit": ("WARNING", "unit", "The unit isn't in the unit list."),
    "invalid_taxonomy_code": ("WARNING", "taxonomy_code", "A taxonomy code has exactly eight digits."),
    "duplicate_description": ("INFO", "description", "The same description occurs again."),
    "cross_organization_duplicate": ("INFO", "description", "The same description occurs at another organization."),
    "repeated_tender_title": ("WARNING", "description", "The same title occurs again under one tender."),
}


def _columns(rows: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in rows.columns] or [F.lit("")]


def flagged(rows: DataFrame, units: DataFrame, key: str = "corpus_id") -> DataFrame:
    """``rows`` with ``checks``, the array of check codes that apply, and ``quality_status``.

    Null and blank values count as missing. With an empty unit list every unit is known.
    """
    text = first_filled(*_columns(rows, "description", "item_description", "item_text", "short_description", "long_description", "specifications"))
    base = rows.select("*", text.alias("_text"))
    base = base.withColumn("_fold", F.nullif(folded(F.col("_text")), F.lit("")))
    org = folded(F.coalesce(F.col("organization"), F.lit("")))
    by_text = base.where("_fold is not null").groupBy("_fold").agg(F.count("*").alias("_same"), F.min(org).alias("_o1"), F.max(org).alias("_o2")).where("_same > 1")
    titled = F.col("description_kind").isin(*TITLE_KINDS) & (clean_text(F.col("tender_id")) != "") & F.col("_fold").isNotNull()
    base = base.withColumn("_tender", F.when(titled, F.lower(clean_text(F.col("tender_id")))))
    by_title = base.where("_tender is not null").groupBy("_tender", "_fold").agg(F.count("*").alias("_titles")).where("_titles > 1")
    forms = units.select(F.lower(F.trim("surface_form")).alias("_unit")).where("_unit <> ''").distinct().withColumn("_known", F.lit(True))
    unit = F.lower(first_filled(*_columns(rows, "unit", "uom")))
    any_form = forms.agg((F.count("*") > 0).alias("_any_form"))  # one row
    joined = (
        base.crossJoin(F.broadcast(any_form)).withColumn("_unit", unit).join(by_text, "_fold", "left").join(by_title, ["_tender", "_fold"], "left").join(forms, "_unit", "left")
    )
    quantity, taxonomy = first_filled(F.col("quantity")), first_filled(*_columns(rows, "unspsc_code", "taxonomy_code"))
    number = finite_number(quantity)
    checks = F.array_compact(F.array(
        F.when(F.col("_text") == "", "empty_description"),
        F.when((F.col("_text") != "") & F.col("_text").rlike(NO_LETTERS), "numeric_only_description"),
        F.when(F.col("_text").rlike(ADMIN_TERMS), "administrative_text"),
        F.when(first_filled(*_columns(rows, "source_url", "document_url", "source_document")) == "", "missing_provenance_url"),
        F.when(first_filled(*_columns(rows, "source_system", "source", "source_table")) == "", "missing_source_system"),
        F.when((quantity != "") & (number.isNull() | (number < 0)), "invalid_quantity"),
        F.when(F.length("_text") > MAX_LENGTH, "malformed_specification"),
        F.when((F.col("_unit") != "") & F.col("_any_form") & F.col("_known").isNull(), "invalid_unit"),
        F.when((taxonomy != "") & ~taxonomy.rlike(r"^\d{8}$"), "invalid_taxonomy_code"),
        F.when(F.col("_same") > 1, F.when(F.col("_o1") != F.col("_o2"), "cross_organization_duplicate").otherwise("duplicate_description")),
        F.when(F.col("_titles") > 1, "repeated_tender_title"),
    ))
    kept = joined.withColumn("checks", checks).select(*rows.columns, "checks")
    errors = [c for c, (severity, *_) in CHECKS.items() if severity == "ERROR"]
    status = F.when(F.arrays_overlap("checks", F.array(*map(F.lit, errors))), "quarantined").when(F.size("checks") > 0, "clean_with_warnings").otherwise("clean")
    return kept.withColumn("quality_status", status)


def findings(flags: DataFrame, key: str = "corpus_id") -> DataFrame:
    """One row a finding: ``row_id``, ``severity``, ``check_code``, ``field``, ``message``."""
    table = F.create_map(*[x for code, parts in CHECKS.items() for x in (F.lit(code), F.struct(*[F.lit(p).alias(n) for p, n in zip(parts, ("severity", "field", "message"))]))])
    one = flags.select(F.col(key).alias("row_id"), F.explode("checks").alias("check_code")).withColumn("_c", table[F.col("check_code")])
    return one.select("row_id", F.col("_c.severity").alias("severity"), "check_code", F.col("_c.field").alias("field"), F.col("_c.message").alias("message"))


def counters(flags: DataFrame) -> DataFrame:
    """Number of findings by severity and check."""
    return findings(flags).groupBy("severity", "check_code").agg(F.count("*").alias("findings"))


def file_report(flags: DataFrame, path: str = "document_url") -> DataFrame:
    """One row a source file: records seen, valid, quarantined, and the counters as maps by severity."""
    per_check = flags.select(F.col(path).alias("source_path"), F.explode("checks").alias("c")).groupBy("source_path", "c").agg(F.count("*").alias("n"))
    severity = F.create_map(*[x for code, parts in CHECKS.items() for x in (F.lit(code), F.lit(parts[0]))])
    entry = F.struct(F.col("c"), F.col("n"))
    maps = per_check.withColumn("s", severity[F.col("c")]).groupBy("source_path").agg(*[
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("s") == name.upper(), entry)))).alias(f"{name}_counts") for name in ("warning", "error", "info")
    ])
    seen = flags.groupBy(F.col(path).alias("source_path")).agg(
        F.count("*").alias("records_seen"), F.count_if(F.col("quality_status") != "quarantined").alias("records_valid"), F.count_if(F.col("quality_status") == "quarantined").alias("records_quarantined")
    )
    return seen.join(maps.withColumnRenamed("source_path", "_path"), F.col("source_path").eqNullSafe(F.col("_path")), "left").drop("_path")


def split(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows)."""
    return flags.where("quality_status <> 'quarantined'"), flags.where("quality_status = 'quarantined'")


def unit_key_conflicts(units: DataFrame) -> DataFrame:
    """Unit forms that fall together once case, blanks and punctuation are left out but name different units."""
    return units.groupBy(form_key(F.col("surface_form")).alias("form")).agg(F.countDistinct("canonical_unit").alias("units")).where("units > 1")
