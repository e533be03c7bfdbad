"""Material records out of raw rows, unions of differing inputs, lookups, and small text keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, finite_number
from .corpus import clean_description, first_of_each, type_hint, MAX_LENGTH, MIN_LENGTH

# Columns that may give a field of a record, best first.
ALIASES = {
    "source_organization": ("source_organization", "organization"),
    "source_record_id": ("source_record_id", "tender_id", "tender_reference", "material_code", "corpus_id"),
    "source_url": ("source_url",), "source_document": ("source_document", "document_url"), "source_page": ("source_page", "page"), "source_section": ("source_section", "section"),
    "material_code": ("material_code", "corpus_id"), "plant": ("plant",),
    "raw_description": ("description", "item_description", "item_text", "short_description", "long_description", "specifications"),
    "quantity": ("quantity",), "unit": ("unit", "uom"), "organization": ("organization",), "source_system": ("source_system",),
}
# The columns of the corpus.
CORPUS_FIELDS = ("organization", "source_system", "source_section", "tender_reference", "tender_id", "description", "description_kind", "quantity", "unit", "location", "product_category", "document_url", "source_url")


def given(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that isn't null or empty, without outer blanks; empty text if none is. (A blank value counts as given.)"""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
    return F.regexp_replace(F.coalesce(*found, F.lit("")), r"(?U)^\s+|\s+$", "")


def material_records(rows: DataFrame, artifact_path: Column | None = None, artifact_hash: Column | None = None) -> DataFrame:
    """One material record a row: the fields of ``ALIASES``, ``source_hash``, and ``metadata`` (artifact path and hash, and the columns that no field knows, under their names).

    A quantity that isn't a finite number is null, as is a page that isn't a positive whole number; a missing source system is ``unknown``.
    """
    known = {n for names in ALIASES.values() for n in names}
    value = {field: given(rows, names) for field, names in ALIASES.items()}
    page = F.when(value["source_page"].rlike(r"^\d+$"), value["source_page"].try_cast("int"))
    value["source_page"] = F.when(page > 0, page)
    value["quantity"] = finite_number(value["quantity"])
    value["source_system"] = F.coalesce(F.nullif(value["source_system"], F.lit("")), F.lit("unknown"))
    rest = [c for c in rows.columns if c not in known]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    path, digest = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (artifact_path, artifact_hash))
    metadata = F.create_map(F.lit("ingest_artifact_path"), path, F.lit("ingest_artifact_hash"), digest, *pairs)
    return rows.select(*[value[f].alias(f) for f in ALIASES], digest.alias("source_hash"), metadata.alias("metadata"))


def projected(rows: DataFrame, fields: Mapping[str, Column | str]) -> DataFrame:
    """One input of the corpus: its columns (or constants) as corpus fields, cleaned; fields it lacks are empty text, descriptions of the wrong length are left out."""
    chosen = [(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) if (c := fields.get(f)) is not None else F.lit("")).alias(f) for f in CORPUS_FIELDS]
    cleaned = rows.select(*chosen).withColumn("description", clean_description(F.col("description")))
    return cleaned.where(F.length("description").between(MIN_LENGTH, MAX_LENGTH))


def corpus_union(*inputs: DataFrame) -> DataFrame:
    """Projected inputs together, in the order given: of rows that agree in organization, description and kind the first input's first stays, with a recomputed type hint."""
    placed = [p.withColumn("_input", F.lit(i)) for i, p in enumerate(inputs)]
    every = reduce(DataFrame.unionByName, placed).withColumn("_order", F.struct("_input", *[F.col(f) for f in CORPUS_FIELDS if f not in ("organization", "description", "description_kind")]))
    return first_of_each(every, ["organization", "description", "description_kind"], "_order").drop("_input", "_order").withColumn("item_type_hint", type_hint(F.col("description")))


def with_stored(listed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``listed`` and those of ``stored`` whose key it lacks; columns that a side lacks are null."""
    return listed.unionByName(stored.join(listed.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def with_artifacts(records: DataFrame, artifacts: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Records beside the artifact they came from (inner join on the artifact's id)."""
    return records.join(artifacts, key)


def looked_up(rows: DataFrame, key: str, *values) -> DataFrame:
    """Rows with one of the given keys; the filter reaches the scan."""
    return rows.where(F.col(key).isin(*values)) if values else rows.limit(0)


def hits_with_records(hits: DataFrame, records: DataFrame, key: str, *columns: str) -> DataFrame:
    """Search hits (``query``, ``doc``, ``rank``, ...) with columns of the records found."""
    return hits.join(records.select(F.col(key).alias("doc"), *columns), "doc")


def violations(rows: DataFrame, unique: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """(``rule``, ``columns``, ``rows``) of broken table rules: repeated unique keys (rows beyond the first; null keys don't count) and nulls in required columns."""
    found = []
    if unique:
        per = rows.dropna(subset=list(unique)).groupBy(*unique).agg(F.count("*").alias("n"))
        found.append(per.agg(F.sum(F.col("n") - 1).alias("rows")).select(F.lit("unique").alias("rule"), F.lit(",".join(unique)).alias("columns"), F.coalesce("rows", F.lit(0)).alias("rows")))
    if required:
        counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        found += [counts.select(F.lit("required").alias("rule"), F.lit(c).alias("columns"), F.col(c).alias("rows")) for c in required]
    every = reduce(DataFrame.unionByName, found)
    return every.where("rows > 0")


def item_text(c: Column) -> Column:
    """Text of an item line: without font codes ``(cid:n)`` and Devanagari, straight apostrophes, single blanks, no edge marks."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:\d+\)", " "), r"[\x{900}-\x{97F}]+", " ")
    return F.regexp_replace(F.regexp_replace(F.translate(bare, "’‘", "''"), r"(?U)\s+", " "), r"^[ \t|:-]+|[ \t|:-]+$", "")


def snake_case(c: Column) -> Column:
    """A label as a column name: lower case, runs of other characters one underscore, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_slug(c: Column, most: int = 120) -> Column:
    """A file name: letters, digits, points, dashes and underscores kept, runs of others one underscore, at most ``most`` characters."""
    return F.substring(F.regexp_replace(clean_text(c), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def bracketed(c: Column) -> Column:
    """The texts between square brackets, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda x: F.trim(x))


def spend(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Spend by a key: ``rows``, ``spend``; rows without a value count 0."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.sum(F.coalesce(F.col(value), F.lit(0))), 2).alias("spend"))
