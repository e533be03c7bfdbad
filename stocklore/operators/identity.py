"""Stable identifiers: hashes over canonical JSON of identity parts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_text(c: Column) -> Column:
    """Compatibility-normalised, case-folded text with single spaces, exactly as Unicode defines them (Arrow UDF)."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return fold(c)


def stable_id(namespace: str, *parts: Column) -> Column:
    """``<namespace>_`` and 24 hex digits of the SHA-256 of the JSON array [namespace, parts...]; null parts count as empty."""
    listed = F.to_json(F.array(F.lit(namespace), *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.concat(F.lit(namespace + "_"), F.substring(F.sha2(listed, 256), 1, 24))


def pair_id(a: Column, b: Column) -> Column:
    """Id of an unordered pair; null where a side is null or both are the same."""
    return F.when(a != b, stable_id("pair", F.least(a, b), F.greatest(a, b)))


def material_id(rows: DataFrame) -> Column:
    """Id of a corpus row from where it was found and its identity text, whatever a normaliser makes of it."""
    url = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.nullif(F.col("document_url"), F.lit("")), F.lit(""))
    return stable_id("mat", F.col("source_system"), F.col("organization"), F.coalesce(F.nullif(F.col("corpus_id"), F.lit("")), url), F.lit(""), F.col("source_section"), identity_text(F.col("description")))


def artifact_id() -> Column:
    """Id of the harvested artifact a row came from."""
    url = F.coalesce(F.nullif(F.col("document_url"), F.lit("")), F.col("source_url"))
    return stable_id("src", F.col("source_system"), F.col("organization"), url)
