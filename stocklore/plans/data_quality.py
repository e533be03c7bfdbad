"""Queries on units, rejects and the quality findings of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, read

_FORM = r"upper(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_NUM = r"^\s*(\+?\s*(?:\d+(?:,\d+)*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*((?:.|\n)*?)\s*$"
_AMOUNT = f"try_cast(regexp_replace(regexp_extract({{0}}, '{_NUM}', 1), '[+,\\s]', '', 'g') AS DOUBLE)"
_REST = f"regexp_extract({{0}}, '{_NUM}', 2)"
_AFTER = r"(?i)\b(?:(?:order|total|required|reqd\.?)\s+)?(?:qty|quantity)(?:\s+(?:required|reqd\.?))?[\s.:=-]*(\+?\s*[\d.,]+(?:[eE][+-]?\d+)?\s*[\p{L}.]+[0-9]?(?:\s+(?:metre|nos)\b)?)"
_BEFORE = r"(?i)(?:^|[^\w.,])(\+?[\d.,]+(?:[eE][+-]?\d+)?\s*[\p{L}.]+[0-9]?(?:\s+(?:metre|nos)\b)?)\s+(?:required|reqd)\b"


_READINGS = f"""
f AS (SELECT {_FORM.format('surface_form')} AS k, surface_form, canonical_unit, factor_to_canonical AS factor FROM unit_normalisation),
b AS (SELECT corpus_id, quantity AS q, unit AS u, CASE WHEN trim(coalesce(quantity, '')) = '' AND trim(coalesce(unit, '')) = ''
        THEN coalesce(nullif(regexp_extract(description, '{_AFTER}', 1), ''), nullif(regexp_extract(description, '{_BEFORE}', 1), '')) END AS said
      FROM material_description_corpus),
r AS (SELECT corpus_id, said IS NOT NULL AS by_text, {_AMOUNT.format("coalesce(said, q)")} AS amount, {_REST.format("coalesce(said, q)")} AS rest, CASE WHEN said IS NULL THEN u END AS u FROM b),
j AS (SELECT r.*, fb.canonical_unit AS cb, fb.factor AS xb, fc.canonical_unit AS cc, fc.factor AS xc, coalesce(fb.surface_form, fc.surface_form) AS surface_form
      FROM r LEFT JOIN f fb ON fb.k = {_FORM.format('r.rest')} LEFT JOIN f fc ON fc.k = {_FORM.format('r.u')}
      WHERE amount IS NOT NULL AND NOT isinf(amount) AND (rest = '' OR fb.k IS NOT NULL))"""


@query(
    f"""WITH {_READINGS}
SELECT corpus_id, coalesce(cb, cc) AS canonical_unit,
       CAST(round(CAST(amount AS DECIMAL(20,6)) * CAST(coalesce(xb, xc) * 1000 AS DECIMAL(16,6)), 0) AS BIGINT) AS canonical_milli
FROM j WHERE coalesce(xb, xc) <> 1 AND (cb IS NULL OR cc IS NULL OR (cb = cc AND xb = xc))
"""
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.units_identity import converted_amounts

    return converted_amounts(read(spark, sf, "material_description_corpus"), read(spark, sf, "unit_normalisation"))


@query(
    f"""WITH {_READINGS}, s AS (SELECT *, cb IS NULL OR cc IS NULL OR (cb = cc AND abs(ln(xb) - ln(xc)) < 1e-6) AS ok FROM j WHERE coalesce(xb, xc) IS NOT NULL)
SELECT corpus_id, amount, CASE WHEN ok THEN surface_form END AS surface_form, CASE WHEN ok THEN coalesce(cb, cc) END AS canonical_unit, CASE WHEN ok THEN coalesce(xb, xc) END AS factor,
  CASE WHEN ok THEN amount * coalesce(xb, xc) END AS canonical, CASE WHEN by_text THEN 'text' WHEN xb IS NOT NULL THEN 'quantity' ELSE 'unit' END AS source, ok AS unique_solution FROM s"""
)
def p3_amounts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.units_identity import ordered_amounts

    return ordered_amounts(read(spark, sf, "material_description_corpus"), read(spark, sf, "unit_normalisation"))


_F = '(?:"(?:[^"]|"")*"|[^",]*)'


def _valid(c: str) -> str:
    amount, rest = _AMOUNT.replace("{0}", c), _REST.replace("{0}", c)
    form = _FORM.format("\x00").replace("\x00", rest)
    return f"(regexp_replace(coalesce({c}, ''), '[\\s\\x{{85}}\\p{{Z}}]+', '', 'g') = '' OR ({amount} IS NOT NULL AND NOT isinf({amount}) AND ({rest} = '' OR {form} IN (SELECT k FROM f))))"


_COLUMNS = ("corpus_id", "organization", "source_system", "source_section", "tender_reference", "tender_id", "description", "description_kind", "item_type_hint", "quantity", "unit", "location", "product_category", "document_url", "source_url")
_CELLS = ", ".join(f"regexp_extract(s, '^(?:{_F},){{{i}}}({_F})', 1) AS c{i}" for i in range(15))
_PLAIN = ", ".join(f"""replace(CASE WHEN c{i} LIKE '"%' THEN c{i}[2:-2] ELSE c{i} END, '""', '"') AS {name}""" for i, name in enumerate(_COLUMNS))
_PARSED = f"""f AS (SELECT {_FORM.format('surface_form')} AS k FROM unit_normalisation),
l AS (SELECT line_id, regexp_replace(coalesce(raw_line, ''), '[\\r\\n]+$', '') AS s, raw_line IS NULL AS missing FROM raw_corpus_lines),
c AS (SELECT line_id, NOT regexp_full_match(s, '{_F}(?:,{_F})*') AS broken, CASE WHEN missing THEN 0 ELSE 1 + length(x) - length(replace(x, ',', '')) END AS n, {_PLAIN} FROM (SELECT *, regexp_replace(s, '"(?:[^"]|"")*"', '', 'g') AS x, {_CELLS} FROM l)),
r AS (SELECT line_id AS row_id, CASE WHEN broken THEN 'broken_quoting' WHEN n <> 15 THEN 'wrong_column_count' WHEN NOT {_valid('quantity')} THEN 'invalid_quantity' END AS check_code FROM c
  UNION ALL SELECT corpus_id, CASE WHEN NOT {_valid('quantity')} THEN 'invalid_quantity' END FROM material_description_corpus)"""


@query(f"WITH {_PARSED} SELECT row_id, check_code FROM r WHERE check_code IS NOT NULL")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.reject_rows import rejected

    return rejected(read(spark, sf, "raw_corpus_lines"), read(spark, sf, "material_description_corpus"), read(spark, sf, "unit_normalisation")).select("row_id", "check_code")


@query(
    f"""WITH {_PARSED} SELECT row_id, check_code, CASE check_code WHEN 'invalid_quantity' THEN 'quantity' ELSE 'raw_line' END AS field,
  CASE check_code WHEN 'broken_quoting' THEN 'A quoted value isn''t closed or a quote mark stands where none may.' WHEN 'wrong_column_count' THEN 'The record hasn''t the expected number of values.' ELSE 'The quantity isn''t one finite, non-negative number with a listed unit at most.' END AS message
FROM r WHERE check_code IS NOT NULL"""
)
def p5_rejects(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.reject_rows import rejected

    return rejected(read(spark, sf, "raw_corpus_lines"), read(spark, sf, "material_description_corpus"), read(spark, sf, "unit_normalisation"))


@query(f"WITH {_PARSED} SELECT line_id, {', '.join(f'nullif({c}, $$$$) AS {c}'.replace('$$$$', chr(39) * 2) for c in _COLUMNS)}, {_AMOUNT.format('quantity')} AS amount FROM c JOIN r ON row_id = line_id WHERE check_code IS NULL")
def p5_loaded(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.reject_rows import loaded

    return loaded(read(spark, sf, "raw_corpus_lines"), read(spark, sf, "unit_normalisation"))
