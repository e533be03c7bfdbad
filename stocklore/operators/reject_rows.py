"""Rows that fail to parse, set apart with the reason while the sound rows load.

The parser is a structural index: over the bytes of a whole Arrow batch numpy marks
quotes, the prefix parity of quotes tells what stands inside a quoted value, and commas
at even parity are the delimiters (a line break is ordinary text here: each row of the
feed is one record). Counts and type checks then make sound or reasoned reject rows. No
row is parsed twice and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount_of, form_key, is_blank, rest_of
from ..session import spread

# The feed's columns in order, and the wording of the findings.
FEED_COLUMNS = (
    "corpus_id", "organization", "source_system", "source_section", "tender_reference", "tender_id", "description", "description_kind",
    "item_type_hint", "quantity", "unit", "location", "product_category", "document_url", "source_url",
)
MESSAGES = {
    "broken_quoting": "A quoted value isn't closed or a quote mark stands where none may.",
    "wrong_column_count": "The record hasn't the expected number of values.",
    "invalid_quantity": "The quantity isn't one finite, non-negative number with a listed unit at most.",
}


def structural_index(lines: list[bytes], columns: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes] | None]]:
    """(broken quoting, number of values, values of rows that have ``columns`` of them and sound quoting) of CSV records."""
    n = len(lines)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64), []
    joined = b"\n".join(lines) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in lines), np.int64, n)
    stop = np.cumsum(lengths) - 1
    start = np.r_[0, stop[:-1] + 1]
    quote = b == 0x22
    count = np.cumsum(quote)
    before = np.where(start > 0, count[start - 1], 0)
    row = np.repeat(np.arange(n), lengths)
    parity = (count - before[row]) & 1
    edge = np.zeros(len(b), bool)
    edge[stop] = True
    comma = (b == 0x2C) & (parity == 0)
    value_ends = comma | edge
    odd = np.zeros(n, bool)
    odd |= ((count[stop] - before) & 1).astype(bool)
    opens = np.flatnonzero(quote & (parity == 1))
    closes = np.flatnonzero(quote & (parity == 0))
    starts_value = np.r_[True, value_ends[:-1]]
    doubled = np.r_[False, quote[:-1] & (parity[:-1] == 0)]
    bad_open = opens[~(starts_value[opens] | doubled[opens])]
    bad_close = closes[~(value_ends[closes + 1] | quote[closes + 1])]
    odd[row[bad_open]] = True
    odd[row[bad_close]] = True
    # a quote directly behind a closed value must reopen it: `""` is one quote inside, but not as a whole value followed by more
    per_row = np.bincount(row[comma], minlength=n) + 1
    values: list[list[bytes] | None] = [None] * n
    good = np.flatnonzero(~odd & (per_row == columns))
    if len(good):
        marks = np.flatnonzero(comma & (~odd & (per_row == columns))[row]).reshape(len(good), columns - 1)
        for k, r in enumerate(good):
            cuts = [int(start[r]) - 1, *marks[k].tolist(), int(stop[r])]
            cells = [joined[cuts[i] + 1 : cuts[i + 1]] for i in range(columns)]
            values[r] = [c[1:-1].replace(b'""', b'"') if c[:1] == b'"' else c for c in cells]
    return odd, per_row, values


def parsed_feed(feed: DataFrame, key: str = "line_id", line: str = "raw_line", columns: tuple[str, ...] = FEED_COLUMNS) -> DataFrame:
    """``key``, ``_broken``, ``_count`` and the ``columns`` as STRING (null where the record can't be cut). A null line counts 0 values."""
    key_type = feed.select(key).schema.simpleString()[7:-1].replace(":", " ")
    inner = [f"_c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            broken, count, values = structural_index([(x or "").rstrip("\r\n").encode() for x in raw], len(columns))
            cells = [pa.array([v[i].decode("utf-8", "replace") if v else None for v in values], pa.string()) for i in range(len(columns))]
            counts = np.where(np.array([x is None for x in raw], bool), 0, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(broken), pa.array(counts.astype(np.int32)), *cells], [key, "_broken", "_count", *inner])

    out = spread(feed.select(key, line)).mapInArrow(run, f"{key_type}, _broken boolean, _count int" + "".join(f", {c} string" for c in inner))
    return out.select(F.col(key).alias("_key"), "_broken", "_count", *[F.col(i).alias(c) for i, c in zip(inner, columns)])


def _listed(units: DataFrame) -> DataFrame:
    return units.select(form_key(F.col("surface_form")).alias("_form")).where("_form <> ''").distinct()


def quantity_checked(rows: DataFrame, units: DataFrame, quantity: str = "quantity") -> DataFrame:
    """Adds ``quantity_valid``: empty, or one finite non-negative number, alone or followed by a listed unit form."""
    rest = rest_of(F.col(quantity))
    looked_up = rows.withColumn("_amount", amount_of(F.col(quantity))).withColumn("_rest", rest).withColumn("_form", F.when(F.col("_amount").isNotNull() & (F.col("_rest") != ""), form_key(F.col("_rest"))))
    known = looked_up.join(_listed(units).withColumn("_is_listed", F.lit(True)), "_form", "left")
    valid: Column = is_blank(F.col(quantity)) | (F.col("_amount").isNotNull() & ((F.col("_rest") == "") | F.coalesce("_is_listed", F.lit(False))))
    return known.withColumn("quantity_valid", F.coalesce(valid, F.lit(False))).drop("_amount", "_rest", "_form", "_is_listed")


def _message(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[code]


def rejected(feed: DataFrame, corpus: DataFrame, units: DataFrame) -> DataFrame:
    """(``row_id``, ``check_code``, ``field``, ``message``) of feed lines and corpus rows that can't be loaded; the first check that applies counts."""
    lines = quantity_checked(parsed_feed(feed), units)
    code = F.when(F.col("_broken"), "broken_quoting").when(F.col("_count") != len(FEED_COLUMNS), "wrong_column_count").when(~F.col("quantity_valid"), "invalid_quantity")
    bad_lines = lines.select(F.col("_key").alias("row_id"), code.alias("check_code"))
    rows = quantity_checked(corpus.select("corpus_id", "quantity"), units)
    bad_rows = rows.select(F.col("corpus_id").alias("row_id"), F.when(~F.col("quantity_valid"), "invalid_quantity").alias("check_code"))
    bad = bad_lines.unionByName(bad_rows).where("check_code is not null")
    return bad.select("row_id", "check_code", F.when(F.col("check_code") == "invalid_quantity", "quantity").otherwise("raw_line").alias("field"), _message(F.col("check_code")).alias("message"))


def loaded(feed: DataFrame, units: DataFrame) -> DataFrame:
    """The sound feed rows: ``line_id``, the 15 columns with empty values as null, and ``amount`` DOUBLE."""
    lines = quantity_checked(parsed_feed(feed), units).where(~F.col("_broken") & (F.col("_count") == len(FEED_COLUMNS)) & F.col("quantity_valid"))
    return lines.select(F.col("_key").alias("line_id"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in FEED_COLUMNS], amount_of(F.col("quantity")).alias("amount"))
