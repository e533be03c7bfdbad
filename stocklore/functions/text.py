"""Text expressions that several operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one finite, non-negative number, commas between digits, exponent allowed, then the rest of the text.
AMOUNT = r"^\s*(\+?\s*(?:\d+(?:,\d+)*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"
BLANKS = r"(?U)[\s​﻿]+"


def form_key(c: Column) -> Column:
    """Letters and digits only, upper case: equal for unit spellings that differ in case, blanks and punctuation."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def is_blank(c: Column) -> Column:
    """True for null, empty and all-blank text."""
    return F.coalesce(F.regexp_replace(c, BLANKS, "") == "", F.lit(True))


def amount_of(c: Column) -> Column:
    """The leading number of a quantity text as DOUBLE; null if there is none or it isn't finite."""
    value = F.regexp_replace(F.regexp_extract(c, "(?s)" + AMOUNT, 1), r"[+,\s](?!\d*$)|^[+\s]+|,", "").try_cast("double")
    return F.when(value < float("inf"), value)


def rest_of(c: Column) -> Column:
    """What follows the leading number of a quantity text."""
    return F.regexp_extract(c, "(?s)" + AMOUNT, 2)


def folded(c: Column) -> Column:
    """Lower case with sharp s unfolded, every run of blanks one space, no outer blanks (null stays null)."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), BLANKS, " "))


def clean_text(c: Column) -> Column:
    """Text without outer blanks; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed; empty text if all are."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in columns], F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))


def finite_number(c: Column) -> Column:
    """DOUBLE of a number text with commas left out; null where it isn't a finite number."""
    v = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
