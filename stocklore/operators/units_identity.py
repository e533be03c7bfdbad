"""Quantities recorded in different units and scales.

A record gives evidence on one physical amount in several columns: a number, a unit in a
column of its own, a unit behind the number, a statement in running text. Identities tie
the columns together (number x unit = amount; or mass = density x volume). Each column
may mean several units; the combination whose log residual over the identities is least
is chosen, and where two combinations with different results fit equally well the row is
flagged as not unique. Everything is row-wise built-in expressions: no shuffle beyond the
join with the unit table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount_of, form_key, is_blank, rest_of

# How running text states a required quantity.
STATED_AFTER = r"(?i)\b(?:(?:order|total|required|reqd\.?)\s+)?(?:qty|quantity)(?:\s+(?:required|reqd\.?))?[\s.:=-]*(\+?\s*[\d.,]+(?:[eE][+-]?\d+)?\s*[\p{L}.]+[0-9]?(?:\s+(?:metre|nos)\b)?)"
STATED_BEFORE = r"(?i)(?<![\w.,])(\+?[\d.,]+(?:[eE][+-]?\d+)?\s*[\p{L}.]+[0-9]?(?:\s+(?:metre|nos)\b)?)\s+(?:required|reqd)\b"


def _logs(exponent: float, value: str, candidates: str) -> Column:
    """Each candidate unit with its share of the log residual."""
    log = F.ln(F.when(F.col(value) > 0, F.col(value)))
    units = F.when(log.isNotNull(), F.col(candidates))
    return F.transform(units, lambda u: F.struct((F.lit(exponent) * (log + F.ln(u["factor"]))).alias("r"), u.alias("u")))


def _extended(combos: Column, cell: Column) -> Column:
    """Every combination so far with every candidate of one more column."""
    return F.flatten(F.transform(combos, lambda a: F.transform(cell, lambda b: F.struct((a["r"] + b["r"]).alias("r"), F.concat(a["c"], F.array(b["u"])).alias("c")))))


def solve_units(rows: DataFrame, terms: Sequence[tuple[str, float, str, str]], tolerance: float = 0.02, like: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Chooses one unit a column so that sum(exponent x ln(value x factor)) is nearest 0.

    ``terms``: (name, exponent, value column, candidates column); candidates are
    ARRAY<STRUCT<unit STRING, factor DOUBLE, ...>>, further fields are carried along. Terms paired in
    ``like`` must come out in units of one ``dimension`` (a field of both). Adds ``residual``,
    ``unique_solution`` (false where another combination fits within ``tolerance`` and differs in a factor or dimension)
    and, for each term, ``<name>_unit``, ``<name>_canonical`` and ``<name>_choice`` (the candidate).
    Non-positive or null values, empty candidate lists and dimensions that never agree leave a row
    unsolved (nulls). Mass = density x volume is ``[("mass", 1, ..), ("density", -1, ..), ("volume", -1, ..)]``.
    """
    candidate = rows.schema[terms[0][3]].dataType.simpleString()
    combos: Column = F.array(F.struct(F.lit(0.0).alias("r"), F.array().cast(candidate).alias("c")))
    for _, exponent, value, candidates in terms:
        combos = _extended(combos, _logs(float(exponent), value, candidates))
    place = {name: i for i, (name, *_) in enumerate(terms)}
    if like:
        combos = F.filter(combos, lambda x: reduce(lambda p, q: p & q, [x["c"][place[a]]["dimension"] == x["c"][place[b]]["dimension"] for a, b in like]))
    ranked = F.array_sort(F.transform(combos, lambda x: F.struct(F.round(F.abs(x["r"]), 9).alias("r"), x["c"].alias("c"))))
    out = rows.withColumn("_ranked", ranked)
    best = F.try_element_at("_ranked", F.lit(1))
    parts = ["factor"] + (["dimension"] if "dimension" in rows.schema[terms[0][3]].dataType.elementType.names else [])
    meaning = lambda c: F.transform(c, lambda u: F.struct(*[u[p] for p in parts]))
    rival = F.exists("_ranked", lambda x: (x["r"] <= best["r"] + tolerance) & (meaning(x["c"]) != meaning(best["c"])))
    out = out.withColumn("residual", best["r"]).withColumn("unique_solution", F.when(best.isNotNull(), ~rival)).withColumn("_best", best["c"])
    for name, _, value, _ in terms:
        chosen = F.try_element_at("_best", F.lit(place[name] + 1))
        out = out.withColumn(f"{name}_unit", chosen["unit"]).withColumn(f"{name}_canonical", F.col(value) * chosen["factor"]).withColumn(f"{name}_choice", chosen)
    return out.drop("_ranked", "_best")


def unit_candidates(units: DataFrame) -> DataFrame:
    """(``form``, ``candidates``): by folded spelling every listed unit that it may mean, as STRUCT<unit, factor, dimension>.

    A spelling that several listed forms share once case, blanks and punctuation are left out has several candidates.
    """
    listed = units.select(form_key(F.col("surface_form")).alias("form"), F.struct(F.col("surface_form").alias("unit"), F.col("factor_to_canonical").alias("factor"), F.col("canonical_unit").alias("dimension")).alias("u"))
    return listed.where("form <> '' and u.factor > 0").groupBy("form").agg(F.sort_array(F.collect_set("u")).alias("candidates"))


def _meant(candidates: Column, text: Column) -> Column:
    """The candidates, or only the one that is spelt exactly as the text."""
    exact = F.filter(candidates, lambda u: u["unit"] == text)
    return F.when(F.size(exact) > 0, exact).otherwise(candidates)


def ordered_amounts(rows: DataFrame, units: DataFrame, key: str = "corpus_id", quantity: str = "quantity", unit: str = "unit", text: str = "description") -> DataFrame:
    """(``key``, ``amount``, ``surface_form``, ``canonical_unit``, ``factor``, ``canonical``, ``source``, ``unique_solution``) of rows whose amount and listed unit are given.

    The unit column and the unit behind the number are two readings of one amount, each with every
    listed unit it may mean: amount x behind = amount x column, in one dimension. The combination of
    least residual gives the unit; a silent column may mean whatever the other one means. Where no
    combination holds, or several of different factors do, the row is kept with ``unique_solution``
    false and no unit or canonical value. With both quantity and unit empty, the text's statement of a
    required quantity is read. Null, blank, unlisted and invalid values have no row.
    """
    base = rows.select(F.col(key).alias("_id"), F.col(quantity).alias("_q"), F.col(unit).alias("_u"), F.col(text).alias("_t"))
    silent = is_blank(F.col("_q")) & is_blank(F.col("_u"))
    said = F.coalesce(*[F.when(F.regexp_extract("_t", p, 1) != "", F.regexp_extract("_t", p, 1)) for p in (STATED_AFTER, STATED_BEFORE)])
    read = base.withColumn("_said", F.when(silent & F.col("_t").rlike(r"(?i)qty|quantity|req"), said)).withColumn("_src", F.coalesce("_said", "_q"))
    read = read.withColumn("amount", amount_of(F.col("_src"))).withColumn("_rest", rest_of(F.col("_src")))
    read = read.where(F.col("amount").isNotNull()).withColumn("_kb", form_key(F.col("_rest"))).withColumn("_kc", F.when(F.col("_said").isNull(), form_key(F.col("_u"))))
    forms = unit_candidates(units)
    side = lambda p: forms.select(F.col("form").alias(f"_k{p}"), F.col("candidates").alias(f"_f{p}"))
    known = read.join(side("b"), "_kb", "left").join(side("c"), "_kc", "left")
    known = known.where(((F.col("_rest") == "") | F.col("_fb").isNotNull()) & (F.col("_fb").isNotNull() | F.col("_fc").isNotNull()))
    known = known.withColumn("_mb", _meant(F.col("_fb"), F.col("_rest"))).withColumn("_mc", _meant(F.col("_fc"), F.trim("_u")))
    pair = known.withColumn("_cb", F.coalesce("_mb", "_mc")).withColumn("_cc", F.coalesce("_mc", "_mb")).withColumn("_v", F.when(F.col("amount") == 0, 1.0).otherwise(F.col("amount")))
    solved = solve_units(pair, [("behind", 1.0, "_v", "_cb"), ("column", -1.0, "_v", "_cc")], like=[("behind", "column")])
    unique = F.coalesce(F.col("unique_solution") & (F.col("residual") < 1e-6), F.lit(False))
    chosen = F.when(unique, F.col("behind_choice"))
    return solved.select(
        F.col("_id").alias(key), "amount", chosen["unit"].alias("surface_form"), chosen["dimension"].alias("canonical_unit"), chosen["factor"].alias("factor"),
        (F.col("amount") * chosen["factor"]).alias("canonical"),
        F.when(F.col("_said").isNotNull(), "text").when(F.col("_fb").isNotNull(), "quantity").otherwise("unit").alias("source"), unique.alias("unique_solution"),
    )


def converted_amounts(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(``corpus_id``, ``canonical_unit``, ``canonical_milli``) of amounts whose unit isn't the canonical one already."""
    found = ordered_amounts(rows, units).where("unique_solution and factor <> 1")
    # exact decimal product, so that no binary rounding decides a tie; amounts beyond its range keep the binary one
    exact = F.round(F.col("amount").try_cast("decimal(20,6)") * (F.col("factor") * 1000).try_cast("decimal(16,6)"), 0).try_cast("bigint")
    milli = F.coalesce(exact, F.round(F.col("amount") * F.col("factor") * 1000).try_cast("bigint"))
    return found.select("corpus_id", "canonical_unit", milli.alias("canonical_milli"))
