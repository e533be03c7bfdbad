"""Grouping listings that describe the same product.

1. Nouns of items, the values of variant attributes and their wordings are mined from
   trusted listings (those with a type hint) by the brand-model phrases they stand beside
   (``product_mining``); a seed vocabulary of the trade fills what a small table can't tell.
2. An Aho-Corasick automaton of that dictionary finds the phrases everywhere in the
   texts; the longest matches that don't overlap win. Model codes, grades and measures
   (converted to base units) are read beside them.
3. Listings with the same brand-model phrase are compared on the remaining variant
   attributes. Complete listings group by equal attributes; a listing that leaves one
   out, or whose noun or code is mistyped, joins the one product that agrees with it on
   every value both state.

The mined dictionary is bounded by its support share, so it may be broadcast; products
and listings meet in equi-joins on hashed keys after identical listings are combined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..session import spread
from .product_mining import mined_dictionary
from .product_parse import ListingParser, dictionary, seed_phrases

FIXED = ("kind", "model", "grade", "length", "pressure", "power", "mass", "volume", "voltage", "current", "cores")
STATED = 5  # a listing that leaves values out joins a product only with this many values in common, its kind, code and grade among them where stated
MAX_GRADES = 200_000
MARK = "\x01"  # between the values of a listing; no value holds it


def parsed(rows: DataFrame, key: str, text: str, grades: list[str], phrases: dict[str, tuple[str, str]], slots: tuple[str, ...]) -> DataFrame:
    """``_id`` and ``_s`` of every listing that names an item kind or a model beside a grade: the values of its ``slots``, empty where not stated, joined by ``MARK``."""
    context = rows.sparkSession.sparkContext.broadcast((grades, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = ListingParser(context.value[0], context.value[1])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            named, values = [], []
            for i, t in zip(ids, texts):
                s = parser.parse(t)
                if len(s) > 2 and ("kind" in s or ("model" in s and "grade" in s)):
                    named.append(i)
                    values.append(MARK.join([s.get(name, "") for name in slots]))
            yield pa.RecordBatch.from_arrays([pa.array(named, batch.column(0).type), pa.array(values, pa.string())], ["_id", "_s"])

    source = rows.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where("_t is not null")
    return spread(source).mapInArrow(run, source.select("_id").schema.simpleString()[7:-1].replace(":", " ") + ", _s string")


def _slice(first: int, last: int) -> Column:
    """The values of a listing's slots ``first`` up to ``last``, as they are joined."""
    return F.substring_index(F.substring_index("_s", MARK, last), MARK, first - last)


def _stated() -> Column:
    """Which values a listing states: its values with each one's text left out."""
    return F.regexp_replace("_s", f"[^{MARK}]+", "1")


def _anchors() -> Column:
    """Keys by which listings that lack a value, or mistype one, can meet their product."""
    kind, model, grade = (_slice(i, i + 1) != "" for i in range(3))
    made = (
        F.when(model & grade, F.xxhash64(F.lit("mg"), _slice(1, 3))),
        F.when(kind & model, F.xxhash64(F.lit("km"), _slice(0, 2))),
        F.when(kind & grade, F.xxhash64(F.lit("kg"), _slice(0, 1), _slice(2, len(FIXED)))),
    )
    return F.array_compact(F.array(*made))


def _common(a: Column, b: Column, n: int) -> Column:
    """How many of ``n`` values two listings state alike; below 0 where one contradicts."""
    alike = F.zip_with(F.split(a, MARK), F.split(b, MARK), lambda x, y: F.when((x == "") | (y == ""), 0).when(x == y, 1).otherwise(-n - 1))
    return F.aggregate(alike, F.lit(0), lambda s, x: s + x)


def product_groups(rows: DataFrame, grades: DataFrame, key: str = "corpus_id", text: str = "description", hint: str = "item_type_hint", seed: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(``first_id``, ``listing_id``) for each listing but the smallest of its product.

    ``key`` must be unique. Null, blank and administrative texts are no listings; a listing
    with a value left out that two products could explain stays by itself. ``seed``: a vocabulary
    (phrase -> slot, value) that fills what can't be mined from a small table; by default the trade's, ``{}`` for none.
    """
    tokens = [r.t for r in grades.select(F.col("grade_token").alias("t")).where("t is not null").distinct().limit(MAX_GRADES + 1).collect()]
    if len(tokens) > MAX_GRADES:
        raise ValueError("the grade list is too long to be held by every worker")
    phrases = dictionary(mined_dictionary(rows, text, hint), seed_phrases() if seed is None else seed)
    optional = tuple(sorted({slot for slot, _ in phrases.values()} - {"kind"}))
    slots = FIXED + optional
    listed = durable(parsed(rows, key, text, tokens, phrases, slots))
    # equal listings are combined under a hash, which sorts faster than the values; the values keep it exact
    hashed = (F.xxhash64("_s").alias("_g"), F.xxhash64(F.lit(1), "_s").alias("_h"))
    same = durable(listed.select("_id", "_s", hashed[0]).groupBy("_g", "_s").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    named = (_slice(0, 1) != "") & (_slice(1, 2) != "")  # kind and model are stated
    # the usual set of stated attributes of each kind: one row a kind
    marked = same.select("_g", "_s", "_n", _slice(0, 1).alias("_kind"), _stated().alias("_stated"))
    usual = marked.where(named).groupBy("_kind", "_stated").agg(F.sum("_n").alias("_n")).groupBy("_kind").agg(F.max_by("_stated", F.struct("_n", "_stated")).alias("_usual"))
    marked = durable(marked.join(F.broadcast(usual), "_kind", "left").select("_g", "_s", F.coalesce(F.col("_stated") == F.col("_usual"), F.lit(False)).alias("_full")))
    full, part = marked.where("_full"), marked.where("not _full")
    left = part.select("_g", "_s", F.explode(_anchors()).alias("_a"))
    right = full.select(F.col("_g").alias("g2"), F.col("_s").alias("s2"), F.explode(_anchors()).alias("_a"))
    met = left.join(right, "_a").where(_common(F.col("_s"), F.col("s2"), len(slots)) >= STATED).select("_g", "g2").distinct()
    joined = durable(met.groupBy("_g").agg(F.count("*").alias("_k"), F.min("g2").alias("_to")).where("_k = 1").select("_g", "_to"))
    # listings without a complete product meet each other: same item, code, grade and measures, no optional value contradicted
    alone = part.join(joined, "_g", "left_anti").where(named).select("_g", F.xxhash64(_slice(0, len(FIXED))).alias("_c"), *[F.nullif(_slice(i, i + 1), F.lit("")).alias(s) for i, s in enumerate(slots) if s in optional])
    firm = F.lit(True)
    for s in optional:
        firm = firm & F.coalesce(F.min(s) == F.max(s), F.lit(True))
    met_alone = alone.groupBy("_c").agg(F.min("_g").alias("_to"), firm.alias("_firm"), F.count("*").alias("_k")).where("_firm and _k > 1")
    moved = joined.unionByName(alone.select("_g", "_c").join(met_alone, "_c").select("_g", "_to"))
    heads = same.select("_g", hashed[1], "_first").join(moved, "_g", "left").withColumn("_p", F.coalesce("_to", "_g"))
    first = heads.groupBy("_p").agg(F.min("_first").alias("first_id"))
    found = heads.join(first, "_p").select("_g", "_h", "first_id")
    return listed.select("_id", *hashed).join(found, ["_g", "_h"]).where("_id <> first_id").select("first_id", F.col("_id").alias("listing_id"))
