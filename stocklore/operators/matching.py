"""Comparing two material records: technical compatibility, pair features, scores, rationale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .identity import pair_id
from .normalize import convertible

# Attributes that must agree, by family; of these `standard` and `model` only make a soft mismatch.
IDENTITY = {
    "transformer": ("voltage", "rating", "frequency", "phase", "vector_group", "cooling_type", "winding_material"),
    "cable": ("voltage", "cores", "cross_section", "conductor_material", "insulation"),
    "valve": ("valve_type", "nominal_diameter", "pressure_class", "material_grade", "end_connection"),
    "pipe": ("nominal_diameter", "wall_thickness", "schedule", "material_grade"),
    "pump": ("rating", "material_grade"),
    "bearing": ("model", "material_grade"),
    "motor": ("rating", "voltage", "frequency", "phase"),
    "electrical_panel": ("voltage", "rating"),
    "flange_fitting": ("nominal_diameter", "pressure_class", "material_grade", "end_connection"),
    "instrumentation": ("model", "standard"),
}
SOFT = ("standard", "model")
NUMERIC = ("voltage", "rating", "nominal_diameter", "cross_section", "wall_thickness")
# Weights of the pair score and of the hybrid score.
PAIR_WEIGHTS = {"lexical": 0.30, "family": 0.10, "attributes": 0.25, "numeric": 0.15, "standard": 0.10, "dense": 0.10, "cross": 0.10}
HYBRID_WEIGHTS = {"dense": 0.35, "sparse": 0.25, "attribute": 0.30, "cross_encoder": 0.10}


def value_map(attributes: str) -> Column:
    """MAP from every attribute name of a record to its distinct ``value|unit`` keys, lower case, sorted; built once a record, looked up by name afterwards."""
    names = F.array_distinct(F.transform(attributes, lambda a: a["name"]))
    key = lambda a: F.lower(F.concat(a["text"], F.lit("|"), F.coalesce(a["unit"], F.lit(""))))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_sort(F.array_distinct(F.transform(F.filter(attributes, lambda a: a["name"] == n), key))))))


def _known(values: str, name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(values), name), F.array().cast("array<string>"))


def compatibility(left: str, right: str, family_left: str, family_right: str) -> Column:
    """STRUCT<class, conflicts, soft, unknown> of two records' value maps and families.

    HARD_CONFLICT over SOFT_MISMATCH over UNKNOWN over MATCH; a family that isn't known makes UNKNOWN.
    """
    fa, fb = F.col(family_left), F.col(family_right)
    fields = F.create_map(*[x for fam, names in IDENTITY.items() for x in (F.lit(fam), F.array(*map(F.lit, sorted(names))))])
    asked = F.when(fa == fb, F.coalesce(F.try_element_at(fields, fa), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))

    def seen(name: Column) -> Column:
        a, b = _known(left, name), _known(right, name)
        both = (F.size(a) > 0) & (F.size(b) > 0)
        return F.struct(name.alias("name"), (~both).alias("missing"), (both & ~F.arrays_overlap(a, b)).alias("conflict"))

    evidence = F.transform(asked, seen)
    names_where = lambda test: F.transform(F.filter(evidence, test), lambda e: e["name"])
    hard = names_where(lambda e: e["conflict"] & ~e["name"].isin(*SOFT))
    soft = names_where(lambda e: e["conflict"] & e["name"].isin(*SOFT))
    unknown = names_where(lambda e: e["missing"])
    known = (fa != "unknown") & (fb != "unknown")
    label = (
        F.when(known & (fa != fb), "HARD_CONFLICT").when(~known, "UNKNOWN").when(F.size(hard) > 0, "HARD_CONFLICT")
        .when(F.size(soft) > 0, "SOFT_MISMATCH").when(F.size(unknown) > 0, "UNKNOWN").otherwise("MATCH")
    )
    conflicts = F.when(known & (fa != fb), F.array(F.lit("family"))).otherwise(hard)
    return F.struct(label.alias("class"), conflicts.alias("conflicts"), soft.alias("soft"), F.when(known, unknown).otherwise(F.array(F.lit("family"))).alias("unknown"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two texts' token sets; 0 where both are empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def _numeric(left: str, right: str) -> Column:
    """Mean over shared numeric attributes of the best 1 / (1 + relative difference)."""
    bests = []
    for name in NUMERIC:
        a, b = _numbers(left, name), _numbers(right, name)
        bests.append(F.array_max(F.flatten(F.transform(a, _against(b)))))
    found = F.array_compact(F.array(*bests))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, v: s + v) / F.size(found)).otherwise(0.0)


def _numbers(side: str, name: str) -> Column:
    mine = F.filter(side, lambda a: (a["name"] == name) & a["number"].isNotNull())
    return F.transform(mine, lambda a: a["number"])


def _against(others: Column):
    """Closeness of one number to each of the others."""
    return lambda x: F.transform(others, lambda y: 1.0 / (1.0 + F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))))


def _stated_alike(name: str) -> Column:
    """1.0 or 0.0: whether both sides' first value is the same apart from case and outer blanks; null where a side states none."""
    first = lambda s: F.lower(F.trim(F.try_element_at(F.filter(F.col(s), lambda a: a["name"] == name), F.lit(1))["value"]))
    a, b = F.nullif(first("attributes_a"), F.lit("")), F.nullif(first("attributes_b"), F.lit(""))
    return (a == b).cast("double")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Adds the features of pairs that hold ``text_a/_b``, ``attributes_a/_b``, ``family_a/_b``; nulls count as empty."""
    mapped = pairs.withColumn("_va", value_map("attributes_a")).withColumn("_vb", value_map("attributes_b"))
    with_shared = mapped.withColumn("_shared", F.array_intersect(F.map_keys("_va"), F.map_keys("_vb")))
    agreed = F.size(F.filter("_shared", lambda n: _known("_va", n) == _known("_vb", n)))
    opposed = F.size(F.filter("_shared", lambda n: ~F.arrays_overlap(_known("_va", n), _known("_vb", n))))
    shared = F.greatest(F.size("_shared"), F.lit(1))
    units = lambda s: F.array_compact(F.transform(F.filter(F.col(s), lambda a: a["name"].isin("nominal_diameter", "cross_section")), lambda a: a["unit"]))
    uom = F.exists(units("attributes_a"), lambda x: F.exists(units("attributes_b"), lambda y: (x == y) | convertible(x, y)))
    number = lambda c: c.cast("double")
    out = with_shared.select(
        *pairs.columns, compatibility("_va", "_vb", "family_a", "family_b").alias("compatibility"), jaccard(F.col("text_a"), F.col("text_b")).alias("lexical_similarity"),
        number((F.col("family_a") != "unknown") & (F.col("family_a") == F.col("family_b"))).alias("family_agreement"),
        (agreed / shared).alias("attribute_agreement"), (opposed / shared).alias("attribute_conflicts"), number(uom).alias("uom_compatibility"),
        number(F.arrays_overlap(_known("_va", F.lit("standard")), _known("_vb", F.lit("standard")))).alias("standard_compatibility"), _numeric("attributes_a", "attributes_b").alias("numeric_proximity"),
        _stated_alike("hsn_sac").alias("hsn_compatibility"), _stated_alike("manufacturer").alias("manufacturer_compatibility"),
    )
    out = out.withColumn("technical_hard_conflicts", F.size("compatibility.conflicts"))
    return out.withColumn("standard_compatibility", F.coalesce("standard_compatibility", F.lit(0.0)))


def pair_score(features: DataFrame, dense: Column | None = None, cross: Column | None = None) -> DataFrame:
    """Adds ``score`` (0 on a hard conflict, else the weighted mean of the features given) and ``rationale``."""
    w = PAIR_WEIGHTS
    parts = [(F.col("lexical_similarity"), w["lexical"]), (F.col("family_agreement"), w["family"]), (F.col("attribute_agreement"), w["attributes"]), (F.col("numeric_proximity"), w["numeric"]), (F.col("standard_compatibility"), w["standard"])]
    total = F.lit(sum(x for _, x in parts))
    value = reduce(lambda s, p: s + p[0] * p[1], parts, F.lit(0.0))
    for extra, weight, low in ((dense, w["dense"], True), (cross, w["cross"], False)):
        if extra is not None:
            value = value + F.coalesce((F.greatest(extra, F.lit(0.0)) if low else extra) * weight, F.lit(0.0))
            total = total + F.when(extra.isNotNull(), weight).otherwise(0.0)
    label = F.col("compatibility.class")
    rationale = F.array_compact(F.array(
        F.concat(F.lit("compatibility "), label), F.concat(F.lit("lexical overlap "), F.format_number("lexical_similarity", 3)),
        F.when(F.size("compatibility.conflicts") > 0, F.concat(F.lit("differs in "), F.array_join("compatibility.conflicts", ", "))),
        F.when(F.size("compatibility.unknown") > 0, F.concat(F.lit("no evidence on "), F.array_join("compatibility.unknown", ", "))),
    ))
    return features.withColumn("score", F.when(label == "HARD_CONFLICT", 0.0).otherwise(F.round(value / total, 6))).withColumn("rationale", rationale)


def shared_terms(a: Column, b: Column, most: int = 8) -> Column:
    """The first shared words of two texts, sorted."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return F.slice(F.array_sort(F.array_intersect(words(a), words(b))), 1, most)


def hybrid_score(dense: Column, sparse: Column, attribute: Column, cross: Column) -> Column:
    """Weighted sum of four similarities, kept within 0 and 1; missing ones count 0."""
    w = HYBRID_WEIGHTS
    parts = ((dense, w["dense"]), (sparse, w["sparse"]), (attribute, w["attribute"]), (cross, w["cross_encoder"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda s, p: s + F.coalesce(p[0], F.lit(0.0)) * p[1], parts, F.lit(0.0))))


# From which score on a hybrid score is an equivalent, and from which on a person looks at it; the first lies beyond every score.
BANDS = (1.01, 0.0)


def score_band(score: Column, equivalent: float = BANDS[0], review: float = BANDS[1]) -> Column:
    """``Equivalent``, ``Human Review`` or ``Distinct`` of a score; null for null."""
    return F.when(score >= equivalent, "Equivalent").when(score >= review, "Human Review").when(score.isNotNull(), "Distinct")


def scored_pairs(pairs: DataFrame, records: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Scores of (``a``, ``b``) pairs over records with ``description``, ``attributes``, ``family``; pairs with an unknown side drop out, repeated pairs count once."""
    side = lambda s: records.select(F.col(key).alias(s), F.col("description").alias(f"text_{s}"), F.col("attributes").alias(f"attributes_{s}"), F.col("family").alias(f"family_{s}"))
    unordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    joined = unordered.join(side("a"), "a").join(side("b"), "b")
    scored = pair_score(pair_features(joined))
    return scored.select(pair_id(F.col("a"), F.col("b")).alias("pair_id"), "a", "b", F.col("compatibility.class").alias("compatibility"), "lexical_similarity", "family_agreement", "attribute_agreement", "attribute_conflicts", "uom_compatibility", "standard_compatibility", "numeric_proximity", "hsn_compatibility", "manufacturer_compatibility", "technical_hard_conflicts", "score", "rationale")


def members_of(pairs: DataFrame, records: DataFrame, key: str = "corpus_id") -> DataFrame:
    """The records that stand in a pair: nothing else needs to be read closely."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).where(F.col(key).isNotNull()).distinct()
    return records.join(ends, key, "left_semi")
