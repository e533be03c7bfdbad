"""Weak labels between records: equal texts across organizations, and conflicting neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from .attributes import values_of
from .durable import durable, release
from .identity import pair_id
from .matching import IDENTITY, compatibility, value_map
from .numbering import numbered

# Confidence of the two kinds of labels, and neighbours per record and value.
EXACT_CONFIDENCE, CONFLICT_CONFIDENCE = 0.9, 0.65
NEIGHBOURS = 8
ANCHORS = {
    "transformer": ("voltage", "rating", "frequency", "phase", "vector_group"),
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


def exact_classes(records: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Membership form of the exact label: ``key``, ``class_id`` (smallest id), ``representative`` of its organization, for texts that at least two organizations have."""
    org = folded(F.coalesce(F.col("organization"), F.lit("")))
    base = records.select(F.col(key).alias("id"), F.nullif(folded(F.col("description")), F.lit("")).alias("t"), org.alias("o")).where("t is not null")
    base = base.withColumn("h", F.sha2("t", 256))
    per = base.groupBy("h", "o").agg(F.min("id").alias("representative"))
    classes = per.groupBy("h").agg(F.min("representative").alias("class_id"), F.count("*").alias("orgs")).where("orgs > 1").drop("orgs")
    return base.join(per.join(classes, "h"), ["h", "o"]).select(F.col("id").alias(key), "class_id", "representative")


def exact_labels(records: DataFrame, key: str = "corpus_id") -> DataFrame:
    """EXACT labels between the representatives of a text at different organizations (copies within one organization stay in ``exact_classes``)."""
    reps = exact_classes(records, key).select("class_id", F.col("representative").alias("r")).distinct()
    others = reps.where("r <> class_id").select(F.col("class_id").alias("a"), F.col("r").alias("b"))
    return others.select(pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.least("a", "b").alias("material_a"), F.greatest("a", "b").alias("material_b"), F.lit("EXACT").alias("relation"), F.lit(EXACT_CONFIDENCE).alias("confidence"))


def _conflicts(records: DataFrame, key: str, neighbours: int) -> DataFrame:
    """(``a``, ``b``, ``reasons``) of records in hard conflict, every unordered pair once."""
    fields = F.create_map(*[x for f, names in IDENTITY.items() for x in (F.lit(f), F.array(*map(F.lit, names)))])
    anchors = F.create_map(*[x for f, names in ANCHORS.items() for x in (F.lit(f), F.array(*map(F.lit, names)))])
    said = F.filter("attributes", lambda a: F.array_contains(fields[F.col("family")], a["name"]))
    slim = records.where("family <> 'unknown'").select(F.col(key).alias("id"), "family", F.array_sort(F.array_distinct(F.transform(said, lambda a: F.struct(a["name"].alias("name"), a["text"].alias("text"), a["unit"].alias("unit"))))).alias("said"))
    # records that say the same are one kind and conflict alike: pairs are judged between kinds, and joined back to every record
    members = durable(slim.where("size(said) > 0").withColumn("kind", F.md5(F.to_json(F.struct("family", "said")))))
    kinds = durable(members.groupBy("kind").agg(F.first("family").alias("family"), F.first("said").alias("said"), F.min("id").alias("id")))
    held = kinds.withColumn("anchor", F.explode(anchors[F.col("family")])).withColumn("vs", values_of("said", F.col("anchor")))
    values = durable(held.select("kind", "id", "family", "anchor", F.size("vs").alias("n"), F.explode("vs").alias("v")))
    # a record with no other value stands for a value where there is one, as it conflicts with all others
    heads = values.groupBy("family", "anchor", "v").agg(F.min(F.struct("n", "id", "kind")).alias("h"))
    sizes = heads.groupBy("family", "anchor").agg(F.count("*").alias("total")).where("total > 1")
    placed = numbered(heads, ["v"], "at", ("family", "anchor")).withColumn("at", F.col("at") - 1).join(sizes, ["family", "anchor"])
    placed = durable(placed)
    step = F.explode(F.sequence(F.lit(1), F.least(F.lit(neighbours), F.col("total") - 1).cast("int")))
    ahead = placed.withColumn("_step", step).select("family", "anchor", "v", ((F.col("at") + F.col("_step")) % F.col("total")).alias("at"))
    following = ahead.join(placed.select("family", "anchor", "at", F.col("h.kind").alias("other")), ["family", "anchor", "at"])
    meets = values.join(following, ["family", "anchor", "v"]).where("kind <> other").select("kind", "other").distinct()
    side = lambda k, s: kinds.select(F.col("kind").alias(k), F.col("family").alias(f"family_{s}"), value_map("said").alias(f"said_{s}"), F.col("id").alias(f"first_{s}"))
    judged = meets.join(side("kind", "a"), "kind").join(side("other", "b"), "other").withColumn("c", compatibility("said_a", "said_b", "family_a", "family_b"))
    hard = durable(judged.where("c.class = 'HARD_CONFLICT'").select("kind", "other", "first_a", F.col("first_b").alias("b"), F.array_join("c.conflicts", ",").alias("reasons")))
    # the first of a kind stands for it: where two kinds meet both ways, their firsts would pair twice
    both = F.count("*").over(Window.partitionBy(F.least("kind", "other"), F.greatest("kind", "other"))) > 1
    hard = hard.withColumn("again", both & (F.col("first_a") > F.col("b")))
    for done in (kinds, values, placed):
        release(done)
    pairs = members.select("kind", "id").join(hard, "kind").where(~(F.col("again") & (F.col("id") == F.col("first_a"))))
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "reasons")


def _not_equivalent(pairs: DataFrame) -> DataFrame:
    return pairs.select(pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.col("a").alias("material_a"), F.col("b").alias("material_b"), F.lit("NOT_EQUIVALENT").alias("relation"), F.lit(CONFLICT_CONFIDENCE).alias("confidence"), "reasons")


def conflict_labels(records: DataFrame, key: str = "corpus_id", neighbours: int = NEIGHBOURS) -> DataFrame:
    """NOT_EQUIVALENT labels: to each record, for each value it states of an identity attribute, those of the next ``neighbours`` values in its family that conflict with it.

    Values are in one order within family and attribute (after the last comes the first), and each is stood for by one record
    (of those that state the fewest values of the attribute the smallest id), so work is proportional to the records, whatever a family's size.
    """
    return _not_equivalent(_conflicts(records, key, neighbours))


def weak_labels(records: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Both kinds; where a pair has both, EXACT stands. What extraction made of the records is written once."""
    held = durable(records.select(key, "description", "organization", "family", F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), a["text"].alias("text"), a["unit"].alias("unit"))).alias("attributes")))
    exact = exact_labels(held, key).withColumn("reasons", F.lit("exact_text,cross_organization"))
    known = exact.select(F.col("material_a").alias("a"), F.col("material_b").alias("b"))
    return exact.unionByName(_not_equivalent(_conflicts(held, key, NEIGHBOURS).join(known, ["a", "b"], "left_anti")))


def hard_negatives(labels: DataFrame) -> DataFrame:
    """The weak negatives."""
    return labels.where("relation = 'NOT_EQUIVALENT'")


def feedback_pairs(events: DataFrame) -> DataFrame:
    """Contrastive pairs of feedback events: ``a``, ``b``, ``label`` 1 or 0; events with a null side or verdict are left out."""
    return events.where("material_a is not null and material_b is not null and accepted is not null").select(F.col("material_a").alias("a"), F.col("material_b").alias("b"), F.col("accepted").cast("int").alias("label"))


def shadow_evaluation(events: DataFrame, bar: float = 0.8) -> DataFrame:
    """One row: verdicts, accepted ones, their share (1.0 without verdicts), and whether the share reaches the bar."""
    one = events.agg(F.count("accepted").alias("total"), F.count_if(F.col("accepted")).alias("positives"))
    quality = F.coalesce(F.try_divide(F.col("positives").cast("double"), F.col("total")), F.lit(1.0))
    return one.select("total", "positives", quality.alias("quality"), ((F.col("total") >= 1) & (quality >= bar)).alias("promote"))
