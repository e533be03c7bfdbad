"""Records, unions, lookups, rules, gold guards and numbers in order, on small fixtures with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from stocklore.operators import evaluation, matching, records
from stocklore.operators.numbering import numbered


def test_material_record(spark):
    rows = spark.createDataFrame([("M1", " Org ", None, "", "T1", " gate valve ", "1,200", "NOS", "doc.csv", "red", "7"), ("M2", None, "sys", "ref", "", None, "nan", None, None, None, "0"), (None,) * 11],
                                 "corpus_id string, organization string, source_system string, tender_reference string, tender_id string, item_text string, quantity string, uom string, document_url string, colour string, page string")
    one, two, none = records.material_records(rows, F.col("document_url"), F.lit("abc")).collect()
    assert (one.material_code, one.source_organization, one.source_system, one.source_record_id, one.raw_description, one.quantity, one.unit, one.source_page) == ("M1", "Org", "unknown", "T1", "gate valve", 1200.0, "NOS", 7)
    assert one.metadata == {"ingest_artifact_path": "doc.csv", "ingest_artifact_hash": "abc", "colour": "red"} and one.source_hash == "abc"
    assert (two.source_record_id, two.quantity, two.source_page, two.source_system, two.raw_description) == ("ref", None, None, "sys", "")
    assert none.material_code == "" and none.quantity is None
    assert records.material_records(rows.limit(0)).count() == 0


def test_union_of_differing_inputs(spark):
    a = spark.createDataFrame([("gate  valve", 1), ("short", 2), (None, 3), ("gate valve", 4)], "text string, n int")
    b = spark.createDataFrame([("Supply of ga... gate valve DN 50", "o")], "title string, org string")
    first = records.projected(a, {"description": "text", "organization": F.lit("A"), "tender_id": F.col("n"), "description_kind": F.lit("k")})
    second = records.projected(b, {"description": "title", "organization": "org"})
    got = sorted((r.organization, r.description, r.tender_id, r.item_type_hint) for r in records.corpus_union(first, second, first).collect())
    assert got == [("A", "gate valve", "1", "gate valve"), ("o", "gate valve DN 50", "", "gate valve")]
    assert {(r.k, r.v, r.w) for r in records.with_stored(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b", 1), (2, "c", 2)], "k int, v string, w int"), "k").collect()} == {(1, "a", None), (2, "c", 2)}
    assert records.looked_up(a, "n").count() == 0 and records.looked_up(a, "n", 1, 9).count() == 1
    assert records.hits_with_records(spark.createDataFrame([("q", 1, 1), ("q", 9, 2)], "query string, doc int, rank int"), a, "n", "text").collect() == [(1, "q", 1, "gate  valve")]


def test_rules_and_text_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 1), (None, 1), ("b", None)], "k string, v int")
    assert {tuple(r) for r in records.violations(rows, ("k",), ("k", "v")).collect()} == {("unique", "k", 2), ("required", "k", 2), ("required", "v", 1)}
    assert records.violations(rows.limit(0), ("k",), ("v",)).count() == 0
    one = spark.createDataFrame([(" | (cid:12)पाइप Gate ’x’ :-", "Tender No. (2024) / Ref", "[a] b [ c ] [d", None)], "a string, b string, c string, n string")
    got = one.select(records.item_text(F.col("a")).alias("a"), records.snake_case(F.col("b")).alias("b"), records.file_slug(F.col("b"), 9).alias("f"), records.bracketed(F.col("c")).alias("c"), *[f(F.col("n")).alias(f"n{i}") for i, f in enumerate((records.item_text, records.snake_case, records.file_slug, records.bracketed))]).first()
    assert tuple(got) == ("Gate 'x'", "tender_no_2024_ref", "Tender_No", ["a", "c"], "", "", "", [])
    assert [tuple(r) for r in records.spend(rows, "k", "v").orderBy(F.col("k").asc_nulls_first()).collect()] == [(None, 2, 2.0), ("a", 3, 3.0), ("b", 1, 0.0)]


def test_only_expert_labels_judge_and_calibrate(spark):
    rows = spark.createDataFrame([(i % 2, (i % 10) / 10, f"g{i % 7}", "expert_gold") for i in range(140)], "label int, score double, g string, label_source string")
    found = evaluation.evaluated(rows, "label", "score", "g").first()
    assert found.training_rows + found.test_rows == 140 and found.tp + found.fp + found.fn + found.tn == found.test_rows
    assert 0 <= evaluation.calibrated(rows, "label", "score", "platt", "g").parameters["intercept"] + 10
    for bad in (rows.unionByName(rows.limit(1).withColumn("label_source", F.lit("weak_rule"))), rows.unionByName(rows.limit(1).withColumn("label_source", F.lit(None).cast("string"))), rows.withColumn("g", F.lit(" "))):
        with pytest.raises(ValueError):
            evaluation.evaluated(bad, "label", "score", "g")
    with pytest.raises(ValueError):
        evaluation.evaluated(rows.withColumn("g", F.lit("one")), "label", "score", "g")
    with pytest.raises(ValueError):
        evaluation.calibrated(rows.withColumn("g", F.lit("one")), "label", "score", "platt", "g")


def test_isotonic_steps(spark):
    fitted = evaluation.Calibrator("isotonic", {"boundaries": [0.2, 0.4, 0.8], "predictions": [0.1, 0.5, 0.9]})
    got = [r.p for r in spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.6,), (1.0,), (None,)], "s double").select(fitted.apply(F.col("s")).alias("p")).collect()]
    assert [None if p is None or p != p else round(p, 9) for p in got] == [0.1, 0.1, 0.3, 0.7, 0.9, None]


def test_numbers_within_groups_of_any_size(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(10**6), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o int, i int").repartition(7).withColumn("_first", F.lit(1)).withColumn("_g0", F.lit(2)).drop("_first", "_g0")
    got = {r.i: r.n for r in numbered(frame, ["o", "i"], "n", ("g",)).collect()}
    for g in ("a", "b", None):
        mine = sorted((o, i) for x, o, i in rows if x == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    assert sorted(r.n for r in numbered(frame, ["o", "i"], "n").collect()) == list(range(1, 3001))
    assert numbered(frame.limit(0), ["o"], "n", ("g",)).count() == 0


def test_stated_makers_and_codes(spark):
    from stocklore.operators import attributes as att

    rows = spark.createDataFrame([("1", "pump make: Alvora, HSN 8413"), ("2", "pump, manufacturer: ALVORA; HSN 8414"), ("3", "pump")], "corpus_id string, description string")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("9", "1")], "a string, b string")
    records_ = att.with_attributes(matching.members_of(pairs, rows))
    got = {(r.a, r.b): (r.hsn_compatibility, r.manufacturer_compatibility, r.technical_hard_conflicts) for r in matching.scored_pairs(pairs, records_).collect()}
    assert got == {("1", "2"): (0.0, 1.0, 0), ("1", "3"): (None, None, 0)}
    band = spark.createDataFrame([(1.0,), (0.0,), (-0.1,), (None,)], "s double").select(matching.score_band(F.col("s")).alias("b")).collect()
    assert [r.b for r in band] == ["Human Review", "Human Review", "Distinct", None]
