from pyspark.sql import functions as F

from stocklore.llm.canonical_values import MARGIN, THRESHOLD, Index, decided, edits, map_values, mapped_rows, unmatched_report

UNITS = ["NOS", "EACH", "GRAM", "METRE", "MM", "M", "SQ.FT", "CUBIC METRE", "MILLIMETRE", "MILLILITRE", "ROLL", "YARD", "POUND"]


def test_closest_entry():
    index = Index(UNITS)
    best = lambda v: decided(v, index.candidates(v, THRESHOLD, MARGIN), MARGIN)
    for value, entry in {"n.o.s.": "NOS", " (metre) ": "METRE", "per POUND": "POUND", "5QFT": "SQ.FT", "RO1L": "ROLL", "cubc metre": "CUBIC METRE", "MILLIMETER": "MILLIMETRE", "YAED": "YARD", "gramm": "GRAM", "mm.": "MM"}.items():
        assert best(value)[0] == entry, value
    for value in ("TRUCKLOAD", "as per boq", "??????", "-", "unknown", "x" * 10_000):
        assert best(value)[0] is None, value[:20]
    assert best("roll / yard")[::2] == (None, "ambiguous") and best("nos.")[2] == "exact"
    assert best("per M")[0] == "M" and best("M of any make")[0] is None
    assert edits("ABCD", "ACBD", 3) == 1 and edits("O1", "01", 3) == 0.5 and edits("abc", "xyzuvw", 2) == 3


def test_rows_and_blocks(spark):
    entries = spark.createDataFrame([(u,) for u in UNITS] + [(None,)], "entry string")
    rows = spark.createDataFrame([("1", "NOS"), ("2", "nos"), ("3", None), ("4", ""), ("5", " "), ("6", "TRUCKLOAD"), ("7", "GRAMM"), ("8", "GRAMM")], "id string, v string").withColumn("entry_id", F.lit("clash")).withColumn("value", F.lit("clash"))
    got = {r.entry_id: r.reference_entry for r in mapped_rows(rows, "id", "v", entries, "entry").collect()}
    assert got == {"2": "NOS", "5": "-", "6": "-", "7": "GRAM", "8": "GRAM"}
    whole = {r.value: r.reference_entry for r in map_values(rows, "v", entries, "entry").collect()}
    blocks = {r.value: r.reference_entry for r in map_values(rows, "v", entries, "entry", block=4).collect()}
    assert whole == blocks and whole["TRUCKLOAD"] is None
    assert mapped_rows(rows.limit(0), "id", "v", entries, "entry").count() == 0
    assert {r.reference_entry for r in mapped_rows(rows, "id", "v", entries.limit(0), "entry").collect()} == {"-"}
    report = {(r.value, r.how): r.rows for r in unmatched_report(mapped_rows(rows, "id", "v", entries, "entry")).collect()}
    assert report == {(" ", "unmatched"): 1, ("TRUCKLOAD", "unmatched"): 1}


def test_blocks_score_as_the_whole_list(spark):
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choices("ABCDEFGH1230", k=rnd.randrange(2, 9))) for _ in range(300)]
    typed = [w[:k] + rnd.choice("ABX9") + w[k + 1 :] for w in words for k in (len(w) // 2,)] + [f"{w} only" for w in words[:50]]
    entries, rows = spark.createDataFrame([(w,) for w in words], "entry string"), spark.createDataFrame([(t,) for t in typed], "v string")
    plain = lambda df: sorted((r.value, r.reference_entry, r.how, round(r.score, 6)) for r in df.collect())
    assert plain(map_values(rows, "v", entries, "entry")) == plain(map_values(rows, "v", entries, "entry", block=37))
