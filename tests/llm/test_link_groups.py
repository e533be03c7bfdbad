import random

from pyspark.sql import functions as F

from stocklore.llm.link_groups import consolidate, material_groups


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_against_union_find(spark):
    rnd = random.Random(7)
    ids = [f"M{i:05d}" for i in range(400)]
    chain = list(zip(ids[:120], ids[1:121]))  # one long path
    star = [("M00399", x) for x in ids[130:230]]  # a hub that a third of all pairs touch
    odd = [(None, "M00001"), ("M00002", None), ("M00005", "M00005")] + [("M00007", "M00300")] * 5
    loose = [(rnd.choice(ids[230:390]), rnd.choice(ids[230:390])) for _ in range(60)]
    pairs = chain + star + odd + loose
    rnd.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("node", F.lit("clash")).withColumn("label", F.lit("clash"))
    assert {r.node: r.label for r in consolidate(df, "a", "b").collect()} == union_find(pairs)


def test_no_pairs(spark):
    assert consolidate(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_spelling_and_verdicts(spark):
    events = spark.createDataFrame([(" m00002\t", "M00001", True), ("M00002", "m00003 ", True), ("M00003", "M00004", False), ("M00004", "M00005", None), ("M00006", "m00006", True), (None, "M00001", True), ("x9", "M00009", True)], "material_a string, material_b string, accepted boolean")
    corpus = spark.createDataFrame([(f"M0000{i}",) for i in range(1, 10)], "corpus_id string")
    got = {(r.group_id, r.material_id) for r in material_groups(events, corpus).collect()}
    assert got == {("M00001", "M00001"), ("M00001", "M00002"), ("M00001", "M00003"), ("M00009", "M00009"), ("M00009", "X9")}
