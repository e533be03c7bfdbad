import math
import random

from pyspark.sql import functions as F

from stocklore.llm.mixture import _capped_mean, mixed_sizes, mixture, plan, poisson_inverse, rate_for, shares


def test_poisson_numbers(spark):
    df = spark.range(20_000).withColumn("u", (F.col("id") + 0.5) / 20_000)
    for lam, cap in ((0.3, 4), (1.7, 3), (0.9, 1)):
        got = df.select(F.avg(poisson_inverse(F.col("u"), F.lit(lam), F.lit(cap))).alias("m"), F.max(poisson_inverse(F.col("u"), F.lit(lam), F.lit(cap))).alias("x")).first()
        assert math.isclose(got.m, _capped_mean(lam, cap), abs_tol=1e-3) and got.x <= cap
    assert math.isclose(_capped_mean(rate_for(0.7, 2), 2), 0.7, abs_tol=1e-9)


def test_shares_and_caps(spark):
    rnd = random.Random(5)
    rows = [(i, "abc"[min(2, int(rnd.expovariate(1.2)))], f"t{i}", rnd.randrange(1, 400)) for i in range(3000)] + [(9001, None, "x", 5), (9002, "a", None, 0), (9003, "d", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens int").withColumn("rate", F.lit(9)).withColumn("cap", F.lit(9))
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 3), ("e", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture(docs, docs, weights).cache()
    for r in shares(mixed, weights).collect():
        assert abs(r.reached_share - r.target_share) < 0.01 and r.most_repeats <= r.max_repeats
    seen = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d")).where("n <> d")
    assert seen.count() == 0 and mixed.where("source = 'd' or source is null").count() == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixture(docs, docs, weights).collect()))
    keys = [r.order_key for r in mixed.collect()]
    assert keys == sorted(keys)
    assert mixture(docs.limit(0), docs.limit(0), weights).count() == 0 and mixture(docs, docs, weights.limit(0)).count() == 0


def test_every_share_is_within_one_document(spark):
    rnd = random.Random(8)
    rows = [(i, "abcdef"[min(5, int(rnd.expovariate(0.9)))], rnd.choice([3, 40, 40, 700, 9000])) for i in range(4000)] + [(9000 + i, "few", 50 + i) for i in range(5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").withColumn("n", F.lit(3)).withColumn("_off", F.lit(3))
    weights = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 4), ("c", 0.2, 3), ("d", 0.2, 9), ("e", 0.0999, 9), ("few", 0.0001, 3)], "source string, target_share double, max_repeats int")
    aim = plan(sized.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")), weights, 0.6).set_index("source")
    for r in shares(mixed_sizes(sized, weights), weights).collect():
        longest = max(n for _, s, n in rows if s == r.source)
        assert abs(r.tokens - aim.wanted[r.source]) <= longest and r.most_repeats <= r.max_repeats, r


def test_limits_where_a_listed_source_has_no_documents(spark, tmp_path, monkeypatch):
    from stocklore.llm import mixture as module
    from stocklore.llm.queries import p9_limits

    docs = [(i, "ab"[i % 2], "some words " * (5 + i % 7)) for i in range(400)] + [(900, "unrepeated", "words"), (901, "blank", "")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.3, 2), ("b", 0.2, 2), ("none", 0.2, 2), ("blank", 0.2, 2), ("unrepeated", 0.1, 0)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_weights.parquet")
    assert {tuple(r) for r in p9_limits(spark, str(tmp_path)).collect()} == {(s, True, True) for s in ("a", "b", "none", "blank", "unrepeated")}
    whole = module.mixed_sizes
    monkeypatch.setattr(module, "mixed_sizes", lambda *args: whole(*args).where("source = 'a' or doc_id % 3 = 0"))  # two thirds of a source left out
    assert {r.source: r.share_kept for r in p9_limits(spark, str(tmp_path)).collect()} == {"a": False, "b": False, "none": True, "blank": True, "unrepeated": True}
