import pytest
from pyspark.sql import functions as F

from stocklore.operators import quality
from stocklore.sources import readers, writers
from stocklore.streaming import feeds


def test_csv_encodings_and_pointers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,text\n1,"größe, 2"" x"\n2,\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,text\n1,größe\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(readers.POINTER + b"\noid sha256:0\nsize 1\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'größe, 2" x'), ("2", None)]
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first().text == "größe"
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "c.csv"))
    kinds = {r.path.rsplit("/", 1)[1]: (r.is_pointer, r.content_type) for r in readers.manifest(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": (False, "text/csv"), "b.csv": (False, "text/csv"), "c.csv": (True, "text/csv")}


def test_encoding_is_of_the_whole_file_and_by_file(spark, tmp_path):
    folder = tmp_path / "a b+"
    folder.mkdir()
    (folder / "late 1.csv").write_bytes(("code,description\n" + "1,plain text of a row\n" * 60_000 + "2,größe\n").encode("cp1252"))
    (folder / "utf.csv").write_bytes("code,description\n3,größe 中\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "a*" / "late*")).where("code = '2'").first().description == "größe"
    rows = readers.read_csv(spark, str(tmp_path / "a*"))
    assert {(r.code, r.description) for r in rows.where("code > '1'").collect()} == {("2", "größe"), ("3", "größe 中")} and rows.count() == 60_002
    exported = readers.read_export(spark, str(tmp_path / "a*")).where("material_code > '1'").collect()
    assert {(r.material_code, r.description, r.source.rsplit("/", 1)[1]) for r in exported} == {("2", "größe", "late%201.csv"), ("3", "größe 中", "utf.csv")}


def test_exports_json_text(spark, tmp_path):
    (tmp_path / "e.csv").write_text("MATNR,material_description,unit,colour\n7,Valve,NOS,red\n8,,,\n")
    row = readers.read_export(spark, str(tmp_path / "e.csv")).orderBy("material_code").first()
    assert (row.material_code, row.description, row.uom, row.plant, row.metadata) == ("7", "Valve", "NOS", "", {"colour": "red"})
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nbroken\n')
    loose = readers.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int", strict=False).collect()
    assert [r._corrupt_record for r in loose] == [None, "broken"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "N12_doc.txt").write_text("one\n\nthree")
    assert [(r.nit_id, r.line_no, r.line) for r in readers.read_text_lines(spark, str(tmp_path / "t")).collect()] == [("N12", 1, "one"), ("N12", 2, ""), ("N12", 3, "three")]
    left = readers.unprocessed(spark.range(4), spark.range(2), "id")
    assert sorted(r.id for r in left.collect()) == [2, 3]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", None), (2, "a", "x")], "z int, b string, a string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x","b":"a","z":2}', '{"b":"b","z":1}']
    writers.write_csv(str(tmp_path / "c"), rows, rows.select("z").withColumn("new", F.lit("n")))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["z", "b", "a", "new"]
    stored = spark.createDataFrame([(1, "old"), (2, "keep")], "id int, v string")
    incoming = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (3, "new", 1), (None, "lost", 9)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in writers.upserted(stored, incoming, "id", "at").collect()) == [(1, "last"), (2, "keep"), (3, "new")]
    kids = writers.replaced_children(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, k string"), spark.createDataFrame([(1, "z")], "p int, k string"), "p")
    assert sorted((r.p, r.k) for r in kids.collect()) == [(1, "z"), (2, "c")]


def test_quality_bundle_and_index(spark, folder, tmp_path):
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    flags = quality.flagged(read("material_description_corpus"), read("unit_normalisation"))
    writers.write_quality_bundle(flags, str(tmp_path / "q"))
    clean, bad = (spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "q" / part)).count() for part in ("clean", "quarantine"))
    assert clean + bad == flags.count() and bad > 0
    docs = read("material_description_corpus").select("corpus_id", "description")
    writers.save_index(docs, "corpus_id", "description", str(tmp_path / "i"), "lexical-1")
    assert writers.load_index(spark, str(tmp_path / "i"), "lexical-1")[0].count() == docs.count()
    with pytest.raises(ValueError):
        writers.load_index(spark, str(tmp_path / "i"), "other")


def test_streams_match_batches(spark, folder, tmp_path):
    batch = spark.read.parquet(f"{folder}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = feeds.feed_stream(spark, str(tmp_path / "in"), batch.schema)
    got = []
    feeds.run_once(feeds.windowed_counts(stream, "ts", "event_type", lateness="10000 days"), lambda d, _: got.append(d.collect()), str(tmp_path / "c1"), "update")
    rows = {(r.window_start, r.event_type): r.events for part in got for r in part}
    assert rows == {(r.window_start, r.event_type): r.events for r in feeds.windowed_counts(batch, "ts", "event_type").collect()}
    seen = []
    feeds.run_once(feeds.first_arrivals(feeds.feed_stream(spark, str(tmp_path / "in"), batch.schema), "user_id", "ts", "10000 days"), lambda d, _: seen.append(d.count()), str(tmp_path / "c2"))
    assert sum(seen) == batch.select("user_id").distinct().count()


def test_running_verdicts(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/feedback_event.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    got = {}
    feeds.run_once(feeds.running_verdicts(feeds.feed_stream(spark, str(tmp_path / "in"), events.schema)), lambda d, _: got.update({r.entity_id: (r.accepted, r.rejected) for r in d.collect()}), str(tmp_path / "c"), "update")
    expected = events.where("entity_id is not null").groupBy("entity_id").agg(F.count_if("accepted").alias("y"), F.count_if(~F.col("accepted")).alias("n")).collect()
    assert got == {r.entity_id: (r.y, r.n) for r in expected}
