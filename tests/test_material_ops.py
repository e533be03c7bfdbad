"""Literals and brute force for the operators that SQL can't express."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stocklore.operators import attributes as att
from stocklore.operators import audit, canonical_codes, corpus, documents_extract, evaluation, identity, lineage, matching, normalize, quality, retrieval, weak_labels


def texts(spark, *rows):
    return spark.createDataFrame([(f"M{i:03d}", "Org A", t) for i, t in enumerate(rows, 1)], "corpus_id string, organization string, description string")


def test_attribute_literals():
    found = {a["name"]: a for a in att.attributes_in("11 kV transformer with IS 1239 grade A106, 240 mm² cu, 4\"CS 300#RF")}
    assert (found["voltage"]["number"], found["voltage"]["unit"], found["voltage"]["start"], found["voltage"]["end"]) == (11.0, "KV", 0, 5)
    assert found["standard"]["text"] == "IS 1239" and "material_grade" in found
    assert found["cross_section"]["number"] == 240.0 and found["cross_section"]["unit"] == "MM2"
    assert found["nominal_diameter"]["unit"] == '"' and found["pressure_class"]["text"] == "300#"
    assert [a["number"] for a in att.attributes_in("415 V motor, 2 MW")] == [0.415, 2000.0]
    assert att.attributes_in(None) == [] and att.attributes_in("") == []


def test_family_order_and_flat_view(spark):
    rows = att.flat_view(att.with_attributes(texts(spark, "motor for valve", "500 KVA transformer 11 KV", None, "5 hp pump, 2 nos")))
    got = {r.corpus_id: r for r in rows.collect()}
    assert [got[k].family for k in sorted(got)] == ["valve", "transformer", "unknown", "pump"]
    assert got["M002"].voltage_kv == 11.0 and got["M002"].rating_kva == 500.0 and got["M004"].rating_kva is None and got["M004"].uom == "NOS"
    assert att.flattened(rows, "corpus_id").where("material_id = 'M002'").count() == 2


def test_compatibility_classes(spark):
    records = att.with_attributes(texts(spark, "11 kV transformer", "33 kV transformer", "miscellaneous item", "11 kv panel 500 kva", "panel 500 KVA, 11KV", "gauge model X12, IS 10", "gauge model X13, IS 10", "valve 50 mm"))
    pairs = spark.createDataFrame([("M001", "M002"), ("M003", "M001"), ("M004", "M005"), ("M006", "M007"), ("M001", "M008"), ("M002", "M001"), ("M001", "M001"), (None, "M001")], "a string, b string")
    got = {(r.a, r.b): r for r in matching.scored_pairs(pairs, records).collect()}
    label = {k: r.compatibility for k, r in got.items()}
    assert label == {("M001", "M002"): "HARD_CONFLICT", ("M001", "M003"): "UNKNOWN", ("M004", "M005"): "MATCH", ("M006", "M007"): "SOFT_MISMATCH", ("M001", "M008"): "HARD_CONFLICT"}
    assert got["M001", "M002"].score == 0.0 and got["M004", "M005"].score == round((0.5 * 0.30 + 0.10 + 0.25 + 0.15) / 0.9, 6)
    assert got["M004", "M005"].attribute_agreement == 1.0 and got["M004", "M005"].numeric_proximity == 1.0


def test_hybrid_score_and_shared_terms(spark):
    one = spark.range(1).select(matching.hybrid_score(F.lit(0.95), F.lit(0.80), F.lit(0.90), F.lit(0.75)).alias("s"), matching.shared_terms(F.lit("Gate valve 50"), F.lit("valve GATE")).alias("t")).first()
    assert math.isclose(one.s, 0.8775) and one.t == ["gate", "valve"]


def test_codes_do_not_depend_on_order(spark):
    records = att.with_attributes(texts(spark, "500 KVA transformer 11 KV", "11kV 500kva transformer", "transformer", "misc", "", None))
    got = {r.corpus_id: r for r in canonical_codes.canonical_codes(records).collect()}
    assert got["M001"].code == got["M002"].code and got["M001"].code.startswith("NMC-IND-TRF-")
    assert got["M001"].signature == json.dumps({"attributes": {"rating": [{"unit": "KVA", "value": "500.0"}], "voltage": [{"unit": "KV", "value": "11.0"}]}, "family": "transformer"}, sort_keys=True, separators=(",", ":"))
    assert got["M001"].canonical_description == "TRANSFORMER | VOLTAGE 11.0 KV | RATING 500.0 KVA"
    assert [got[f"M00{i}"].status for i in range(3, 7)] == ["no_identity_attributes", "unknown_family", "no_description", "no_description"]
    assert canonical_codes.code_registry(canonical_codes.canonical_codes(records)).first().records == 2


def test_stable_ids(spark):
    rows = spark.createDataFrame([('a"\\/é\n', None)], "x string, y string")
    expected = "ns_" + hashlib.sha256(json.dumps(["ns", 'a"\\/é\n', ""], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]
    assert rows.select(identity.stable_id("ns", F.col("x"), F.col("y"))).first()[0] == expected
    assert rows.select(identity.pair_id(F.lit("b"), F.lit("a")) == identity.pair_id(F.lit("a"), F.lit("b"))).first()[0]
    assert rows.select(identity.identity_text(F.lit(" Straße ﬁ "))).first()[0] == "strasse fi"


def test_normalizer_steps():
    n = normalize.TextNormalizer([("vlv", "VALVE", "", ""), ("cv", "CONTROL VALVE", "", "ambiguous")], [("GRAM", "KG", 0.001), ("KG", "KG", 1.0)])
    assert n("ball  vlv ,500 gram") == ("BALL VALVE, 0.5 KG", ["whitespace", "reference_abbreviation", "case_normalization", "reference_unit"])
    assert n("cv 11kilovolts")[0] == "CV 11 KV" and n("cv for valve")[0].startswith("CONTROL VALVE")
    assert n(None) == ("", [])
    assert normalize.TextNormalizer([], [("M", "M", 1.0)], guarded_units=True)("CF8M VALVE")[0] == "CF8M VALVE"
    assert normalize.TextNormalizer([], [("M", "M", 1.0)])("CF8M VALVE")[0] == "CF8 M VALVE"


def test_unit_conversion(spark):
    one = spark.range(1).select(normalize.convert(F.lit(1.0), F.lit("kg"), F.lit("gram")).alias("g"), normalize.convertible(F.lit("kg"), F.lit("gram")).alias("y"), normalize.convertible(F.lit("kg"), F.lit("meter")).alias("n"), normalize.unit_symbol(F.lit(" Cu.M ")).alias("u")).first()
    assert math.isclose(one.g, 1000.0) and one.y and not one.n and one.u == "cubic_meter"


def test_retrieval(spark):
    docs = spark.createDataFrame([("p", "centrifugal pump 5 hp"), ("v", "gate valve 50 mm"), ("e", ""), ("n", None)], "id string, t string")
    asked = spark.createDataFrame([("q", "centrifugal pump")], "id string, t string")
    top = retrieval.best(retrieval.bm25(asked, docs, "id", "t", "id", "t"), "lexical", 5).collect()
    assert [(r.doc, r["rank"]) for r in top] == [("p", 1)]
    fused = retrieval.hybrid(asked, docs, "id", "t", "id", "t", k=2)
    assert fused.orderBy("rank").first().doc == "p"
    ranks = [spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, doc string, rank int"), spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query string, doc string, rank int")]
    both = {r.doc: r.fusion for r in retrieval.reciprocal_ranks(*ranks).collect()}
    assert both["b"] > both["a"] and math.isclose(both["b"], 1 / 62 + 1 / 61)
    v = docs.where("id = 'p'").select(retrieval.hash_embedding(F.col("t")).alias("v")).first().v
    place = int.from_bytes(hashlib.blake2b(b"pump", digest_size=8).digest(), "big") % 512
    assert math.isclose(v[place], 0.5) and math.isclose(sum(x * x for x in v), 1)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c")], "id long, t string")
    asked = spark.createDataFrame([(9, "a c c")], "id long, t string")
    got = {r.doc: r.lexical for r in retrieval.bm25(asked, docs, "id", "t", "id", "t").collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    gain = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert math.isclose(got[1], idf(1) * gain(2, 3)) and math.isclose(got[2], 2 * idf(2) * gain(1, 2)) and math.isclose(got[3], 2 * idf(2) * gain(1, 1))


def test_evaluation_edges(spark):
    none = spark.createDataFrame([], "label int, score double, id int, g string")
    assert evaluation.classification(none, "label", "score").first().f1 == 0.0
    assert evaluation.average_precision(none, "label", "score", "id").first().average_precision == 0.0
    rows = spark.createDataFrame([(1, 0.9, 1, "a"), (0, 0.9, 2, "a"), (1, 0.5, 3, "b"), (0, 0.1, 4, None), (None, 0.3, 5, "c")], "label int, score double, id int, g string")
    assert math.isclose(evaluation.average_precision(rows, "label", "score", "id").first().average_precision, (1 + 2 / 3) / 2)
    parts = {r.g: r.partition for r in evaluation.group_split(rows, "g", 0.0).select("g", "partition").distinct().collect()}
    assert sorted(parts.values()).count("test") == 1
    assert sorted(r.partition for r in evaluation.group_split(rows, "g", 1.1).select("g", "partition").distinct().collect()).count("train") == 1
    with pytest.raises(ValueError):
        evaluation.Calibrator.fit(none, "label", "score")


def test_calibrators_round_trip(spark):
    rows = spark.createDataFrame([(int(i % 10 < i / 10), i / 100) for i in range(100)], "label int, score double")
    for method in ("platt", "isotonic"):
        fitted = evaluation.Calibrator.fit(rows, "label", "score", method)
        again = evaluation.Calibrator.loads(fitted.dumps())
        ps = [r.p for r in rows.orderBy("score").select(again.apply(F.col("score")).alias("p")).collect()]
        assert all(0 <= p <= 1 for p in ps) and ps == sorted(ps)
    with pytest.raises(ValueError):
        evaluation.Calibrator.loads(fitted.dumps().replace("isotonic", "platt"))


def test_corpus_cleaning(spark):
    rows = spark.createDataFrame([(" | (1) TRANSPORE 5 CM (1) TRANSPORE 5 CM",), ("Supply of ga... Supply of gate valves",), (None,), ("plain  text -",)], "d string")
    assert [r.c for r in rows.select(corpus.clean_description(F.col("d")).alias("c")).collect()] == ["(1) TRANSPORE 5 CM", "Supply of gate valves", "", "plain text"]
    assert rows.limit(1).select(corpus.type_hint(F.lit("B/Fly VLV and ball valve"))).first()[0] == "ball valve"
    built = corpus.build_corpus(spark.createDataFrame([("2", "o", "gate  valve", "k"), ("1", "o", "gate valve", "k"), ("3", "p", "gate valve", "k"), ("4", None, "short", None)], "corpus_id string, organization string, description string, description_kind string"))
    assert sorted((r.corpus_id, r.item_type_hint) for r in built.collect()) == [("1", "gate valve"), ("3", "gate valve")]


def test_quality_on_empty_and_odd_rows(spark):
    schema = "corpus_id string, organization string, source_system string, tender_id string, description string, description_kind string, quantity string, unit string, document_url string, source_url string"
    units = spark.createDataFrame([("NOS",)], "surface_form string")
    assert quality.flagged(spark.createDataFrame([], schema), units).count() == 0
    rows = spark.createDataFrame([("a", None, None, None, None, None, None, None, None, None), ("b", "o", "s", "t", "12/34", "tender_title", "-1", "xx", "u", None), ("c", "o", "s", "T ", "Pipe", "tender_title", "1,0", "nos", "u", None), ("d", "O", "s", "t", " PIPE", "tender_title", "nan", " NOS", "u", None), ("e", "p", "s", "x", "x" * 5000, None, "", "", "u", None)], schema)
    got = {r.corpus_id: (set(r.checks), r.quality_status) for r in quality.flagged(rows, units).collect()}
    assert got["a"] == ({"empty_description", "missing_provenance_url", "missing_source_system"}, "quarantined")
    assert got["b"][0] == {"numeric_only_description", "invalid_quantity", "invalid_unit"}
    assert got["c"] == ({"duplicate_description", "repeated_tender_title"}, "clean_with_warnings")
    assert "invalid_quantity" in got["d"][0] and got["e"][0] == {"malformed_specification"}


def test_documents(spark):
    text = "Tender Title: supply of pumps\nMATERIALS\n1. 11 kV Transformer, IS 2026, HSN 8504 - 2 Nos\nGate valve 50 mm qty 1,200 nos\nshort pump\nCABLE,PWR,240MM2,1C,AL,X1\nBOQ 3 | Hex bolt long | 1,040 | nos\nItem Category / Item Category : enlistment of vendors\n3 Hex bolt long - 40 nos\nBolt M12 | nos | 40 | 1,200.50"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    items = documents_extract.line_items(docs, "id", "t").orderBy("line_no").collect()
    assert [(r.line_no, r.quantity, r.hsn_code) for r in items] == [(3, 2.0, "8504"), (4, 1200.0, "")]
    assert documents_extract.grounded(documents_extract.line_items(docs, "id", "t"), docs, "id", "t").count() == 2
    assert documents_extract.specifications(docs, "id", "t").where("id = 1").first().voltage_kv == [11.0]
    assert [tuple(r) for r in documents_extract.labelled_lines(docs, "id", "t").collect()] == [(1, 1, "tender_title", "supply of pumps")]
    found = {(r.pattern, r.item_text, r.quantity, r.unit) for r in documents_extract.item_lines(docs, "id", "t").collect()}
    assert ("spec_string", "CABLE,PWR,240MM2,1C,AL,X1", "", "") in found and ("boq_schedule_line", "Hex bolt long", "1,040", "nos") in found
    assert ("spec_sentence", "Gate valve 50 mm qty 1,200 nos", "", "") in found and not any(p == "item_category" for p, *_ in found)
    assert documents_extract.schedule_lines(docs, "id", "t").where("item_no = 3").first().quantity == 40.0
    row = documents_extract.table_rows(docs, "id", "t").orderBy(F.desc("line_no")).first()
    assert (row.item, row.unit, row.quantity, row.value) == ("Bolt M12", "nos", 40.0, 1200.5)


def test_html(spark):
    html = "<html><script>x</script><h1>Tender</h1><p>Gate&nbsp;valve <b>50</b></p><a href='/tender/1'>a</a><a href='mailto:x'>m</a><a href='/tender/1'>b</a><table><tr><th>No</th><th>Item</th></tr><tr><td>1</td><td>Valve</td></tr></table>"
    got = documents_extract.pages(spark.createDataFrame([(1, html, "https://x.example/list"), (2, None, None)], "id long, h string, u string"), "id", "h", "u").orderBy("id").collect()
    assert got[0].text.split("\n")[:2] == ["Tender", "Gate valve 50"] and got[0].links == ["https://x.example/tender/1"]
    assert got[0].tables == [[["No", "Item"], ["1", "Valve"]]] and got[1].text == ""
    rows = documents_extract.page_table_rows(documents_extract.pages(spark.createDataFrame([(1, html, None)], "id long, h string, u string"), "id", "h"), "id", ("ITEM",)).collect()
    assert [r.values for r in rows] == [{"no": "1", "item": "Valve"}]
    sizes = spark.createDataFrame([("1.5 MB",), ("20 kb",), ("none",)], "s string").select(documents_extract.advertised_bytes(F.col("s")).alias("b")).collect()
    assert [r.b for r in sizes] == [1.5 * 1024**2, 20 * 1024.0, None]


def _events(spark, rows):
    return spark.createDataFrame([(log, i, "material", f"M{i % 2}", "review", a, d, "2024-01-01T00:00:00+00:00") for log, i, a, d in rows], "log string, seq long, entity_type string, entity_id string, event_type string, actor string, details map<string,string>, timestamp string").withColumn("event_hash", F.lit("clash"))


def test_chain_by_hand_and_by_edit(spark):
    rows = [("l", i, f"actör{i}", {"input": "x", "b": None} if i == 3 else None) for i in range(6)] + [("m", 1, None, {})]
    chain = audit.appended(_events(spark, rows), "log", "seq").cache()
    last = ""
    dump = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for r in chain.where("log = 'l'").orderBy("seq").collect():
        d = r.details or {}
        last_was, last = last, dump({"entity_type": "material", "entity_id": r.entity_id, "event_type": "review", "actor": r.actor, "details": d, "timestamp": r.timestamp, "input_hash": dump(d.get("input")), "output_hash": dump(None), "model_version": "", "previous_event_hash": last})
        assert (r.previous_event_hash, r.event_hash, r.event_id) == (last_was, last, "evt_" + last[:24])
    assert all(r.valid for r in audit.verified(chain, "log", "seq").collect())
    hit = (F.col("log") == "l") & (F.col("seq") == 2)
    edited = chain.withColumn("actor", F.when(hit, "mallory").otherwise(F.col("actor")))
    got = {r.log: r for r in audit.verified(edited, "log", "seq").collect()}
    assert not got["l"].valid and (got["l"].broken, got["l"].first_broken) == (1, 2) and got["m"].valid
    redone = edited.withColumn("_again", audit.rehashed(edited)).withColumn("event_hash", F.when(hit, F.col("_again")).otherwise(F.col("event_hash"))).withColumn("event_id", F.when(hit, F.concat(F.lit("evt_"), F.substring("_again", 1, 24))).otherwise(F.col("event_id")))
    assert audit.verified(redone, "log", "seq").where("log = 'l'").first().first_broken == 3
    assert not audit.verified(chain.where("seq <> 3"), "log", "seq").where("log = 'l'").first().valid
    swapped = chain.withColumn("seq", F.when(F.col("seq") == 4, 5).when(F.col("seq") == 5, 4).otherwise(F.col("seq")))
    assert not audit.verified(swapped, "log", "seq").where("log = 'l'").first().valid
    assert [r.seq for r in audit.history(chain.where("log = 'l'"), "seq", "material", "M1").collect()] == [1, 3, 5]
    more = audit.appended(_events(spark, [("l", 7, "z", None), ("n", 1, "z", None)]), "log", "seq", audit.heads(chain, "log", "seq"))
    assert all(r.valid for r in audit.verified(chain.unionByName(more), "log", "seq").collect())
    assert audit.verified(audit.appended(_events(spark, []), "log", "seq"), "log", "seq").count() == 0


def test_fused_ranks_are_those_of_the_whole_lists(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice(["Pump", "valve", None])) for i in range(400)]
    asked = [("a", "w1 w2 w2 w3", None), ("b", "w4 w9", "pump"), ("c", "", "valve"), ("d", None, None), ("e", "zzz", "VALVE")]
    left, right = spark.createDataFrame(asked, "q string, t string, f string"), spark.createDataFrame(docs, "id int, t string, f string")
    k = 5
    monkeypatch.setattr(retrieval, "RRF_K", 3)  # a short reach, so that the cut matters
    got = {}
    for r in retrieval.hybrid(left, right, "q", "t", "id", "t", k, "f", "f").collect():
        got.setdefault(r.query, []).append((r["rank"], r.doc, round(r.lexical_score, 6), round(r.fusion, 9)))
    lex = {(r.query, r.doc): round(r.lexical, 9) for r in retrieval.bm25(left, right, "q", "t", "id", "t").collect()}
    vec = {r.id: r.v for r in right.select("id", retrieval.hash_embedding(F.col("t")).alias("v")).collect()}
    for q, t, f in asked:
        if not t:
            assert q not in got
            continue
        own = left.where(F.col("q") == q).select(retrieval.hash_embedding(F.col("t")).alias("v")).first().v
        let = [i for i, _, g in docs if f is None or g is None or f.lower() == g.lower()]
        dense = {i: round(sum(x * y for x, y in zip(own, vec[i])), 9) for i in let}
        lists = [sorted((i for i in let if lex.get((q, i), 0) > 0), key=lambda i: (-lex[q, i], i)), sorted(let, key=lambda i: (-dense[i], i))]
        fused = {}
        for ranked in lists:
            for n, i in enumerate(ranked, 1):
                fused[i] = fused.get(i, 0) + 1 / (3 + n)
        top = max((lex[q, i] for i in lists[0]), default=1)
        want = [(n, i, round(lex.get((q, i), 0) / top, 6), round(s, 9)) for n, (s, i) in enumerate(sorted(((round(s, 12), i) for i, s in fused.items()), key=lambda x: (-x[0], x[1]))[:k], 1)]
        assert sorted(got[q]) == want, q


def test_query_blocks_of_any_number(spark, monkeypatch):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)] if i % 9 else None) for i in range(120)], "id int, v array<double>")
    asked = vectors.select(F.concat(F.lit("q"), F.col("id")).alias("k"), F.col("v").alias("x")).where("id < 40")
    whole = retrieval.dense_best(vectors, "id", "v", asked, 3, "k", "x").collect()
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 7)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, retrieval.dense_best(vectors, "id", "v", asked, 3, "k", "x").collect())) and len(whole) == 3 * 35


def test_every_unit_is_known_where_none_is_listed(spark):
    schema = "corpus_id string, organization string, source_system string, tender_id string, description string, description_kind string, quantity string, unit string, document_url string, source_url string"
    rows = spark.createDataFrame([("a", "o", "s", "t", "pipe", "k", "1", "zz", "u", "u")], schema)
    assert quality.flagged(rows, spark.createDataFrame([], "surface_form string")).first().checks == []
    assert quality.flagged(rows, spark.createDataFrame([("NOS",)], "surface_form string")).first().checks == ["invalid_unit"]


def test_graph_frontier_clusters(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "b"), (None, "x"), ("c", "a")], "source string, target string")
    seeds = spark.createDataFrame([("a",), (None,)], "url string")
    assert {(r.url, r.depth) for r in lineage.frontier(links, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    rows = spark.createDataFrame([("1", "steel gate valve", "x"), ("2", "steel gate valves", "x"), ("3", "pump", "x"), ("4", "steel gate valve", "x"), ("5", "pump", "y"), ("6", None, "y")], "id string, t string, b string")
    assert {r.id: r.leader for r in lineage.leader_clusters(rows, "id", "t", "b").collect()} == {"1": "1", "2": "1", "3": "3", "4": "1", "5": "5"}
    vertices, edges = lineage.signal_graph(spark.createDataFrame([(1, 2, 3.0, "u"), (1, 3, None, "u")], "s long, t long, v double, u string"), "s", "t", "v", "u")
    assert vertices.count() == 3 and edges.count() == 1


def test_leader_clusters_do_not_depend_on_sizes(spark, monkeypatch):
    rng = random.Random(5)
    words = ["gate", "valve", "pump", "cable", "bolt", "Ölpumpe", "unit", "seal"]
    rows = [(f"{i:04d}", " ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", " 7", "s"]), rng.choice("xy")) for i in range(400)] + [("0007", "pumpe", "x"), ("0007", "pumpen", "x")]
    firsts = {}
    for k, t, b in rows:
        firsts[b, t] = min(k, firsts.get((b, t), k))
    leaders, want = [], {}
    for (b, t), k in sorted(firsts.items(), key=lambda x: (x[1], x[0][1])):
        want[b, t] = next((lk for lk, lt, lb in leaders if lb == b and lineage.similarity(lt, t) >= 0.75), None)
        if want[b, t] is None:
            leaders.append((k, t, b))
            want[b, t] = k
    frame = spark.createDataFrame(rows, "id string, t string, b string")
    for size in (7, 60, 1500):
        monkeypatch.setattr(lineage, "PART_ROWS", size)
        got = sorted((r.id, r.leader) for r in lineage.leader_clusters(frame, "id", "t", "b").collect())
        assert got == sorted((k, want[b, t]) for k, t, b in rows), size


def test_weak_labels(spark):
    rows = spark.createDataFrame([("1", "A", "11 kV transformer"), ("2", "B", "11 KV  Transformer"), ("3", "B", "11 kv transformer"), ("4", "A", "33 kV transformer"), ("5", "C", None)], "corpus_id string, organization string, description string")
    classes = {r.corpus_id: (r.class_id, r.representative) for r in weak_labels.exact_classes(rows).collect()}
    assert classes == {"1": ("1", "1"), "2": ("1", "2"), "3": ("1", "2")}
    labels = weak_labels.weak_labels(att.with_attributes(rows)).collect()
    assert {(r.material_a, r.material_b) for r in labels if r.relation == "EXACT"} == {("1", "2")}
    assert all("4" in (r.material_a, r.material_b) for r in labels if r.relation == "NOT_EQUIVALENT") and len(labels) > 1


def test_conflict_labels_reach_every_record_and_value(spark):
    said = {f"{i:02d}": [f"{i % 12 + 1}"] for i in range(40)} | {"90": ["1", "77"], "91": ["77"], "92": ["5"]}
    rows = spark.createDataFrame([(k, "A", " or ".join(f"{v} kV" for v in vs) + " transformer") for k, vs in said.items()], "corpus_id string, organization string, description string")
    labels = weak_labels.conflict_labels(att.with_attributes(rows)).collect()
    pairs = [(r.material_a, r.material_b) for r in labels]
    assert len(pairs) == len(set(pairs)) and all(a < b and r.reasons == "voltage" for (a, b), r in zip(pairs, labels))
    assert all(not set(said[a]) & set(said[b]) for a, b in pairs)
    # brute force: the next 8 values of each value, in order of text, each by its first record
    order = sorted({v for vs in said.values() for v in vs}, key=lambda v: f"{v}.0|kv")
    head = {v: min((len(vs), k) for k, vs in said.items() if v in vs)[1] for v in order}
    want = set()
    for k, vs in said.items():
        for v in vs:
            others = [order[(order.index(v) + i) % len(order)] for i in range(1, 9)]
            want |= {tuple(sorted((k, head[o]))) for o in others if not set(said[head[o]]) & set(vs)}
    assert set(pairs) == want and all(sum(k in p for p in pairs) >= 7 for k in said)
