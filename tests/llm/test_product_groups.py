from pyspark.sql import functions as F

from stocklore.llm.product_groups import FIXED, MARK, parsed, product_groups
from stocklore.llm.product_parse import ListingParser, dictionary, seed_phrases, segments

GRADES = ["QX263", "NIM753TX"]


def test_parser():
    p = ListingParser(GRADES, seed_phrases())
    base = p.parse("GATE VALVE, SIZE 25 MM, RATING 2.5 BAR, FLANGED ENDS, GR. QX263, PHOSPHATED, SERIES B497")
    assert base == {"kind": "gate valve", "length": "25000", "pressure": "250000", "form": "flanged", "grade": "qx263", "finish": "phosphated", "model": "b497"}
    for other in (
        "phos treated; premium sluice valve; model b-497; 0.025 m; flgd; qx 263; rating: 250 kpa",
        "PROCUREMENT OF VALVE GATE | TYPE B4 97 | 2.5 CM | FLANGED CONNECTION | QX-263 | PHOSPHATE COATED | 0.25 MPA".replace("B4 97", "B497"),
        "Gaate Valve, Sr. B/497, Nb 25Mm, 2.5Bar, Flgd, Grade Qx263, Phosphated, Total qty 1,200 metre",
        "  SLUICE VALVE  25 MM  RATING  2.5 BAR   FLGD  GR. QX263  PHOS   TREATED  SERIES\t B497​",
        "gate valve, series B4g7, 25 mm, 2.5 bar, flgd, qx263, phosphated, Tête filetée 250 mm".replace("g7", "97"),
    ):
        assert p.parse(other) == base, other
    assert p.parse(None) == {} and p.parse("") == {} and "kind" not in p.parse("VENDOR ENLISTMENT ROUND 12")
    assert segments("a, b;c | d - e / f") == ["a", "b", "c", "d", "e", "f"]


def rows(spark, *texts):
    return spark.createDataFrame([(f"M{i:02d}", t, "gate valve" if i % 2 else None) for i, t in enumerate(texts, 1)], "corpus_id string, description string, item_type_hint string").withColumn("kind", F.lit("clash")).withColumn("_id", F.lit(1))


def test_groups(spark):
    grades = spark.createDataFrame([(g,) for g in GRADES], "grade_token string")
    full = "GATE VALVE, SIZE 25 MM, RATING 2.5 BAR, FLANGED ENDS, GR. QX263, PHOSPHATED, SERIES B497"
    df = rows(
        spark, full, "sluice valve; type b497; 2.5 cm; 250 kpa; flgd; qx263; phos treated",  # another wording
        full.replace("25 MM", "250 MM"), full.replace("B497", "B498"), full.replace("PHOSPHATED", "POLISHED"),  # near, but other products
        "GATE VALVE, 25 MM, 2.5 BAR, FLANGED ENDS, QX263, B497, SERIES B497".replace(", B497,", ","),  # no finish: two products fit
        full.replace("25 MM", "250 MM").replace(", PHOSPHATED", ""),  # no finish, one product fits
        None, "", "CORRIGENDUM 12 TO EARLIER NOTICE", full.lower(), full.replace("FLANGED ENDS, ", "").replace("B497", "C111"), full.replace("PHOSPHATED, ", "").replace("B497", "C111"), "x " * 50_000,
    )
    got = {(r.first_id, r.listing_id) for r in product_groups(df, grades).collect()}
    assert got == {("M01", "M02"), ("M01", "M11"), ("M03", "M07"), ("M12", "M13")}
    assert product_groups(df.limit(0), grades).count() == 0


def test_mining_without_a_seed(spark):
    import random

    from stocklore.llm.product_mining import mined_dictionary

    rnd = random.Random(3)
    nouns = {"pumps": [["bilge pump", "pump bilge", "blg pmp"], ["vane pump", "pump vane type"]], "valves": [["pinch valve", "valve pinch"]]}
    mounts, coats = [["foot fixed", "on feet"], ["rail fixed", "on rail"], ["wall hung", "hung on wall"]], [["tinned", "tin coat"], ["waxed", "wax coat"], ["raw face", "untreated"]]
    texts = []
    for k in range(700):
        hint = rnd.choice(sorted(nouns))
        noun, mount, coat = rnd.choice(nouns[hint]), rnd.choice(mounts), rnd.choice(coats)
        for _ in range(rnd.randrange(2, 6)):
            fields = [rnd.choice(noun), rnd.choice(mount), f"series {'abcdefgh'[k % 8]}{100 + k}", "grade QX263"]
            fields += [rnd.choice(coat)] if rnd.random() < 0.8 else []
            fields += [w for w in ("best quality", "long life", "in stock") if rnd.random() < 0.3]
            rnd.shuffle(fields)
            texts.append((", ".join(fields), hint if rnd.random() < 0.97 else "pumps"))
    found = mined_dictionary(spark.createDataFrame(texts + [(None, "pumps"), ("x, y", None), ("", " ")], "t string, h string").withColumn("ps", F.lit("clash")), "t", "h")
    groups = {}
    for phrase, value in found.items():
        groups.setdefault(value, set()).add(phrase)
    wanted = {frozenset(g) for gs in (*nouns.values(), mounts, coats) for g in gs}
    assert {frozenset(g) for g in groups.values()} == wanted
    slots = {frozenset(g): slot for (slot, _), g in groups.items()}
    assert {slots[frozenset(g)] for gs in nouns.values() for g in gs} == {"kind"}
    assert len({slots[frozenset(g)] for g in mounts}) == len({slots[frozenset(g)] for g in coats}) == 1 and slots[frozenset(mounts[0])] != slots[frozenset(coats[0])]
    assert mined_dictionary(spark.createDataFrame([], "t string, h string"), "t", "h") == {}
    assert dictionary({"a": ("v1", "a"), "b": ("v1", "a")}, {"b": ("form", "x"), "c": ("form", "y")}) == {"a": ("form", "x"), "b": ("form", "x"), "c": ("form", "y")}


def test_fields_are_read_once(spark):
    class Counted(ListingParser):
        calls = 0

        def _segment(self, s):
            self.calls += 1
            return super()._segment(s)

    p = Counted(GRADES, seed_phrases(), memo=50)
    for i in range(500):
        got = p.parse(f"Gate Valve,  25 MM ; grade QX263 | {('Series: b%03d', 'TYPE B-%03d')[i % 2] % i}")
        assert got == {"kind": "gate valve", "length": "25000", "grade": "qx263", "model": f"b{i:03d}"}
    assert p.calls < 10  # series codes don't push the recurring fields out of memory
    slots = (*FIXED, "form")
    rows = spark.createDataFrame([("M1", "gate valve, flgd, 25 mm, series b497"), ("M2", "notice"), ("M3", None)], "k string, t string")
    got = parsed(rows, "k", "t", GRADES, seed_phrases(), slots).collect()
    assert [(r._id, dict(zip(slots, r._s.split(MARK), strict=True))) for r in got] == [("M1", dict.fromkeys(slots, "") | {"kind": "gate valve", "form": "flanged", "length": "25000", "model": "b497"})]


def test_trusted_listings(spark):
    from stocklore.llm.product_mining import _listings

    texts = ["Foot Fixed,\ttin   coat\r\nfoot fixed; SERIES - B497 | AB123 / cd456x, ab123x", "cd456x;ab123x - ab123, type b497", "series b497, cd456x", "no code: a1b2, long life", "", None]
    got = _listings(spark.createDataFrame([(t, " Pump ") for t in texts] + [("x", " ")], "t string, h string"), "t", "h").collect()
    assert [r.phrases for r in got] == [["foot fixed", "series", "tin coat"], [], [], ["long life"], []] and {r.hint for r in got} == {"pump"}
    first, second, third, *others = (r["product"] for r in got)
    assert first == second != third and None not in (first, third) and others == [None, None]
