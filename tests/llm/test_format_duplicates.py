import random

from pyspark.sql import functions as F

from stocklore.llm import format_duplicates
from stocklore.llm.format_duplicates import collapsed, format_copies, same_codes, text_hashes

BASE = "Gate valve, nb 12.5 mm, rating 20 bar, gr. QX1"


def variants(rnd, text):
    fields = [f.strip() for f in text.split(",")]
    rnd.shuffle(fields)
    out = rnd.choice([", ", ";", " | ", " - ", " / ", "  ", "; "]).join(fields)
    out = rnd.choice([str.upper, str.lower, str.title, str])(out)
    return rnd.choice(["", " ", "\t", "\xa0", "•  "]) + out.replace(" bar", rnd.choice([" bar", "  bar", " bar"])) + rnd.choice(["", ".", "!", " \n", "​"])


def same_fields(a, b):
    return bool(format_duplicates.same_fields([a], [b])[0])


def same_stream(a, b):
    """Brute force: letters, marks and digits in order, with the points between digits."""
    plain = lambda s: "".join(c for i, c in enumerate(s.casefold()) if c.isalnum() or (c == "." and 0 < i < len(s) - 1 and s[i - 1].isdigit() and s[i + 1].isdigit()))
    return plain(a) == plain(b)


def test_two_pointer_comparison():
    assert same_stream("A-b, 1.5", "ab 1.5;") and not same_stream("1.5", "15") and same_stream("12.", "12") and not same_stream("ab", "abc")
    assert same_fields("gate valve, nb 20 mm", "NB 20 MM | Gate-Valve") and same_fields("a b, c d", " C D   A B ")
    assert not same_fields("size 20 mm, rating 16 bar", "size 16 mm, rating 20 bar")
    assert not same_fields("nb 2 mm, 1 kg", "nb 1 mm, 2 kg")


def test_hashes_ignore_layout_only():
    rnd = random.Random(1)
    same = [variants(rnd, BASE) for _ in range(50)]
    assert len(set(text_hashes(same, False).tolist())) == 1
    other = [BASE.replace("12.5", "125"), BASE.replace("QX1", "QX2"), BASE + ", x"]
    assert text_hashes([BASE], False)[0] not in text_hashes(other, False).tolist()
    assert text_hashes([None, "", " .;", "a"], True).tolist()[:3] == [0, 0, 0]
    assert text_hashes(["ab c", "a bc"], True).tolist()[0] == text_hashes(["a-b.c"], True)[0]


def test_copies_against_brute_force(spark):
    rnd = random.Random(2)
    bases = [BASE, BASE.replace("20 bar", "12.5 bar").replace("12.5 mm", "20 mm"), BASE.replace("12.5", "125"), "Pump, 5 kW", "Pump, 5 kW, spare"]
    rows = [(f"M{i:03d}", variants(rnd, bases[i % 5]), rnd.choice(["A/B/12/3-C", "a b 12 3 c", "AB123C", "A.B.12.3-C"]), bases[i % 5]) for i in range(120)]
    rows += [("N1", None, "AB123C", None), ("N2", "Pump, 5 kW", None, None), ("N3", "  ", "AB123C", None), ("N4", "Pump, 5 kW", " ", None), ("N5", BASE, "AB2C", "other"), ("Z1", "w " * 30_000, "L", "long"), ("Z2", "W\t" * 30_000, "l.", "long")]
    df = spark.createDataFrame([r[:3] for r in rows], "corpus_id string, description string, tender_reference string").withColumn("_h", F.lit(1)).withColumn("first_id", F.lit("x"))
    groups = {}
    for i, _, _, base in rows:
        if base:
            groups.setdefault(base, []).append(i)
    expected = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {(r.first_id, r.copy_id) for r in format_copies(df, "corpus_id", "description", "tender_reference").collect()} == expected
    counts = {r.first_id: r.copies for r in collapsed(df, "corpus_id", "description", "tender_reference").collect()}
    assert counts["M000"] == 24 and counts["N1"] == 1 and len(counts) == len(rows) - len(expected) and sum(counts.values()) == len(rows)


def test_empty(spark):
    assert format_copies(spark.createDataFrame([], "k string, t string, r string"), "k", "t", "r").count() == 0


def test_blanks_present_or_absent(spark):
    rows = [("a", "GATE VALVE, non-return, 25 MM", "R1"), ("b", "gatevalve; 25mm; nonreturn", "R1"), ("c", "gate valve, nonreturn, 52 mm", "R1"), ("d", "25 mm gate valve non return", "R1")]
    got = format_copies(spark.createDataFrame(rows, "k string, t string, r string"), "k", "t", "r").collect()
    assert {tuple(r) for r in got} == {("a", "b"), ("a", "d")}


def test_equal_and_nested_fields_take_linear_time():
    import time

    began = time.process_time()
    for n in (12, 40, 400):
        assert not same_fields("a, " * n + "b c", "c b, " + "a, " * n)
        assert same_fields("a, " * n + "b c", "b c; " + "a; " * n) and same_fields("a, " * n + "b c", "b c " + "a " * n)
        chain = [("a" * k) for k in range(1, n // 4)]
        assert same_fields(", ".join(chain), "; ".join(reversed(chain))) and same_fields(", ".join(chain), " ".join(reversed(chain)))
        assert not same_fields(", ".join(chain) + ", x y", " ".join(chain) + " y x")
    assert time.process_time() - began < 5


def test_pairs_of_a_batch_against_brute_force():
    rnd = random.Random(5)
    words = ["ab", "a", "b", "1.5", "15", "x-y", "", "Ä", "ﬁt", "2", "5", ".", "a b"]
    a = [", ".join(rnd.choices(words, k=rnd.randrange(5))) for _ in range(2000)]
    b = []
    for t in a:
        fields = t.split(", ")
        rnd.shuffle(fields)
        b.append(rnd.choice([", ", "; ", " | ", "\n"]).join(fields) if rnd.random() < 0.6 else ", ".join(rnd.choices(words, k=rnd.randrange(5))))
    plain = lambda f: "".join(c for i, c in enumerate(f.casefold()) if c.isalnum() or (c == "." and 0 < i < len(f) - 1 and f[i - 1].isdigit() and f[i + 1].isdigit()))
    bag = lambda t: sorted(x for x in map(plain, t.replace(";", ",").replace("|", ",").replace("\n", ",").replace("ﬁ", "fi").split(",")) if x)
    for x, y, found in zip(a, b, format_duplicates.same_fields(a, b)):
        if bag(x) == bag(y):
            assert found, (x, y)
        elif "".join(sorted("".join(bag(x)))) != "".join(sorted("".join(bag(y)))):
            assert not found, (x, y)
    assert same_codes(["A.B-1", "ab2"], ["ab 1", "ab1"]).tolist() == [True, False]
