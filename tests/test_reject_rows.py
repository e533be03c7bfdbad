import csv
import io
import random

from stocklore.operators.reject_rows import FEED_COLUMNS, loaded, rejected, structural_index

UNITS = [("KG", "KG"), ("N.O.S.", "NOS"), ("CUBIC METRE", "L")]


def reference(line):
    """The same rules by a state machine, one character at a time."""
    count, i, n = 1, 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return "broken_quoting", 0
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        i += 2
                        continue
                    i += 1
                    break
                i += 1
            if i < n and line[i] != ",":
                return "broken_quoting", 0
        else:
            while i < n and line[i] != ",":
                if line[i] == '"':
                    return "broken_quoting", 0
                i += 1
        if i >= n:
            return None, count
        count += 1
        i += 1


def test_structural_index_against_a_state_machine():
    rnd = random.Random(4)
    lines = ["".join(rnd.choice('ab",\n ,"') for _ in range(rnd.randrange(0, 14))) for _ in range(20_000)]
    broken, count, values = structural_index([x.encode() for x in lines], 3)
    for line, b, c, v in zip(lines, broken, count, values):
        code, n = reference(line)
        assert b == (code is not None), repr(line)
        if not b:
            assert c == n, repr(line)
            if n == 3 and line:
                assert [x.decode() for x in v] == next(csv.reader(io.StringIO(line), strict=True)) or "\n" in line


def feed(quantity, extra=""):
    cells = ["N1", "Org", "sys", "sec", "R/1", "T1", 'GATE VALVE, 2"" NB', "k", "", quantity, "NOS", "", "", "", "http://x"]
    return ",".join(f'"{c}"' if "," in c else c for c in cells) + extra


def test_rejects_and_loaded_rows(spark):
    good = feed("1,200.5 cubic metre")
    raw = spark.createDataFrame([
        ("l1", "f", 1, good), ("l2", "f", 2, good + ",x"), ("l3", "f", 3, good.replace('"GATE', 'GATE', 1)), ("l4", "f", 4, feed("ten")), ("l5", "f", 5, None),
        ("l6", "f", 6, ""), ("l7", "f", 7, feed("5 nos")), ("l8", "f", 8, feed("5 %")), ("l9", "f", 9, feed("1e999")), ("la", "f", 10, good), ("lb", "f", 11, feed("x" * 200_000)),
    ], "line_id string, source_path string, line_no int, raw_line string")
    units = spark.createDataFrame(UNITS, "surface_form string, canonical_unit string")
    corpus = spark.createDataFrame([("M1", "3"), ("M2", "- 3"), ("M3", None), ("M4", "  "), ("M5", "1,2,3"), ("M6", "3/4"), ("M7", "+2.5E2 kg"), ("M8", "inf"), ("M9", "9O9")], "corpus_id string, quantity string")
    got = {r.row_id: r.check_code for r in rejected(raw, corpus, units).collect()}
    assert got == {"l2": "wrong_column_count", "l3": "broken_quoting", "l4": "invalid_quantity", "l5": "wrong_column_count", "l6": "wrong_column_count", "l8": "invalid_quantity", "l9": "invalid_quantity", "lb": "invalid_quantity", "M2": "invalid_quantity", "M6": "invalid_quantity", "M8": "invalid_quantity", "M9": "invalid_quantity"}
    rows = {r.line_id: r for r in loaded(raw, units).collect()}
    assert set(rows) == {"l1", "l7", "la"} and rows["l1"].amount == 1200.5
    assert rows["l1"].description == 'GATE VALVE, 2" NB' and rows["l1"].item_type_hint is None
    assert [c for c in rows["l1"].asDict() if c not in ("line_id", "amount")] == list(FEED_COLUMNS)


def test_empty_tables(spark):
    raw = spark.createDataFrame([], "line_id string, source_path string, line_no int, raw_line string")
    corpus = spark.createDataFrame([], "corpus_id string, quantity string")
    units = spark.createDataFrame([], "surface_form string, canonical_unit string")
    assert rejected(raw, corpus, units).count() == 0 and loaded(raw, units).count() == 0
