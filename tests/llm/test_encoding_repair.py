import pytest
from pyspark.sql import functions as F

from stocklore.llm.encoding_repair import garbled_rows, repair

CLEAN = ["TÊTE FILETÉE 12", "Ø606 MM", "mm²", "“QUICK FIT” cover", "D’ÉTANCHÉITÉ", "alvöra®", "±250 µm", "−40 °C", "труба стальная", "स्टील पाइप", "½ turn", "5 €", "10 Ω", "AÇÃO", "forgé n° 3", "水泵", "naïve café", "GEHÄRTET"]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_words_are_no_cases(text):
    assert repair(text) == (False, text, True)


@pytest.mark.parametrize("page", ["cp1252", "cp1251", "cp850", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["TÊTE FILETÉE", "geführte Büchse", "– 20 °C", "स्टील", "труба"])
def test_round_trips(page, text):
    try:
        read = text.encode().decode(page)
    except UnicodeDecodeError:
        pytest.skip("the page has no such byte")
    assert repair(read)[:2] == (True, text)


def test_twice_cased_and_single_byte():
    twice = "Ø É".encode().decode("latin-1").encode().decode("latin-1")
    assert repair(twice)[:2] == (True, "Ø É")
    assert repair("TÊTE".encode().decode("cp1252").lower())[0]
    assert repair("FORGÉ".encode("cp1252").decode("cp850"))[:2] == (True, "FORGÉ")
    assert repair("труба без шва".encode("cp1251").decode("cp1252"))[:2] == (True, "труба без шва")
    garbled, restored, whole = repair("V�LVULA Ã‰")
    assert garbled and restored == "V�LVULA É" and not whole
    assert repair(None) == (False, None, True) and repair("") == (False, "", True)


def test_rows(spark):
    rows = spark.createDataFrame([("1", "plain"), ("2", None), ("3", ""), ("4", "caÃ±erÃ­a"), ("4", "caÃ±erÃ­a"), ("5", "cañería"), ("6", "caÃ±erÃ­a " * 20_000)], "corpus_id string, description string")
    got = garbled_rows(rows, "corpus_id", "description").collect()
    assert sorted(r.corpus_id for r in got) == ["4", "4", "6"] and {r.restored for r in got} == {"cañería", "cañería " * 20_000}
    assert garbled_rows(rows.limit(0), "corpus_id", "description").count() == 0


def test_any_number_of_rounds():
    text = "Größe 5 µm – Vanne à brides"
    for page in ("cp1252", "cp850", "mac_roman"):
        now, rounds = text, 0
        while rounds < 6:
            try:
                now = now.encode().decode(page)
            except UnicodeDecodeError:
                break
            rounds += 1
            assert repair(now) == (True, text, True), (page, rounds)
        assert rounds >= 4 or page == "cp1252"


def test_accented_letters_alone_are_no_evidence():
    for sound in ("liste ÄÖÜ ok", "ÉÈÊ accents", "ÀÂÄ ÉÈÊË letters", "ÄÖÜ äöü ß", "ÅÄÖ, ÆØÅ", "àéè êëï", "NAÏVE ÉTÉ", "ÜÖÄ ÜÖÄ"):
        assert repair(sound) == (False, sound, True), sound
    for meant in ("ТРУБА БЕЗ ШВА 5", "Труба Без Шва", "насос и клапан"):
        read = meant.encode("cp1251").decode("cp1252")
        assert repair(f"PIPE, {read}, DN 5") == (True, f"PIPE, {meant}, DN 5", True), read


def test_the_noted_encoding_decides_between_equal_pages(spark):
    rows = spark.createDataFrame([("a", "GrÃ¶ÃŸe", "f1"), ("b", "plain", "f1"), ("c", "Größe", None), ("d", "GrÃ¶ÃŸe", "unknown file")], "k string, t string, f string").withColumn("encoding", F.lit("clash"))
    notes = spark.createDataFrame([("f1", "CP1252"), ("f1", None), ("f2", "utf-8")], "source_path string, encoding string")
    got = {r.k: (r.restored, r.complete, r.noted_encoding) for r in garbled_rows(rows, "k", "t", "f", notes).collect()}
    assert got == {"a": ("Größe", True, "cp1252"), "d": ("Größe", True, None)}
    assert garbled_rows(rows, "k", "t").count() == 2
