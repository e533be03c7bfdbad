import pytest
from pyspark.sql import functions as F

from stocklore.llm.sentences import sentence_ends, sentences

# Sentences are given apart; joined by the separators they must come out again.
PROSE = [
    ["The U.K. make was rejected by Dept. II.", "Is it 3.5 or 4?", "Stop the test at once!", "'Not again!' said the fitter; it leaks.", "Yes.", "We waited ... and it came at 9 a.m..", "See Fig. 3, p. 9.", "The answer is no.", "It drew 4 A.", "He asked why … nobody knew."],
    ["Der Prüfer rief: „Sie ist undicht. Bitte tauschen!“ und ging.", "Am 5. Juni kam Fa. Alvora an.", "Das Maß beträgt i. d. R. 2,5 mm.", "Die 3. Lieferung fehlt.", "Vgl. Abb. 3 auf S. 13.", "Warum denn?"],
    ["Le chef a dit : « Ça fuit. Changez la vanne ! » puis il est parti.", "Est-ce grave ?!", "Cf. art. 3.1 du cahier.", "On a noté des rayures, des trous, etc.", "M. le chef veut 5 p. cent de plus."],
    ["El jefe dijo: «Pierde agua. Cámbienla.» y salió.", "¡Paren la prueba!", "EE. UU. no vende la bomba.", "¿Está la junta en la sala 3?", "Pesa aprox. 3,5 kg."],
    ["ताप 3.7 डि. से. रहा।", "क्या पाइप जाँचा गया?", "उसने कहा, \"यह टपकता है। इसे बदलो।\" और चला गया।", "हाँ।"],
    ["الضغط 5.0 بار، أي أعلى من الحد.", "قال الفاحص: «إنه يسرب. بدلوه.» ثم خرج.", "هل الكابل جاهز للوزن؟", "أرسل د. المخزن الكابل."],
]
DENSE = [
    ["检验员说：“漏水了。换一个！”然后离开。", "为什么又退回？！", "重量约3.9吨……还要再退回。", "请参见第6.1条。"],
    ["検査員は「漏れています。交換してください。」と言った。", "なぜ返品したのか？", "材質は在庫がない……らしい。"],
]
THAI = ["วาล์วมาถึงคลังพัสดุแล้ว", "รุ่น K1 อยู่ที่ท่าเรือ", "ดูเอกสาร QSY/MM/23/50519 ข้อ 2.5", "หยุดการทดสอบทันที!", "น้ำหนักประมาณ 76.34 กก. ต่อชิ้น"]


def cut(text):
    out, last = [], 0
    for e in sentence_ends(text):
        out.append(text[last:e].strip())
        last = e
    return out


@pytest.mark.parametrize("group", PROSE + [THAI])
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\n\n"])
def test_prose(group, gap):
    assert cut(gap.join(group)) == group


@pytest.mark.parametrize("group", DENSE)
def test_scripts_without_spaces(group):
    assert cut("".join(group)) == group and cut("\n".join(group)) == group


def test_line_breaks_inside_sentences():
    for group in PROSE:
        for s in group:
            words = s.split(" ")
            for i in range(1, len(words)):
                broken = " ".join(words[:i]) + "\n" + " ".join(words[i:])
                if not broken.startswith(("Am\n", "Das\n", "Die\n", "Der\n")):
                    assert len(cut("Yes. " + broken)) == 2, broken


def test_lines_of_their_own():
    text = "SCOPE OF SUPPLY\nThe pump came.\n1. gate valve 3.5 mm, 7 nos.\n• pump, rev. 9\n(f) pipe - 6\nvalve | 4.1 mm | 20 | LOR659TX\nIt was rejected.\n\nSection 4.2 Packing\nqty. 67 came. Annex follows.\n\n附件9\n5. of the 11 drums were returned."
    assert cut(text) == ["SCOPE OF SUPPLY", "The pump came.", "1. gate valve 3.5 mm, 7 nos.", "• pump, rev. 9", "(f) pipe - 6", "valve | 4.1 mm | 20 | LOR659TX", "It was rejected.", "Section 4.2 Packing", "qty. 67 came.", "Annex follows.", "附件9", "5. of the 11 drums were returned."]


def test_missing_blanks_and_odd_texts():
    assert cut("Cost: Rs. 3.5 lakh (incl. duty).It was rejected on 19.08.2022.Delivery follows.") == ["Cost: Rs. 3.5 lakh (incl. duty).", "It was rejected on 19.08.2022.", "Delivery follows."]
    assert sentence_ends(None) == [] and sentence_ends("") == [] and sentence_ends(" \n\t") == []
    assert sentence_ends("word") == [4] and sentence_ends(" a.  ") == [3]
    assert len(sentence_ends("One sentence here. " * 20_000)) == 20_000


def test_rows(spark):
    docs = spark.createDataFrame([(1, "A b. C d! "), (2, None), (3, " "), (4, "𝒳 is odd. Yes.")], "doc_id long, text string").withColumn("end_char", F.lit("clash"))
    got = [tuple(r) for r in sentences(docs).orderBy("doc_id", "sentence_no").collect()]
    assert got == [(1, 0, 4, "A b."), (1, 1, 9, "C d!"), (4, 0, 9, "𝒳 is odd."), (4, 1, 14, "Yes.")]
    assert sentences(docs.limit(0)).count() == 0


# Two sentences each, by the full stop of the script.
SCRIPTS = {
    "Armenian": ["Պոմպը հասավ։", "Այն ստուգվեց։"], "Burmese": ["ပန့်ရောက်ပြီ။", "စစ်ဆေးပြီးပြီ။"], "Khmer": ["ស្នប់មកដល់ហើយ។", "វាត្រូវបានពិនិត្យ។"],
    "Mongolian": ["ᠰᠣᠷᠣᠭᠤᠯ ᠢᠷᠡᠪᠡ᠃", "ᠰᠢᠯᠭᠠᠪᠠ᠃"], "Javanese": ["ꦥꦺꦴꦩ꧀ꦥ꧉", "ꦠꦺꦏ꧉"], "Urdu": ["پمپ آ گیا۔", "اس کی جانچ ہوئی۔"], "Ethiopic": ["ፓምፑ ደረሰ።", "ተፈተሸ።"], "Santali": ["ᱯᱟᱢᱯ ᱦᱮᱡ᱾", "ᱧᱮᱞ᱾"],
    "Brahmi (beyond the basic plane)": ["𑀅𑀆𑁇", "𑀇𑀈𑁇"], "Greek": ["Η αντλία ήρθε.", "Ελέγχθηκε."], "Cyrillic": ["Насос прибыл.", "Он проверен."],
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
@pytest.mark.parametrize("gap", [" ", "\n"])
def test_every_scripts_full_stop(script, gap):
    assert cut(gap.join(SCRIPTS[script])) == SCRIPTS[script]


def test_quotations_of_any_length():
    inner = "It leaks at the flange. Replace it at once. " * 60
    text = f'The inspector wrote, "{inner.strip()}" and left. Yes.'
    assert cut(text) == [text[:-5], "Yes."]
    assert cut(f"Der Prüfer rief: „{inner.strip()}“ und ging. Ja.")[1:] == ["Ja."]
    assert cut('The pipe is 5" wide. The other is 3" wide. Both fit.') == ['The pipe is 5" wide.', 'The other is 3" wide.', "Both fit."]


def test_caseless_headings_stand_alone_and_wrapped_lines_do_not():
    assert cut("तकनीकी विवरण\nवाल्व भंडार में अच्छी हालत में पहुँचा। हाँ।") == ["तकनीकी विवरण", "वाल्व भंडार में अच्छी हालत में पहुँचा।", "हाँ।"]
    assert cut("वाल्व भंडार में\nअच्छी हालत में\nपहुँचा। हाँ।") == ["वाल्व भंडार में\nअच्छी हालत में\nपहुँचा।", "हाँ।"]


@pytest.mark.parametrize("text", ["A." * 200_000, "(" * 200_000, "“" * 200_000, "a.\n" * 100_000, "'x " * 100_000, "1." * 200_000, "a" * 400_000, "x! " * 100_000, "ก " * 100_000])
def test_time_grows_with_length_only(text):
    import time

    began = time.process_time()
    assert sentence_ends(text)[-1] == len(text.rstrip())
    assert time.process_time() - began < 5
