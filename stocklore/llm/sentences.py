"""Sentence boundaries across languages and scripts.

The Unicode sentence-break properties (STerm, ATerm, Close, SContinue: every script's
terminators, closing marks and continuing marks) and the standard rules over them are
applied to whole texts, with abbreviation suppression by language, quotations that belong
to the sentence around them, and gaps where a script writes no stops (Thai, Lao).
Headings, list items and table rows that stand on a line of their own are units; other
line breaks end nothing.

A text is scanned once; what the rules settle by the next character alone (a dot within a
number, before a small letter) is settled inside the pattern, and each mark looks back
no further than the mark before it, so the time grows with the length of the text only.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


def _property(value: str) -> str:
    """All characters with a Sentence_Break property, from the Unicode tables of the ``regex`` package."""
    every = "".join(chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000)
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", every))


# Abbreviations after which a sentence goes on.
_NEVER = set(
    # English
    """mr mrs ms dr prof st m/s messrs dept fig figs tab cl sl ref rev dwg dia qty temp max min approx acc rs vol ed est pvt cat sec sect
    eq ser tel ext cf i.e e.g viz vs w.r.t w.e.f a.c d.c wt mfg mfr incl excl std spec nom para ch pp pg art"""
    # French
    """ env éq l'éq l’éq ste sté mme mlle ex chap av bd éd réf tél"""
    # German
    """ abb nr abs vgl bzw ca fa zzgl inkl evtl ggf bsp str hr fr dipl ing mind max kap"""
    # Spanish
    """ sr sra dr dra ud cía pág págs fig núm aprox diám ee uu ej prof art avda tel"""
    # Thai, Arabic
    """ กก ม มม ซม กม พ.ศ น ดร นาย د م أ ص ج""".split()
)
# Abbreviations that may also end a sentence; what follows decides.
_MAYBE = set("etc nos pcs hrs hr deg a.m p.m ltd co inc corp usw stk int uds pfd r.p.m rpm no n.m u.s u.k sq in ft cu lit kg mm cm km b.s al jr sr. cent".split())
# Letters that number pages and the like, words that a letter names, units of measure.
_LETTERED = {"s", "p", "n", "v", "t", "f"}
_LETTER_AFTER = {"line", "linie", "ligne", "línea", "linea", "type", "typ", "class", "unit", "gruppe", "zone", "bay", "grade"}
_UNITS = {"m", "mm", "cm", "km", "kg", "g", "l", "t", "ml", "in", "ft", "min", "sec", "ch", "art", "app"}
# Words written small that start sentences.
_SMALL = r"qty\.|pH\b|e\.g\.|i\.e\."
# Words before a German ordinal, and the months that may follow it.
_ORDINAL_BEFORE = {"am", "die", "der", "das", "den", "dem", "des", "vom", "zum", "im", "ab", "bis", "zur", "beim", "und", "jede", "jeder"}
_MONTHS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
# Words and numbering that make a line a heading.
_HEAD_WORD = re.compile(
    r"(?:section|annex\w*|appendix|chapter|part|clause|schedule|anlage|anhang|abschnitt|kapitel|annexe|chapitre|article|anexo|apéndice|capítulo|sección|परिशिष्ट|अनुभाग|अध्याय|附件|附录|第|別紙|付録|ภาคผนวก|บทที่|الملحق|الفصل|القسم)"
    r"\s*[\d०-९٠-٩]+(?:\.\d+)*[章节節条条項]?(?:[ \t]+[^\s.!?,;:]+){0,4}$",
    re.I,
)
# Articles, prepositions and verbs that no heading ends with.
_LAST_SMALL = set(
    """the a an of to in on at by for with from is was are were be been and or not no we it he she they this that as if than
    le la les l un une des du de au aux en et ou à est sont par pour avec sur dans que qui ne pas se
    der die das den dem des ein eine einen im am an auf in zu mit und oder ist sind war wurde kam von vom für bei nicht
    el los las un una del al en y o es son por para con que se no su""".split()
)
# Thai function words, units and counters; a gap before them is inside a statement.
_THAI_ON = ("อยู่", "ข้อ", "กก", "ต่อ", "หน้า", "ของ", "ที่", "และ", "หรือ", "ใน", "จาก", "ถึง", "เป็น", "มี", "แล้ว", "บาร์", "มม", "ซม", "เมตร", "ลิตร", "ตัว", "ชิ้น", "ชุด", "วัน", "น.", "ตัน", "แต่", "ซึ่ง", "เพราะ", "โดย", "กับ")
# The marks of exclamations and questions in scripts with blanks and capitals.
_CALLS = "!?‼‽⁇⁈⁉"

_STOPS = "".join(c for c in _property("STerm") if c not in _CALLS) + "．"
_CLOSERS = "".join(c for c in _property("Close") if c not in "([{“„«‹「『‘《（¿¡") + "“«»"
_TERMINATORS = frozenset(_CALLS + _STOPS + ".…․﹒")
_STOP = frozenset(_STOPS)
_GOES_ON = frozenset(c for c in _property("SContinue") if c not in "-–—－﹘﹣") | _TERMINATORS | {")"}



def _marks(stops: str) -> re.Pattern:
    """Runs of terminators. A dot is none if a digit or a small letter follows, at once or after blanks (words that start sentences small excepted)."""
    every = f"[.․﹒…{_CALLS}{re.escape(stops)}]"
    return re.compile(rf"{every}(?!(?<=[.․﹒])(?:\d|\s*(?!{_SMALL})[a-zß-öø-ÿ])){every}*")


# Sets within the basic plane are one table lookup a character; texts with characters beyond it take the full set.
_MARK, _MARK_ALL = _marks("".join(c for c in _STOPS if c <= "\uffff")), _marks(_STOPS)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_CLOSE = re.compile(rf"(?:[{re.escape(_CLOSERS)}]|[   ](?=[»›])[»›])+")
# A straight mark opens only before a word and not behind one (an inch mark opens nothing).
_OPENER = re.compile("[“„«‹「『‘《（(\\[\"'](?:(?<=[“„«‹「『‘《（(\\[])|(?<=(?<!\\w)\")(?=[\\w¿¡(\\[])|(?<=(?<![^\\s(])')(?=\\w))")
_CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’", "《": "》", "（": "）", "(": ")", "[": "]", '"': '"', "'": "'"}
_APOSTROPHE = re.compile(r"'(?!\w)")
_SMALL_START = re.compile(_SMALL)
_GLUED_START = re.compile("[A-ZÀ-Þ](?:[a-zà-ÿ’' ]|[A-Z]?\\.|/[a-z])")
_SPACES = re.compile(r"\s*")
_TOKEN = re.compile(r"\S*")
_BREAK = frozenset(" \t\n\r\x0b\x0c\x85\xa0     　()[]\"“”„«»‘" + "".join(map(chr, range(0x2000, 0x200B))))
_GAP_SCRIPT = re.compile("[฀-໿]")
_GAP = re.compile("(?<=[฀-໿A-Za-z\\d])\\s+(?=[฀-໿])")
_OWN_STOP = re.compile("[ऀ-ॿ฀-໿]$")
_TAIL = "".join(set(_CLOSERS + " \t\r\n\x0b\x0c\xa0　"))
_BULLETS = frozenset("•‣▪◦·*●○■□–—-")
_LIST = re.compile(r"(?:[•‣▪◦·*●○■□–—-]\s+|\(\s?\w{1,4}\s?\)\s+|[a-zA-Z]\)\s+|\d{1,3}\)\s+)\S")
_NUMBERED = re.compile(r"\d{1,3}(?:\.\d{1,3})*\.\s+(?!of\b)\S")
_ROW = re.compile(r"[^|\n]*\|[^|\n]*\||\s*\|.*\|\s*$")
_SENTENCE_WITHIN = re.compile(r"[a-zà-ÿ]{3,}[.!?]\s+\S")
_STOP_WITHIN = re.compile(rf"[{_CALLS}{re.escape(_STOPS)}]|[^\W\d_]{{3,}}\.\s+[A-ZÀ-Þ]")
_HEAD_WORDS, _HEAD_CHARS, _LISTED_WORD = 5, 45, 64


def _ended(line: str) -> bool:
    """Whether a line ends with a terminator, closing marks and blanks left out."""
    return line.rstrip(_TAIL)[-1:] in _TERMINATORS


def _is_heading(line: str, following: str, first: bool, page: int) -> bool:
    """Whether an unterminated line at a sentence start, with a line of text following, is a heading.

    Scripts with capitals show headings by these; in others a short line of words only is one where it
    stands first in its paragraph and the next word would still have fit on it (``page``: the widest line).
    """
    s = line.strip()
    if _HEAD_WORD.match(s):
        return True
    letters = [c for c in s if c.isalpha()]
    if not letters or s[-1] in ",:;-–—…":
        return False
    words = s.split()
    cased = any(c.islower() or c.isupper() for c in letters)
    if cased and len(letters) > 3 and not any(c.islower() for c in letters) and len(words) <= 8 and not any(c.isdigit() or c == "/" for c in s):
        return True
    if len(words) > _HEAD_WORDS or len(s) > _HEAD_CHARS or any(c in s for c in ".,;:@/\"'«»“”„(") or any(c.isdigit() for c in s):
        return False
    nxt = following.lstrip()
    token = nxt.split()[0] if nxt else ""
    if not cased:
        if not first or any(c in _GOES_ON or not (c.isalnum() or c.isspace() or c in "​‌‍") and not _is_mark(c) for c in s):
            return False
        return len(s) + 1 + (len(token) if " " in s else 1) <= page
    if words[-1].lower() in _LAST_SMALL or not s[0].isupper():
        return False
    return bool(_SMALL_START.match(nxt)) or ((nxt[:1].isupper() or nxt[:1] in "¿¡«“\"„'" or not (nxt[:1].islower() or nxt[:1].isdigit())) and not any(c.isdigit() for c in token))


def _is_mark(c: str) -> bool:
    return regex.match(r"\p{M}", c) is not None


def _line_kind(raw: str) -> str:
    s = raw.strip()
    if not s:
        return ""
    if ("|" in s and _ROW.match(raw)) or s.count("\t") > 1:
        return "row"
    c = s[0]
    if (c in _BULLETS or c == "(" or s[1:2] == ")" or c.isdigit()) and _LIST.match(s):
        return "list"
    return "number" if c.isdigit() and _NUMBERED.match(s) else "text"


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, unit) parts of a text: units are one sentence each, the others paragraphs of prose."""
    raws = text.split("\n")
    kinds = [_line_kind(raw) for raw in raws]
    begun, done, open_line, at, last = None, 0, False, 0, len(raws) - 1
    page = max(map(len, raws)) if last else 0
    for k, raw in enumerate(raws):
        kind, start = kinds[k], at
        at += len(raw) + 1
        ended = kind != "" and _ended(raw)
        if kind in ("number", "list") and open_line:
            kind = "text" if kind == "number" or raw.lstrip()[0] in "-–—(" else kind
        if kind == "number" and _SENTENCE_WITHIN.search(raw):
            kind = "text"
        if kind == "text" and not open_line and not ended and k < last:
            then = kinds[k + 1]
            if then in ("list", "row"):
                if not _GAP_SCRIPT.search(raw) and not _STOP_WITHIN.search(raw):
                    kind = "head"
            elif then and _is_heading(raw, raws[k + 1] if then == "text" else "A", begun is None, page) and not _STOP_WITHIN.search(raw):
                kind = "head"
        if kind != "text":
            if begun is not None:
                yield begun, done, False
                begun = None
            if kind:
                yield start, start + len(raw), True
            open_line = False
            continue
        if begun is None:
            begun = start
        done, open_line = start + len(raw), not ended
    if begun is not None:
        yield begun, done, False


def _quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(opening, closing) positions of the outermost quotations and brackets of a paragraph, however long.

    The next place of every closing mark is kept, so that marks without a partner cost nothing twice.
    """
    spans: list[tuple[int, int]] = []
    ahead: dict[str, int] = {}
    past = -1
    for m in _OPENER.finditer(text, start, end):
        i = m.start()
        if i <= past:
            continue
        best = end
        for mark in _CLOSED_BY[text[i]]:
            j = ahead.get(mark, -1)
            if j <= i:
                if mark == "'":
                    found = _APOSTROPHE.search(text, i + 1, end)
                    j = found.start() if found else end
                else:
                    j = text.find(mark, i + 1, end)
                    j = end if j < 0 else j
                ahead[mark] = j
            best = min(best, j)
        if best < end:
            spans.append((i, best))
            past = best
    return spans


def _word_before(text: str, floor: int, i: int) -> str:
    """The last word of ``text[floor:i]``, blanks left out."""
    while i > floor and text[i - 1].isspace():
        i -= 1
    k = i
    while k > floor and not text[k - 1].isspace():
        k -= 1
    return text[k:i]


def _dot_ends(text: str, begin: int, k: int, i: int, after: int, end: int) -> bool:
    """Whether the dot at ``i`` behind the word from ``k`` on (what follows starts at ``after``) ends a sentence that began at ``begin``."""
    if after >= end:
        return True
    nxt = text[after]
    if i - k > _LISTED_WORD:  # longer than any listed word: a code or an address, which ends before a blank only
        return after > i + 1 and not nxt.islower()
    before = text[k:i]
    small = nxt.islower() and not _SMALL_START.match(text, after)
    if after == i + 1:
        if not (nxt in "¿¡«“„「" or (nxt.islower() and not small) or _GLUED_START.match(text, after, end)) or "@" in before or "/" in before[-4:]:
            return False
        if not before:
            return i > begin and text[i - 1] in ")]»”\""
        if before.isdigit():
            return text[begin:k].strip(" '\"(") != ""
        word = before.lower().lstrip("'’‘")
        if len(before) == 1:
            lead = _word_before(text, begin, k)
            return lead[-1:].isdigit() or lead.lower() in _LETTER_AFTER
        if "." in before.strip("0123456789."):
            return word in _MAYBE
        return word not in _NEVER or (word in _UNITS and _word_before(text, begin, k)[-1:].isdigit())
    if small:
        return False
    if not before:
        return True
    if before[-1] > "ࣿ" and _OWN_STOP.search(before):
        return False  # a script whose sentences end otherwise: the dot shortens a word
    if len(before) == 1:
        if before.isalpha() and k - 3 >= begin and text[k - 1].isspace() and text[k - 2] == "." and text[k - 3].isalpha() and (k - 3 == begin or text[k - 4].isspace()):
            return False  # spaced initials, as in "i. d. R."
        if before.isascii() and before.isalpha():
            lead = _word_before(text, begin, k)
            if lead[-1:].isdigit() or lead.lower() in _LETTER_AFTER:
                return True
            token = _TOKEN.match(text, after, end)[0]
            if len(token) == 2 and token[1] == "." and token[0].isalpha():
                return False
            if nxt.isdigit() and before.lower() in _LETTERED or before == "M":
                return False
            return before.islower() or lead[:1].islower()
    word = before.lower().lstrip("'’‘¿¡-–")
    if word.replace(".", "").isdigit():
        head = text[begin:k]
        if not head.strip(" '\"("):
            return False
        if "." not in word and int(word) <= 31:
            if _MONTHS.match(text, after):
                return False
            lead = _word_before(text, begin, k).lower()
            if lead in _ORDINAL_BEFORE and nxt.isupper() and lead not in ("in", "auf"):
                return False
        return True
    if word == "no":
        return not any(c.isdigit() for c in _TOKEN.match(text, after, end)[0])
    if word in _NEVER or ("’" in word[:3] and word.rsplit("’", 1)[-1] in _NEVER):
        return word in _UNITS and _word_before(text, begin, k)[-1:].isdigit()
    return True


def _prose(text: str, start: int, end: int, out: list[int]) -> None:
    """Appends the sentence ends of one paragraph."""
    begin = start
    spans = _quotations(text, start, end)
    gaps = []
    if _GAP_SCRIPT.search(text, start, end):
        gaps = [m.start() for m in _GAP.finditer(text, start, end) if not text.startswith(_THAI_ON, m.end())]
    s = g = 0
    floor, word = start, start  # the mark before, and where the word at it began
    mark = _MARK if text.isascii() or not _BEYOND.search(text, start, end) else _MARK_ALL
    for m in mark.finditer(text, start, end):
        i, j = m.span()
        while g < len(gaps) and gaps[g] < i:
            if gaps[g] > begin:
                out.append(gaps[g])
                begin = _SPACES.match(text, gaps[g]).end()
            g += 1
        k = i
        while k > floor and text[k - 1] not in _BREAK:
            k -= 1
        if k > floor or floor == start:
            word = k
        floor = j
        word = max(word, begin)
        while s < len(spans) and spans[s][1] < i:
            s += 1
        inside = s < len(spans) and spans[s][0] < i
        close = _CLOSE.match(text, j, end)
        stop = close.end() if close else j
        if inside:
            if not close or stop <= spans[s][1]:
                continue
        elif close and text[j] in "\"'“«" and (s >= len(spans) or spans[s][1] != j):
            stop, close = j, None  # that mark opens the next quotation
        elif close and text[stop - 1] in "“«" and s < len(spans) and spans[s][0] == stop - 1:
            stop, close = j, None
        if stop < end and text[stop].isspace():
            after = stop + 1
            if after < end and text[after].isspace():
                after = _SPACES.match(text, after).end()
        else:
            after = stop
        nxt = text[after] if after < end else ""
        final = text[j - 1]
        if not nxt:
            ends = True
        elif nxt in _GOES_ON:
            ends = False
        elif final in _STOP:
            ends = not close or text[stop - 1] in ")）]】"
        elif final in _CALLS:
            starts = nxt.isupper() or nxt in "¿¡«“„\"'"
            ends = not close or not nxt.islower() or bool(_SMALL_START.match(text, after))
            if after == stop and not starts:
                if close:
                    ends = ends and (nxt.isdigit() or not close[0].strip("\")]"))
                else:
                    ends = not (nxt.isalnum() and nxt.isascii())
        elif j - i == 1 and final != "…":
            if not close:
                ends = _dot_ends(text, begin, word, i, after, end)
            else:
                ends = not nxt.islower() or bool(_SMALL_START.match(text, after))
                if ends and text[stop - 1] in ")]":
                    ends = inside or text[word:i].lower() not in _NEVER
                elif ends and nxt.isalpha() and not nxt.isupper():
                    ends = False  # a script without capitals: the sentence goes on after the quotation
        elif j - i == 2 and final != "…":
            ends = not nxt.islower() or bool(_SMALL_START.match(text, after))
            if ends and close and nxt.isalpha() and not nxt.isupper() and text[stop - 1] not in ")]":
                ends = False
        else:
            ends = stop < after and (nxt.isupper() or nxt in "¿¡«“„\"'")
        if ends:
            out.append(stop)
            begin = after
    for gap in gaps[g:]:
        if gap > begin:
            out.append(gap)
            begin = _SPACES.match(text, gap).end()
    if begin < end:
        out.append(end)


def sentence_ends(text: str | None) -> list[int]:
    """Ends (code points from the start, blanks after a sentence left out) of a text's sentences; none for null and blank texts."""
    if not text or text.isspace():
        return []
    raw: list[int] = []
    out: list[int] = []
    last = 0
    for start, end, unit in blocks(text):
        if unit:
            raw = [end]
        else:
            raw.clear()
            _prose(text, start, end, raw)
        low = max(last, start)
        for stop in raw:
            while stop > low and (text[stop - 1].isspace() or text[stop - 1] in "​﻿"):
                stop -= 1
            if stop > low:
                out.append(stop)
                last = low = stop
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row a sentence: ``key``, ``sentence_no`` from 0, ``end_char`` and, if wanted, the ``sentence``. Other columns are ignored."""
    fields = f"{documents.select(key).schema.simpleString()[7:-1].replace(':', ' ')}, sentence_no int, end_char int" + (", sentence string" if with_text else "")
    names = [key, "sentence_no", "end_char"] + (["sentence"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [sentence_ends(t) for t in texts]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ends = [e for row in found for e in row]
            first = np.cumsum(counts) - counts
            numbers = np.arange(len(ends)) - np.repeat(first, counts)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts))), pa.array(numbers.astype(np.int32)), pa.array(ends, pa.int32())]
            if with_text:
                columns.append(pa.array([t[a:b].strip() for t, row in zip(texts, found) for a, b in zip([0, *row], row)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    filled = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").rlike(r"\S"))
    return spread(filled).mapInArrow(run, fields)
