"""Parsing of one listing text into typed attribute slots (kind, model, grade, measures, form, finish)."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterable

from . import product_lexicon as lex

_SPACE = re.compile(r"\s+")
_STRONG = re.compile(r"[,;|\n]|\s[-–/]\s")
_MEASURE = re.compile(r"(?<![\w.,])(\d+(?:,\d{3})*(?:\.\d+)?)[\s-]*(" + "|".join(sorted(map(re.escape, lex.ITEM_UNITS), key=len, reverse=True)) + r")\b")
_MODEL = re.compile(r"\b(?:series|type|model|sr)\b[\s.:#-]*([a-z0-9])[-/. ]?([0-9a-z]{3})\b")
_GRADE = re.compile(r"(?<![a-z0-9])([a-z]{2,3})[-/. ]?(\d[0-9a-z]{2,4})\b")
_CORES = re.compile(r"\b(\d+|" + "|".join(lex.CORE_WORDS) + r")[\s-]*cores?\b")
_ORDER = re.compile(r"\b(?:qty|quantity|required|reqd)\b")
_STATEMENT = re.compile(r"\b(?:(?:order|total|required|reqd)\s+)?(?:qty|quantity)(?:\s+(?:required|reqd))?[\s.:=-]*\+?[\d.,]+\s*[a-z.]*\d?|\+?[\d.,]+\s*[a-z.]+\d?(?:\s+(?:metre|nos))?\s+(?:required|reqd)\b")
_HIDDEN = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
_WORDS = re.compile(r"[a-z][a-z/]*")
_ONLY_MODEL = re.compile(r"(?:series|type|model|sr)[\s.:#-]+([a-z])[-/. ]?(\d{3})", re.ASCII)
_DIGITS = str.maketrans("oqdilzsb", "00011258")
_LETTERS = str.maketrans("015823", "oisbze")


def seed_phrases() -> dict[str, tuple[str, str]]:
    """The trade vocabulary as phrase -> (slot, value)."""
    groups = (("kind", lex.KINDS), ("form", lex.FORMS), ("finish", lex.FINISHES), ("sheath", lex.SHEATHS))
    return {v: (slot, k) for slot, group in groups for k, variants in group.items() for v in variants}


def dictionary(mined: dict[str, tuple[str, str]], seed: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Mined phrases and, where they say nothing, seed phrases; a mined value is named after the seed phrases among its wordings, so that both mean one value."""
    named: dict[tuple[str, str], dict[tuple[str, str], int]] = {}
    for phrase, value in mined.items():
        if phrase in seed:
            votes = named.setdefault(value, {})
            votes[seed[phrase]] = votes.get(seed[phrase], 0) + 1
    best = {value: max(sorted(votes), key=votes.get) for value, votes in named.items()}
    return {p: seed.get(p) or best.get(v, v) for p, v in mined.items()} | {p: v for p, v in seed.items() if p not in mined}


def segments(text: str) -> list[str]:
    """Fields of a listing, split at commas, semicolons, bars and spaced dashes. A text without such marks is one field, less its foreign words."""
    return [p for p in map(_bare, _fields(text)) if p]


def _fields(text: str) -> list[str]:
    parts = _STRONG.split(text)
    if len(parts) < 3:
        parts = [text if text.isascii() else " ".join(w for w in text.split() if w.isascii())]
    return parts


def _bare(field: str) -> str:
    return _SPACE.sub(" ", field).strip(" .:!()\"'•–-*")


class ListingParser:
    """Turns listing texts into slot dictionaries. ``phrases``: the dictionary, phrase -> (slot, value), slot ``kind`` for nouns of items."""

    def __init__(self, grades: Iterable[str], phrases: dict[str, tuple[str, str]], memo: int = 100_000):
        import ahocorasick

        self.grades = {g.lower() for g in grades}
        self.exact = phrases
        self.automaton = ahocorasick.Automaton()
        for phrase, hit in self.exact.items():
            self.automaton.add_word(phrase, (len(phrase), hit))
        if phrases:
            self.automaton.make_automaton()
        self.kinds = [(v, frozenset(v)) for v in sorted(v for v, (slot, _) in phrases.items() if slot == "kind" and len(v) > 5)]
        self.memo: dict[str, tuple[str, list[tuple[str, str]]]] = {}  # by field as written: the bare field and what it states
        self.runs: dict[str, tuple[float, str | None]] = {}
        self.limit = memo

    def _near(self, run: str) -> tuple[float, str | None]:
        """(similarity, noun phrase) of the known phrase nearest to a run of words; remembered, as marketing words recur."""
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= self.limit:
                self.runs.clear()
            letters, n = set(run), len(run)
            like = [k for k, own in self.kinds if abs(len(k) - n) <= 4 and len(own ^ letters) <= 4]
            near = difflib.get_close_matches(run, like, n=1, cutoff=0.84)
            found = self.runs[run] = (difflib.SequenceMatcher(None, run, near[0]).ratio(), near[0]) if near else (0.0, None)
        return found

    def _typo(self, s: str) -> tuple[str, str] | None:
        """A mistyped noun phrase: the nearest known one among the text's runs of one to three words, where near enough."""
        words = _WORDS.findall(s)
        runs = (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
        ratio, near = max((self._near(r) for r in runs if len(r) > 5), key=lambda x: x[0], default=(0.0, None))
        return ("kind", self.exact[near][1]) if near and ratio > 0.84 else None

    def _field(self, field: str) -> tuple[str, list[tuple[str, str]]]:
        """The bare field and what it states; remembered but for series codes alone, which hardly recur and read fast."""
        s = _bare(field)
        m = _ONLY_MODEL.fullmatch(s)
        if m and s not in self.exact:
            return s, [("model", m[1] + m[2])]
        if len(self.memo) >= self.limit:
            self.memo.clear()
        known = self.memo.get(s)
        if known is None:
            known = self.memo[s] = (s, self._segment(s) if s else [])
        self.memo[field] = known
        return known

    def _segment(self, s: str) -> list[tuple[str, str]]:
        hit = self.exact.get(s)
        if hit:
            return [hit]
        if not s.isascii() or _ORDER.search(s):
            return []
        out: list[tuple[str, str]] = []
        m = _MODEL.search(s)
        if m:
            digits = m[2].translate(_DIGITS)
            if digits.isdigit() and (m.end() - m.start() == len(s) or any(c.isdigit() for c in m[2])):
                out.append(("model", m[1].translate(_LETTERS) + digits))
                s = s[: m.start()] + " " + s[m.end() :]
        for m in _GRADE.finditer(s):
            token = m[1] + m[2]
            if token in self.grades:
                out.append(("grade", token))
                s = s[: m.start()] + " " + s[m.end() :]
                break
        m = _CORES.search(s)
        if m:
            out.append(("cores", str(lex.CORE_WORDS.get(m[1], m[1]))))
        for m in _MEASURE.finditer(s):
            dimension, factor = lex.ITEM_UNITS[m[2]]
            out.append((dimension, str(round(float(m[1].replace(",", "")) * factor))))
        hits = []
        for end, (n, hit) in self.automaton.iter(s) if self.exact else ():
            start = end - n + 1
            if not ((start and s[start - 1].isalnum()) or (end + 1 < len(s) and s[end + 1].isalnum())):
                hits.append((-n, start, end, hit))
        out.extend(hit for *_, hit in self._consistent(hits))
        return out

    @staticmethod
    def _consistent(hits: list) -> list:
        """The longest matches that don't overlap, in the order of the text."""
        kept: list = []
        for hit in sorted(hits):
            if all(hit[2] < k[1] or hit[1] > k[2] for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda k: k[1])

    def parse(self, text: str | None) -> dict[str, str]:
        """Slots of a listing; null and blank texts give none. A slot named twice keeps its first value."""
        if not text:
            return {}
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text).translate(_HIDDEN)
        slots: dict[str, str] = {}
        odd: list[str] = []
        text = text.lower()
        if ("qty" in text or "quantity" in text or "req" in text) and _ORDER.search(text):
            text = _STATEMENT.sub(" ", text)  # the ordered quantity is no measure of the item
        fields = _fields(text)
        for field in fields:
            s, found = self.memo.get(field) or self._field(field)
            for slot, value in found:
                if slot not in slots:
                    slots[slot] = value
            if s and not found:
                odd.append(s)
        if "kind" not in slots and ("model" in slots or "grade" in slots):
            near = self._typo(" , ".join(odd or filter(None, map(_bare, fields))))
            if near:
                slots[near[0]] = near[1]
        return slots
