"""Personal data, also where it is disguised, with spans in the characters of the source text.

The plain patterns are found in the text itself. A chain of small transducers then rewrites the text: homoglyphs and
full-width forms to ASCII, spelled digits to digits, and spelled or bracketed "at", "dot" and "plus" to their signs, where their
neighbours make that reading likely. Each step carries, for every character it writes, where in the source it came
from, so the same detectors run on the rewritten text and their spans are mapped back. A span found there is
added unless it lies within a plain one of its kind.

Only texts that hold some disguise are rewritten; detectors take time linear in the text. Texts are read whole, where they
are scanned; nothing is shuffled.

Defined cases: NULL text is empty, and an empty text has no spans. Rows that repeat give rows that repeat. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fanfold.llm.common import as_texts, id_and_text, per_batch

KINDS = ("email", "ip", "card", "phone")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ signs: what stands before one is the longest run of allowed characters."""
    least, at = 0, text.find("@")
    while at >= 0:
        begin = least + len(text[least:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        least = domain.end() if domain else at + 1
        at = text.find("@", least)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Characters that look like ASCII ones, by alphabet.
_LOOKALIKES = {
    "аеорсухіјѕһԁԛԝ": "aeopcyxijshdqw", "АВЕКМНОРСТУХІЈЅ": "ABEKMHOPCTYXIJS", "οινυαρκχ": "oivuapkx", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ıɡɑℓ": "igal", "﹫": "@", "․。｡﹒": "....", "‐‑‒–—−﹣": "-------", "   　": "    ", "﹢": "+",
}
HOMOGLYPHS = {ord(a): b for theirs, ours in _LOOKALIKES.items() for a, b in zip(theirs, ours, strict=True)}
HOMOGLYPHS |= {0xFF00 + c: chr(0x20 + c) for c in range(1, 0x5F)}  # full-width forms
HOMOGLYPHS |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
               for d in range(10)}  # decimal digits of other scripts and mathematical ones
_HOMOGLYPH = re.compile("[" + "".join(re.escape(chr(c)) for c in HOMOGLYPHS) + "]")

# The words for digits.
SPELLED = {w: str(d) for words in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for d, w in enumerate(words.split())} | {"zwo": "2"}
_NUMERAL = r"(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9])"
_GAP = r"[ \t,.-]{1,3}"
# Three neighbours make words numerals: shorter runs are ordinary prose.
_NUMERALS = re.compile(rf"(?<!\w){_NUMERAL}(?:(?:{_GAP}(?:(?:dot|point|punkt|punto){_GAP})?){_NUMERAL}){{2,}}(?!\w)", re.I)
_ONE_NUMERAL = re.compile(rf"(?<!\w)(?:(?P<dot>dot|point|punkt|punto)|(?P<digit>{_NUMERAL}))(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ \t]{1,3}(?=[0-9(])", re.I)

_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,3}"
_BRACKETED = re.compile(rf"(?<=\w){_OPEN}(?:(?P<at>at|@|arroba|ät)|(?P<dot>dot|\.|punkt|punto|point)){_SHUT}(?=\w)", re.I)
_HOST = r"[a-z0-9-]+"
# The top-level domains that make "at … dot …" in prose an address; countries whose code is no common word.
_TOP = ("com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|de|at|ch|fr|be|es|mx|ar|it|nl|pt|uk|us|ca|au|nz|ie|pl|cz|sk|hu|ro|bg|gr|"
        "dk|se|fi|lt|lv|ee|hr|si|rs|ua|ru|tr|il|za|ke|ng|eg|br|cl|co|pe|jp|kr|cn|tw|hk|sg|th|vn|id|ph|pk")
# Bare words count only in the full shape: name at host dot top-level domain.
# The name is looked for backwards from its "at".
_BARE = re.compile(rf"(?P<at>[ \t]{{1,3}}at[ \t]{{1,3}}|@){_HOST}"
                   rf"(?P<rest>(?:(?:[ \t]{{1,3}}dot[ \t]{{1,3}}|\.){_HOST}){{0,3}}?[ \t]{{1,3}}dot[ \t]{{1,3}}(?:{_TOP}))(?![\w@])", re.I)
_WORD_DOT = re.compile(r"[ \t]{1,3}dot[ \t]{1,3}", re.I)
_HINT = re.compile(r"[\[({<][ \t]{0,2}(?:at|dot|@|\.|arroba|ät|punkt|punto|point)[ \t]{0,2}[\])}>]|[ \t]dot[ \t]", re.I)
# What the steps of normalise look for after homoglyphs; the hint holds for brackets and for bare words.
_GATES = (_HINT, _NUMERALS, _PLUS)


_NAME_BEGIN = re.compile(r"(?<![\w@.])[a-z0-9]", re.I)


def bare_addresses(text: str) -> Iterator[re.Match]:
    """The _BARE matches that a name stands before; names of different matches share no character, so time is linear."""
    least = at = 0
    while m := _BARE.search(text, at):
        begin = least + len(text[least:m.start()].rstrip(_LOCAL))
        if _NAME_BEGIN.search(text, begin, m.start()):
            yield m
            least = at = m.end()
        else:
            least = at = m.start() + 1


class Mapped:
    """A rewritten text and, for each of its characters, where its source begins and ends (as 32-bit numbers)."""

    def __init__(self, text: str):
        self.text, self.begins, self.ends = text, array("i", range(len(text))), array("i", range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ascending disjoint ranges; every character written stands for its whole range."""
        if not edits:
            return
        text, begins, ends, at = [], array("i"), array("i"), 0
        for begin, end, new in edits:
            text += [self.text[at:begin], new]
            begins += self.begins[at:begin] + self.begins[begin:begin + 1] * len(new)
            ends += self.ends[at:begin] + self.ends[end - 1:end] * len(new)
            at = end
        self.text = "".join([*text, self.text[at:]])
        begins += self.begins[at:]
        ends += self.ends[at:]
        self.begins, self.ends = begins, ends

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return self.begins[begin], self.ends[end - 1]


def normalise(text: str) -> Mapped:
    """The chain of transducers."""
    mapped = Mapped(text)
    if not text.isascii():
        mapped.rewrite([(m.start(), m.end(), HOMOGLYPHS[ord(m[0])]) for m in _HOMOGLYPH.finditer(mapped.text)])
    edits = []
    for run in _NUMERALS.finditer(mapped.text):
        if run[0].replace(" ", "").replace("-", "").replace(".", "").isdigit():
            continue  # digits as they are
        at = run.start()
        for m in _ONE_NUMERAL.finditer(mapped.text, run.start(), run.end()):
            # The gap before a numeral goes: digits stand side by side.
            edits.append((at, m.end(), "." if m["dot"] else SPELLED.get(m["digit"].lower(), m["digit"])))
            at = m.end()
    mapped.rewrite(edits)
    mapped.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(mapped.text)])
    mapped.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(mapped.text)])
    if _WORD_DOT.search(mapped.text):
        edits = []
        for m in bare_addresses(mapped.text):
            edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in _WORD_DOT.finditer(mapped.text, *m.span("rest"))]
        mapped.rewrite(edits)
    return mapped


def is_disguised(text: str) -> bool:
    """Whether rewriting could change anything."""
    return bool((not text.isascii() and _HOMOGLYPH.search(text)) or any(gate.search(text) for gate in _GATES))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(DETECTORS[kind](text)) for kind in KINDS}


def all_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """The plain spans and those that only the rewritten text shows, ascending by kind."""
    if not is_disguised(text):
        return base
    mapped, out = normalise(text), {}
    for kind in KINDS:
        found = [mapped.source(*span) for span in DETECTORS[kind](mapped.text)]
        begins = [b for b, _ in base[kind]]
        ends = [e for _, e in base[kind]]
        # Plain spans are disjoint and ascending: only the last that begins no later can hold a found one.
        added = [(b, e) for b, e in found if not ((at := bisect_right(begins, b)) and ends[at - 1] >= e)]
        out[kind] = sorted({*base[kind], *added})
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for kind in KINDS for b, e in spans[kind])


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    spans = sorted((b, -e, kind) for kind, found in all_spans(text, base_spans(text)).items() for b, e in found)
    out, at = [], 0
    for begin, end, kind in spans:
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of plain spans by kind, base_sha256, spans."""

    def start():
        def work(batch: pa.RecordBatch):
            counts, hashes, spans = {kind: [] for kind in KINDS}, [], []
            for text in as_texts(batch["text"]):
                base = base_spans(text)
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(text, base)))
            return batch["doc_id"], *counts.values(), hashes, spans

        return work

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return per_batch(id_and_text(docs, id_col, text_col), f"doc_id long, {counts}, base_sha256 string, spans string", start)
