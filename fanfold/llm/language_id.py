"""Language identification of whole and mixed texts: scripts, per-word scores, and Viterbi with a switching penalty.

From labelled texts the operator learns, per language, smoothed log probabilities of hashed character n-grams
of words, and the scripts the language is written in. A word's score in a language is the sum over its n-grams; languages
not written in the word's script are no candidates for it. Viterbi over the words of a text, with a penalty
for every switch, labels spans; the language with the most letters is the text's.

Training reads about ``PER_LANGUAGE`` texts of each language (by a hash of id and text) of the ``LANGUAGES`` most frequent
ones, so the expected sample is bounded by the product of both; n-grams are hashed into ``BUCKETS`` per order, so the model is bounded too
and may be broadcast. Prediction uses nothing but the text; whole texts are read where they are scanned, and nothing
but the training sample is shuffled.

Defined cases: NULL, empty and letterless texts are ``und`` with score 0, and so is every text where nothing was
learned. NULL languages are not learned from. Ties go to the language that sorts first. Rows that repeat give rows that
repeat. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanfold.llm.common import as_texts, drop_rows, free_names, give_back, id_and_text, per_batch, text_key

UNKNOWN = "und"
PER_LANGUAGE = 1_000  # expected training texts of a language
LANGUAGES = 500  # that are learned, at most
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16  # per order
SMOOTHING = 0.5
SWITCH_PENALTY = 24.0  # natural log units: about what three clear words weigh
SCRIPT_SHARE = 0.02  # of a language's letters, for a script to be its own
BATCH_CELLS = 500_000  # characters times languages worked on at once
TRAINING_CHARACTERS = 2_000_000  # of a text that are counted at once

# First code points of ranges and the script they begin, by code point.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Burmese"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"),
    (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and the number of its script."""
    letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    scripts = np.zeros(sys.maxunicode + 1, np.uint8)
    for first, name in SCRIPTS:
        scripts[first:] = SCRIPT_NAMES.index(name)
    return letters, scripts


class Words:
    """The words (runs of letters) of many texts at once, and the n-gram buckets of their letters."""

    def __init__(self, texts: list[str]):
        letters, scripts = _tables()
        # A text's characters stay in place under lower(), or it is left as it is: spans count source characters.
        lowered = [low if len(low := t.lower()) == len(t) else t for t in texts]
        codes = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[codes]
        self.codes = np.where(is_letter, codes, 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], is_letter, [False])).view(np.int8)))
        self.begins, self.ends = edges[::2], edges[1::2]
        self.lengths = self.ends - self.begins
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.text_begins = offsets[:-1]
        self.bounds = np.searchsorted(self.begins, offsets)  # word numbers of a text: bounds[i] to bounds[i + 1]
        self.letters = np.flatnonzero(is_letter)
        self.first_letter = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.scripts = scripts[codes[self.begins]] if len(self.begins) else np.zeros(0, np.uint8)

    def buckets(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """(orders, letters): the n-grams that end after a letter, of those from number ``first`` to ``last``; they begin at the
        earliest one place before the word."""
        own = self.letters[first:last]
        if not len(own):
            return np.zeros((len(ORDERS), 0), np.int64)
        lead, low = max(ORDERS), int(own[0])
        part = self.codes[max(0, low - lead):int(own[-1]) + 2].astype(np.uint64)
        padded = np.concatenate((np.zeros(max(0, lead - low), np.uint64), part, np.zeros(1, np.uint64)))
        at = own - low + lead
        a, b = np.searchsorted(self.first_letter, [first, first + len(own) - 1], "right") - 1
        sizes = np.diff(np.concatenate(([first], self.first_letter[a + 1:b + 1], [first + len(own)])))
        room = own - np.repeat(self.begins[a:b + 1], sizes) + 1  # letters of the word before this one's successor
        out = np.empty((len(ORDERS), len(at)), np.int64)
        for i, order in enumerate(ORDERS):
            hashed = np.full(len(at), order, np.uint64)
            # Ends one after the letter, so a word's end (0) is part of its last n-grams.
            for back in range(order - 2, -2, -1):
                code = padded[at - back] * (room >= back)
                hashed = (hashed ^ code) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            out[i] = (hashed % np.uint64(BUCKETS)).astype(np.int64) + i * BUCKETS
        return out


class Model:
    """Log probabilities by bucket and language, and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_letters: np.ndarray):
        """``counts``: (orders * buckets, languages); ``script_letters``: (scripts, languages)."""
        self.languages = languages
        logs = np.log(counts + SMOOTHING)
        for i in range(len(ORDERS)):
            part = slice(i * BUCKETS, (i + 1) * BUCKETS)
            logs[part] -= np.log(counts[part].sum(0) + SMOOTHING * BUCKETS)
        self.logs = (logs / len(ORDERS)).astype(np.float32)
        own = script_letters >= SCRIPT_SHARE * np.maximum(script_letters.sum(0), 1)
        # A script that no language claims leaves every language a candidate.
        self.candidates = own | ~own.any(1, keepdims=True)

    def _letter_scores(self, words: Words, first: int, last: int) -> np.ndarray:
        buckets = words.buckets(first, last)
        letters = np.zeros((buckets.shape[1], len(self.languages)), np.float32)
        for own in buckets:
            letters += self.logs[own]
        return letters

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.begins):
            return np.zeros((0, len(self.languages)), np.float32)
        most = max(1000, BATCH_CELLS // len(self.languages))
        if len(words.letters) <= most:
            scores = np.add.reduceat(self._letter_scores(words, 0, most), words.first_letter, axis=0)
        else:  # a long text: a block of letters at a time, so that memory by language grows with its words only
            scores = np.zeros((len(words.begins), len(self.languages)), np.float32)
            for at in range(0, len(words.letters), most):
                letters = self._letter_scores(words, at, at + most)
                a, b = np.searchsorted(words.first_letter, [at, at + len(letters) - 1], "right") - 1
                scores[a:b + 1] += np.add.reduceat(letters, np.maximum(words.first_letter[a:b + 1] - at, 0), axis=0)
        ruled_out = ~self.candidates[words.scripts]
        return np.where(ruled_out, scores.min(1, keepdims=True) - 2 * SWITCH_PENALTY, scores)

    def label(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, share of the letters in it, spans) of each text; a span is (language, begin, end)."""
        if not self.languages:
            yield from ((UNKNOWN, 0.0, []) for _ in texts)
            return
        most, at = max(1000, BATCH_CELLS // len(self.languages)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= most):
                size += len(texts[end])
                end += 1
            yield from self._label(Words(texts[at:end]))
            at = end

    def _label(self, words: Words) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        scores = self.word_scores(words).astype(np.float64)
        for text, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
            if a == b:
                yield UNKNOWN, 0.0, []
                continue
            path = viterbi(scores[a:b], SWITCH_PENALTY)
            letters = np.bincount(path, words.lengths[a:b], len(self.languages))
            best = int(letters.argmax())
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [b - a]))
            origin = words.text_begins[text]
            spans = [(self.languages[path[x]], int(words.begins[a + x] - origin), int(words.ends[a + y - 1] - origin))
                     for x, y in zip(cuts[:-1], cuts[1:])]
            yield self.languages[best], float(letters[best] / letters.sum()), spans


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path over (words, languages), where a switch costs ``penalty``.

    If no stretch of words gains more than half a penalty by any other language, the best constant path is the best of
    all: k stretches of other languages take at least k - 1 switches, and k if the path has the best language at all.
    """
    best = int(scores.sum(0).argmax())
    gains = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum.accumulate(np.vstack((np.zeros((1, scores.shape[1])), gains[:-1])), axis=0)
    if (gains - low).max() <= penalty / 2:
        return np.full(len(scores), best)
    came = np.empty(scores.shape, np.int32)
    own = np.arange(scores.shape[1])
    total = scores[0].copy()
    came[0] = own
    for i in range(1, len(scores)):
        top = int(total.argmax())
        switch = total[top] - penalty > total
        came[i] = np.where(switch, top, own)
        total = np.where(switch, total[top] - penalty, total) + scores[i]
    path = np.empty(len(scores), np.int64)
    path[-1] = total.argmax()
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def reject_unknown(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the texts whose language is unknown; if nothing was learned, without those that have no letter.

    Only ids and texts go through Python; the rejected rows are then dropped by their keys.
    """
    if not model.languages:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", text_key("text"))
    rejected = predict(rows, model, keep=["doc_id", "text_key"]).where(F.col("lang_pred") == UNKNOWN)
    return drop_rows(docs, rejected, id_col, text_col)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the ``docs`` with a language, about ``per_language`` texts of each."""
    lang = F.col(lang_col).cast("string")
    sizes = {r.lang: r["count"] for r in docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).count()
             .orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, rate double")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1 << 30)) / (1 << 30)
    # At most LANGUAGES rows are broadcast; the hash takes its share of each language where the texts are read.
    sample = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), place.alias("place")).join(
        F.broadcast(rates), "lang").where(F.col("place") < F.col("rate")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        size = len(ORDERS) * BUCKETS
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), as_texts(batch["text"])):
                for at in range(0, len(text), TRAINING_CHARACTERS):
                    words = Words([text[at:at + TRAINING_CHARACTERS]])
                    own = counts.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES), np.int64))
                    own[:size] += np.bincount(words.buckets().ravel(), minlength=size)
                    own[size:] += np.bincount(words.scripts, words.lengths, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()),
                                              pa.array(own[some], pa.int64())], names=["lang", "feature", "n"])
        give_back()

    rows = sample.mapInArrow(counted, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # At most (orders * buckets + scripts) rows for a language.
    found = rows.toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((len(ORDERS) * BUCKETS + len(SCRIPT_NAMES), len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    table[found["feature"].to_numpy(), [column[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return Model(languages, table[:len(ORDERS) * BUCKETS], table[len(ORDERS) * BUCKETS:])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            spans: bool = False, names: Sequence[str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with the language, its share of the letters and, if asked for, the spans of the
    source text, called ``names``."""
    kept = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, = free_names(docs, "text_to_label")
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias(text))
    kind = rows.drop(text).schema.add(names[0], "string").add(names[1], "double")
    if spans:
        kind = kind.add(names[2], T._parse_datatype_string("array<struct<lang:string,begin:int,end:int>>"))

    def start():
        def work(batch: pa.RecordBatch):
            found = list(shared.value.label(as_texts(batch[text])))
            columns = [[f[0] for f in found], [f[1] for f in found]]
            if spans:
                columns.append([[{"lang": lang, "begin": a, "end": b} for lang, a, b in f[2]] for f in found])
            return *(batch[c] for c in kept), *columns

        return work

    return per_batch(rows, kind, start)
