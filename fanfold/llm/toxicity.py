"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding lower-cases, undoes homoglyphs and digit substitutions, and leaves words of letters separated by single spaces. The
lexicon holds whole words and beginnings of words (inflected and compound forms) whose share of toxic training texts is
high; an entry's weight is its smoothed log odds. Exception phrases are word pairs around an entry that training shows to
be harmless, and those given by the caller; an entry inside one does not count. A text's weight and weight per word
go through a logistic curve fitted to the training labels.

Training reads at most ``SAMPLE`` labelled texts (the first by a hash of the id), which bounds every broadcast, and the
lexicon holds at most ``ENTRIES``. Scores use nothing but the text: whole texts are read where they are scanned and nothing
but the training sample is shuffled.

Defined cases: NULL, empty and wordless texts have the score of a text without a match. Labels that are NULL are not
learned from. Without both labels in training, or without entries, every score is the smoothed base rate. Rows that repeat
give rows that repeat; repeated labels count repeatedly. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import as_texts, id_and_text, per_batch

SAMPLE = 20_000  # labelled texts to learn from
ENTRIES = 5_000
SHORTEST, LONGEST = 4, 8  # letters of a beginning of a word
LEAST_TEXTS = 3  # toxic training texts an entry needs
LEAST_ODDS = 2.0  # natural log odds an entry needs
LEAST_EVIDENCE = 10.0  # natural log likelihood by which an entry beats the base rate
RIDGE = 1e-3

# Characters that look like letters, by alphabet, and digits and signs that stand for letters.
_LOOKALIKES = {"аеорсухіјѕһԁ": "aeopcyxijshd", "οαρκν": "oapkv", "ıɡɑ": "iga", "013457@$€£!|": "oieastaseeil"}
FOLDED = {ord(a): b for theirs, ours in _LOOKALIKES.items() for a, b in zip(theirs, ours, strict=True)}
FOLDED |= {0xFF21 + i: chr(0x61 + i) for i in range(26)} | {0xFF41 + i: chr(0x61 + i) for i in range(26)}
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"(?<=\w)[0-9@$€£!|](?=\w)|(?<!\w)[0-9@$€£](?=[^\W\d_]{2})")
_FOREIGN = re.compile("[" + "".join(chr(c) for c in FOLDED if c > 0x7F) + "]")


def fold(text: str) -> str:
    """Words of lower-case letters, each with a space on both sides."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = _FOREIGN.sub(lambda m: FOLDED[ord(m[0])], text)
    # A sign counts as a letter inside a word or at its beginning, not after it.
    text = _SIGNS.sub(lambda m: FOLDED.get(ord(m[0]), m[0]), text)
    return " " + " ".join(_WORD.findall(text)) + " "


def features(folded: str) -> set[str]:
    """Candidates for entries: whole words of any length and beginnings of words."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


class Lexicon:
    """Entries with weights, exception phrases, and the logistic curve."""

    def __init__(self, entries: dict[str, float], exceptions: Sequence[str] = (), curve: Sequence[float] = (0.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.curve = entries, list(exceptions), list(curve)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                made.add_word(entry, (weight, len(entry), False))
            for phrase in map(fold, self.exceptions):  # an entry that is an exception is none
                if phrase.strip():
                    made.add_word(phrase, (0.0, len(phrase), True))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(begin, weight) of the heaviest entry at every word that has one, outside exception phrases."""
        if not self.entries:
            return []
        best: dict[int, float] = {}
        excepted = []
        for end, (weight, length, is_exception) in self.automaton().iter(folded):
            begin = end + 1 - length
            if is_exception:
                excepted.append((begin, end))
            else:
                best[begin] = max(best.get(begin, 0.0), weight)
        found = sorted(best.items())
        if not excepted:
            return found
        # Both lists ascend: one pass over the phrases that begin before an entry tells how far they reach.
        excepted.sort()
        out, at, reach = [], 0, 0
        for begin, weight in found:
            while at < len(excepted) and excepted[at][0] <= begin:
                reach = max(reach, excepted[at][1])
                at += 1
            if begin >= reach:
                out.append((begin, weight))
        return out

    def measures(self, text: str) -> tuple[float, float]:
        """Weight, and weight per hundred words, both damped by log(1 + x)."""
        folded = fold(text)
        weight = sum(w for _, w in self.matches(folded))
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(weight)), float(np.log1p(100 * weight / words))

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.measures(text)
        return float(1 / (1 + np.exp(-(a + b * x + c * y))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """Text and label of the training sample: the labels are cut first, so they may be broadcast."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(size)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label")


def _counted(sample: DataFrame, kind, values: str) -> DataFrame:
    """Toxic and other texts by feature, added up in every task before they are shuffled. ``kind(folded)`` gives features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list({*counts[0], *counts[1]})
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in reversed(counts))],
                names=["feature", "toxic", "other"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, label in zip(as_texts(batch["text"]), batch["label"].to_pylist()):
                counts[label == 1].update(kind(fold(text)))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        yield flush()

    return sample.mapInArrow(run, "feature string, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(values)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          exceptions: Sequence[str] = (), size: int = SAMPLE) -> Lexicon:
    sample = _sample(docs, labels, id_col, text_col, label_col, size)
    totals = {r.label == 1: r["count"] for r in sample.groupBy((F.col("label") == 1).cast("int").alias("label")).count().collect()}
    toxic, other = totals.get(True, 0), totals.get(False, 0)
    base = float(np.log((toxic + 0.5) / (other + 0.5)))
    if not toxic or not other:
        return Lexicon({}, exceptions, (base, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    rate, seen = toxic / (toxic + other), F.col("toxic") + F.col("other")
    evidence = (F.col("toxic") * F.log(F.col("toxic") / (seen * rate))
                + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (seen * (1 - rate)))).otherwise(0.0))
    found = _counted(sample, features, f"toxic >= {LEAST_TEXTS}").withColumn("odds", odds).where(
        (F.col("odds") >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE))
    rows = found.orderBy(F.desc(F.col("toxic") * F.col("odds")), "feature").limit(ENTRIES).collect()
    entries: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.feature), r.feature)):
        # A longer form adds nothing where a beginning of it is as clear.
        shorter = [entries.get(r.feature[:k]) for k in range(SHORTEST + 1, len(r.feature))]
        if all(w is None or w < r.odds - 0.5 for w in shorter):
            entries[r.feature] = r.odds
    lexicon = Lexicon(entries, exceptions)

    def pairs(folded: str) -> set[str]:
        words, out, starts = folded.split(), set(), {b for b, _ in lexicon.matches(folded)}
        at = 0
        for i, word in enumerate(words):
            if at in starts:
                out.update(" ".join(words[j:j + 2]) for j in (i - 1, i) if 0 <= j and j + 1 < len(words))
            at += len(word) + 1
        return out

    harmless = _counted(sample, pairs, f"other >= {LEAST_TEXTS}").where(
        F.log((F.col("other") + 0.5) / (other + 1)) - F.log((F.col("toxic") + 0.5) / (toxic + 1)) >= LEAST_ODDS)
    lexicon = Lexicon(entries, [*exceptions, *(r.feature for r in harmless.orderBy(F.desc("other"), "feature").limit(ENTRIES).collect())])

    def start():
        def work(batch: pa.RecordBatch):
            found = [lexicon.measures(t) for t in as_texts(batch["text"])]
            return [f[0] for f in found], [f[1] for f in found], [float(x == 1) for x in batch["label"].to_pylist()]

        return work

    # Three numbers for each text of the bounded sample.
    table = per_batch(sample, "x double, y double, label double", start).toPandas().to_numpy()
    return Lexicon(lexicon.entries, lexicon.exceptions, logistic(table[:, :2], table[:, 2]))


def logistic(measures: np.ndarray, labels: np.ndarray) -> list[float]:
    """Newton's method with a small ridge, halving steps that overshoot."""
    x = np.column_stack((np.ones(len(measures)), measures))
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - labels @ z + RIDGE * len(x) * (w[1:] @ w[1:]) / 2

    penalty = np.diag([0.0] + [RIDGE * len(x)] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - penalty @ w)
        scale = 1.0
        while scale > 1e-6 and loss(w + scale * step) > loss(w):
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        def work(batch: pa.RecordBatch):
            return batch["doc_id"], [shared.value.score(t) for t in as_texts(batch["text"])]

        return work

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, score double", start)
