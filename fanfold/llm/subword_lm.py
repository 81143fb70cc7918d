"""Document probabilities by a subword lattice: the sum over all segmentations into the pieces of a vocabulary.

A text is its words, each with the word mark before it, and an end. A word is a sequence of pieces of an existing vocabulary,
which hold the mark only at their beginning; its probability is the sum over all its segmentations, by a forward
recursion in log space over the lattice of pieces. The vocabulary's own scores (ranks) are the first weights, and a few
rounds of expectation maximisation over the distinct words of the training texts, weighted by their counts, adapt them.
Characters that no piece covers are spelled in bytes. Every training word is an arc of the lattice as a whole as well.

Weights are kept per class of training texts (their language); a text's probability sums over classes too, so no class is
needed to score it. All this is one proper distribution over texts as sequences of words.

Word counts are added up in every task, then by word, over all texts; only training texts count towards the model. Every
distinct word is scored once, in the table of words. ``FREQUENT`` decides only how a word's scores reach the texts: those of
the most frequent words are broadcast, those of any other word are joined to the texts that hold it. Scores do not depend
on it. Piece weights have the vocabulary's size times the number of classes; classes only say
which texts share weights, so classes beyond ``CLASSES`` lose no text and no count: they are counted and scored as one.

Defined cases: NULL text is empty, and an empty text is its end alone. A NULL class is a class. Rows that repeat are
scored each. Without training texts N and V are 0 and every piece keeps its first weight. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import as_bytes
from fanfold.llm.token_counts import MARK, read_vocabulary
from fanfold.session import materialize

FREQUENT = 150_000  # words that are broadcast, at most; the others are joined
ROUNDS = 2  # of expectation maximisation
CLASSES = 8  # at most; the rarer ones share the last
DISCOUNT = 0.6  # of the count of a training word by class, for its segmentations and words that have no arc
ESCAPE = 0.5  # words without an arc that every class is given
SMOOTHING = 0.1  # expected uses that every piece is given
COUNTED = 300_000  # distinct words a task counts before it hands them on
BLOCK_CELLS = 600_000  # letters times classes worked on at once
END = ""  # the end token, which no word equals

_BASE, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at white space."""
    return text.lower().split()


class Lattice:
    """The pieces by hash, and forward and backward sums over many words and classes at once.

    Weights are natural logs, (pieces + 2, classes): after the pieces come one byte's weight and that of no piece at all.
    """

    def __init__(self, pieces: list[str]):
        self.pieces, self.n = pieces, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        # Open addressing with as many probes as the fullest slot needs.
        self.table = np.full((1, _SLOTS), -1, np.int32)
        for i, slot in enumerate((hashes >> np.uint64(44)).astype(int).tolist()):
            row = 0
            while row < len(self.table) and self.table[row, slot] >= 0:
                row += 1
            if row == len(self.table):
                self.table = np.vstack((self.table, np.full((1, _SLOTS), -1, np.int32)))
            self.table[row, slot] = i
        self.hashes = np.append(hashes, np.uint64(0))
        self.sizes = np.array([len(p) for p in pieces] + [0])

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        return h

    def first_uses(self, scores: list[float]) -> np.ndarray:
        """Zipf's law over the ranks the vocabulary's scores give."""
        rank = np.empty(self.n)
        rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(self.n)
        return np.append(1 / (rank + 10), 1e-3)

    def weights(self, uses: np.ndarray) -> np.ndarray:
        """Log probabilities from uses of pieces and bytes; 256 bytes share theirs."""
        logs = np.log(uses / uses.sum(0))
        logs[self.n] -= math.log(256)
        return np.concatenate((logs, np.full((1, *logs.shape[1:]), -np.inf)))

    def _arcs(self, words: list[str]):
        """Begins and lengths of the words in one row of characters, bytes of each character that no piece spells, and
        for every length the piece that ends at each character (``n + 1``: none), or None where there is none at all."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(lengths) - lengths
        plain = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "<u4").astype(np.uint64)
        room = np.arange(len(plain)) - np.repeat(begins, lengths) + 1
        hashed, found = np.zeros(len(plain), np.uint64), []
        for k in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            hashed[1:] = hashed[:-1].copy()
            hashed[0] = 0
            hashed = (hashed + plain + np.uint64(1)) * _BASE
            fits = np.flatnonzero(room >= k)
            own = hashed[fits]
            slots = (own >> np.uint64(44)).astype(np.int64)
            pieces = np.full(len(plain), self.n + 1, np.int32)
            for row in self.table:
                at = row[slots]
                same = np.flatnonzero(at >= 0)
                same = same[(self.hashes[at[same]] == own[same]) & (self.sizes[at[same]] == k)]
                pieces[fits[same]] = at[same]
            found.append(pieces if (pieces <= self.n).any() else None)
        n_bytes = 1 + (plain >= 0x80).astype(np.int64) + (plain >= 0x800) + (plain >= 0x10000)
        spelled = n_bytes if found[0] is None else np.where(found[0] > self.n, n_bytes, 0)
        return begins, lengths, spelled, found

    def _costs(self, weights: np.ndarray, arcs, spelled: np.ndarray, k: int, at: np.ndarray) -> np.ndarray | None:
        """Weights of the arcs of length ``k`` that end at these characters."""
        if k > 1:
            return None if arcs[k - 1] is None else weights[arcs[k - 1][at]]
        cost = weights[arcs[0][at]] if arcs[0] is not None else np.full((len(at), weights.shape[1]), -np.inf, weights.dtype)
        bytes_here = spelled[at]
        if bytes_here.any():
            cost = np.where(bytes_here[:, None] > 0, bytes_here[:, None].astype(weights.dtype) * weights[self.n], cost)
        return cost

    def sums(self, words: list[str], weights: np.ndarray, counts: np.ndarray | None = None):
        """Log probability of every word in every class; with ``counts``, for one class, the expected uses instead."""
        classes = weights.shape[1]
        out, uses = np.empty((len(words), classes)), np.zeros(self.n + 1)
        # Words of like length are worked on together.
        order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
        while at < len(order):
            end, cells = at, 0
            while end < len(order) and (end == at or cells < BLOCK_CELLS):
                cells += (len(words[order[end]]) + 1) * classes
                end += 1
            part = order[at:end]
            out[part] = self._block([words[i] for i in part], weights, None if counts is None else counts[part], uses)
            at = end
        return out if counts is None else uses

    def _block(self, words: list[str], weights: np.ndarray, counts: np.ndarray | None, uses: np.ndarray) -> np.ndarray:
        begins, lengths, spelled, arcs = self._arcs(words)
        ends, none = begins + lengths - 1, np.full((len(spelled), weights.shape[1]), -np.inf, weights.dtype)
        forward = none.copy()  # up to and with a character
        for place in range(int(lengths[-1])):  # words are ascending in length
            live = begins[np.searchsorted(lengths, place, "right"):] + place
            ways = []
            for k in range(1, min(place + 1, len(arcs)) + 1):
                cost = self._costs(weights, arcs, spelled, k, live)
                if cost is not None:
                    ways.append(cost + forward[live - k] if k <= place else cost)
            forward[live] = log_sum(ways)
        result = forward[ends]
        if counts is None:
            return result
        backward = none  # from after a character to the word's end
        backward[ends] = 0.0
        for back in range(1, int(lengths[-1])):
            live = ends[np.searchsorted(lengths, back, "right"):] - back
            ways = []
            for k in range(1, min(back, len(arcs)) + 1):
                cost = self._costs(weights, arcs, spelled, k, live + k)
                if cost is not None:
                    ways.append(cost + backward[live + k])
            backward[live] = log_sum(ways)
        place = np.arange(len(spelled)) - np.repeat(begins, lengths)
        after = (backward - np.repeat(result, lengths, 0))[:, 0] + np.log(np.repeat(counts, lengths))
        for k in range(1, len(arcs) + 1):
            known = arcs[k - 1] is not None and arcs[k - 1] <= self.n
            use = np.flatnonzero(known | (spelled > 0) if k == 1 else known) if arcs[k - 1] is not None or k == 1 else []
            if not len(use):
                continue
            before = np.where(place[use] >= k, forward[np.maximum(use - k, 0), 0], 0.0)
            expected = np.exp(before + self._costs(weights, arcs, spelled, k, use)[:, 0] + after[use])
            if k == 1:
                uses[self.n] += (expected * spelled[use]).sum()
                expected = np.where(spelled[use] > 0, 0.0, expected)
            if arcs[k - 1] is not None:
                uses += np.bincount(np.minimum(arcs[k - 1][use], self.n), expected, self.n + 1)
        return result


def log_sum(ways: list[np.ndarray]) -> np.ndarray:
    top = ways[0]
    for way in ways[1:]:
        top = np.maximum(top, way)
    safe = np.where(np.isfinite(top), top, top.dtype.type(0))
    total = np.zeros_like(safe)
    for way in ways:
        total += np.exp(way - safe)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def classes_of(docs: DataFrame, class_col: str | None, most: int = CLASSES) -> tuple[Column, int]:
    """The number of a text's class, from 0, and how many there are: classes by size, the rarest together."""
    if class_col is None:
        return F.lit(0), 1
    found = docs.groupBy(F.col(class_col).cast("string").alias("c")).count().orderBy(F.desc("count"), "c").limit(most + 1).collect()
    own = found if len(found) <= most else found[:most - 1]
    number = F.lit(min(len(own), most - 1))
    for i, r in enumerate(own):
        number = F.when(F.col(class_col).cast("string").eqNullSafe(F.lit(r.c)), i).otherwise(number)
    return number, max(1, min(len(found), most))


def word_counts(docs: DataFrame, number: Column, classes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, times over all ``docs``, n over those with a class, and n0, n1, … by class, the end among the words; written
    once. ``number`` is the class of a training text, and ``classes`` for any other text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(classes + 1)]

        def flush() -> pa.RecordBatch:
            words = [w for c in counts for w in c]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array([k for k, c in enumerate(counts) for _ in c], pa.int32()),
                 pa.array([n for c in counts for n in c.values()], pa.int64())], names=["word", "class", "k"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, k in zip(as_bytes(batch["text"]), batch["class"].to_pylist()):
                counts[k].update(tokens(text))
                counts[k][END.encode()] += 1
                if sum(map(len, counts)) > COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), number.cast("int").alias("class")).mapInArrow(
        run, "word string, class int, k long")
    by_class = [F.sum(F.when(F.col("class") == i, F.col("k")).otherwise(0)).alias(f"n{i}") for i in range(classes)]
    learned = F.sum(F.when(F.col("class") < classes, F.col("k")).otherwise(0)).alias("n")
    return materialize(rows.groupBy("word").agg(F.sum("k").alias("times"), learned, *by_class))


class Model:
    """Lattice, piece weights by class, and the shares of ends, of words' own arcs, and of classes."""

    def __init__(self, lattice: Lattice, uses: np.ndarray, own: np.ndarray, total: np.ndarray, ends: np.ndarray):
        """``total``: training tokens by class, ``ends`` of them ends; ``own``: discounted counts of all training words."""
        self.lattice, self.pieces = lattice, lattice.weights(uses).astype(np.float32)  # sums of few terms
        end = np.log((ends + 0.5) / (total + 1))
        self.starts = end + np.log((ends + 0.5) / (ends + 0.5).sum())  # of a text: its class and its end
        self.inside = np.log1p(-np.exp(end))  # a token that is no end
        rare = total - ends - own + ESCAPE
        self.rare = np.log(rare / (own + rare))
        self.mass = np.log(own + rare)

    def word_logs(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Log probability of every word by class: its own arc, if its training count gives one, and all segmentations."""
        logs = self.lattice.sums([w.replace(MARK, " ") for w in words], self.pieces) + self.rare
        with np.errstate(divide="ignore"):
            arcs = np.log(np.maximum(counts - DISCOUNT, 0)) - self.mass
        return np.logaddexp(logs, arcs) + self.inside


def fit(counts: DataFrame, classes: int, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Adapts the piece weights to what the training words are discounted."""
    scores = read_vocabulary(vocabulary)
    lattice = Lattice(list(scores))
    uses = np.repeat(lattice.first_uses(list(scores.values()))[:, None], classes, 1)
    names = [f"n{i}" for i in range(classes)]
    total = np.array([float(x or 0) for x in counts.agg(*[F.sum(n) for n in names]).first()])
    ends = np.array([float(x or 0) for x in counts.where(F.col("word") == END).agg(*[F.sum(n) for n in names]).first()])
    words = counts.where((F.col("word") != END) & (F.col("n") > 0))
    own = np.array([float(x or 0) for x in words.agg(*[F.sum(F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))) for n in names]).first()])
    rest = words.select("word", *[F.least(F.col(n).cast("double"), F.lit(DISCOUNT)).alias(n) for n in names])
    for _ in range(rounds if total.sum() else 0):
        shared = counts.sparkSession.sparkContext.broadcast((lattice, lattice.weights(uses).astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            sums = np.zeros((own.n + 1, classes))
            for batch in batches:
                words = np.array([w.replace(MARK, " ") for w in batch["word"].to_pylist()], object)
                for k, name in enumerate(names):
                    n = batch[name].to_numpy()
                    some = np.flatnonzero(n)
                    if len(some):
                        sums[:, k] += own.sums(words[some].tolist(), now[:, [k]], n[some])
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)),
                                              pa.array(sums[piece, k])], names=["piece", "class", "uses"])

        found = rest.mapInArrow(run, "piece int, class int, uses double").groupBy("piece", "class").agg(
            F.sum("uses").alias("uses")).toArrow()
        # Classes lend each other little: pieces that a class does not use keep a share of their use elsewhere.
        new = np.zeros((lattice.n + 1, classes))
        new[found["piece"].to_numpy(), found["class"].to_numpy()] = found["uses"].to_numpy()
        uses = new + SMOOTHING * (new.sum(1, keepdims=True) > 0) + SMOOTHING / 10
        shared.unpersist()
    return Model(lattice, uses, own, total, ends)


def frequent_words(words: DataFrame, most: int = FREQUENT) -> int:
    """A power of two: at most ``most`` words occur at least as often."""
    sizes = {r.b: r["count"] for r in words.groupBy(F.floor(F.log2("times")).cast("int").alias("b")).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return 2**least


def score(docs: DataFrame, training: Column, vocabulary: str, class_col: str | None = "lang", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` tells the documents to learn from; ``base_score`` is a smoothed unigram over words, in log10.
    """
    learns = F.coalesce(training, F.lit(False))
    number, classes = classes_of(docs.where(learns), class_col)
    counts = word_counts(docs, F.when(learns, number).otherwise(classes), classes, id_col, text_col)
    n, v, end = (x or 0 for x in counts.agg(
        F.sum("n"), F.sum((F.col("n") > 0).cast("int")), F.sum(F.when(F.col("word") == END, F.col("n")))).first())
    total = n + 0.5 * (v + 1)
    context = docs.sparkSession.sparkContext
    model = context.broadcast(fit(counts, classes, vocabulary))
    logs = [f"log{i}" for i in range(classes)]

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_class = np.stack([batch[f"n{i}"].to_numpy() for i in range(classes)], 1)
            found = model.value.word_logs(batch["word"].to_pylist(), by_class)
            base = np.log10((batch["n"].to_numpy() + 0.5) / total)
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(base), pa.array((batch["n"].to_numpy() > 0).astype(float)),
                                              *map(pa.array, found.T)], names=["word", "base", "known", *logs])

    words, values = counts.where(F.col("word") != END), ["base", "known", *logs]
    least = frequent_words(words)
    scored = f"word string, {', '.join(f'{x} double' for x in values)}"
    frequent = words.where(F.col("times") >= least).mapInArrow(score_words, scored).toArrow()
    shared = context.broadcast((
        {w.encode(): i for i, w in enumerate(frequent["word"].to_pylist())}, np.stack([frequent[x].to_numpy() for x in values], 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known_words = shared.value
        for batch in batches:
            texts = as_bytes(batch["text"])
            for begin in range(0, len(texts), 200):
                part = batch.slice(begin, 200)
                sums, sizes = np.zeros((len(part), len(values))), np.ones(len(part), np.int64)
                rest, times, offsets = [], [], [0]
                for i, text in enumerate(texts[begin:begin + 200]):
                    own = Counter(tokens(text))
                    at = np.fromiter(map(place.get, own, repeat(-1)), np.int64, len(own))
                    k = np.fromiter(own.values(), np.int64, len(own))
                    sizes[i] += k.sum()
                    sums[i] = k[at >= 0] @ known_words[at[at >= 0]]
                    rest.extend(compress(own, at < 0))
                    times.extend(k[at < 0].tolist())
                    offsets.append(len(rest))
                pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                                                   names=["word", "k"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(sizes), *map(pa.array, sums.T),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                    names=["doc_id", "held_out", "n_tokens", *values, "rest"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        (~learns).alias("held_out"))
    rows = materialize(texts.mapInArrow(
        run, f"doc_id long, held_out boolean, n_tokens long, {', '.join(f'{x} double' for x in values)}, "
             "rest array<struct<word:string,k:long>>").withColumn("row", F.monotonically_increasing_id()))
    # Words beyond the broadcast ones are rarer than its bound, so no word is hot here.
    beyond = words.where(F.col("times") < least).mapInArrow(score_words, scored)
    added = rows.select("row", F.inline("rest")).join(beyond, "word").groupBy("row").agg(
        *[F.sum(F.col("k") * F.col(x)).alias(f"more_{x}") for x in values])
    whole = {x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0.0)) for x in values}
    joint = F.array(*[whole[x] + start for x, start in zip(logs, model.value.starts.tolist())])
    summed = F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("joint")))
    return rows.join(added, "row", "left").withColumn("joint", joint).select(
        "doc_id", "held_out", "n_tokens", (F.round(whole["known"]).cast("long") + int(end > 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (whole["base"] + math.log10((end + 0.5) / total)).alias("base_score"),
        ((F.array_max("joint") + F.log(summed)) / math.log(10)).alias("score"))
