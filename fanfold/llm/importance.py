"""Importance resampling towards a target distribution, with a head-tail vocabulary.

Features are all words and pairs of neighbouring words; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
The head is broadcast: frequent words with their CRC and their CRC state after one more space, and frequent pairs of
them with their buckets. Everything else, the tail, takes a direct CRC: a word over its bytes, a pair over the second
word's bytes from the first one's state. Head and tail give the same exact buckets, so the head decides only how fast.

1. :func:`find_head` counts words and pairs of all documents, by their hashes, in bounded tables per task (the rarer half goes
   when a table is full) and adds them up; the ``HEAD_WORDS`` and ``HEAD_PAIRS`` most frequent are the head.
2. :func:`bucket_totals` adds features per bucket inside each task, so at most ``buckets`` rows leave a task.
3. :func:`bucket_gains` is one number per bucket, which is broadcast; :func:`weigh` adds them up per document.
4. :func:`resample` adds noise from the id, sorts the eligible documents in a distributed order and draws the first.

Texts are read in stretches of ``STRETCH`` bytes, each taking over the last word of the one before, so memory does not
follow the length of a text. What is broadcast is bounded by the capitals below: words of the head have at most
``HEAD_BYTES`` bytes.

Defined cases: NULL and empty texts have no features and weight 0. A NULL doc_id draws its noise from an empty id and
comes after every other in a tie. Rows that repeat an id are drawn each for itself. An empty target or empty documents
are no error: all counts are 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import as_bytes, id_and_text, text_key
from fanfold.llm.hashing import window_hashes, word_hashes
from fanfold.operators.ordering import dense_index
from fanfold.session import materialize

BUCKETS = 10_000
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 8192, 65_536, 64
TABLE = 200_000  # entries of a task's table of counts, at most
STRETCH = 1 << 20

# A-Z become a-z, the other ASCII signs that are no word are separators.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
             for b in range(256))

Group = list[tuple[int, bytes, bool]]


def stretches(texts: list[bytes], most: int = STRETCH) -> Iterator[Group]:
    """Groups of about ``most`` bytes: text number, folded bytes, whether the first word only begins a pair."""
    group, size = [], 0
    for i, text in enumerate(texts):
        folded, at, carry = text.translate(FOLD), 0, b""
        while at < len(folded):
            cut = folded.find(b" ", at + most) if len(folded) - at > most else -1
            cut = len(folded) if cut < 0 else cut
            piece = carry + folded[at:cut]
            group.append((i, piece, bool(carry)))
            size += len(piece)
            if cut < len(folded):
                held = piece.rstrip(b" ")
                carry = held[held.rfind(b" ") + 1:] + b" " if held else b""
            at = cut
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


class Head:
    """CRC states of frequent words and buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets, self.place = buckets, {w: i for i, w in enumerate(words)}
        self.crc = np.array([crc32(w) for w in words], np.uint32)
        self.spaced = np.array([crc32(w + b" ") for w in words], np.uint32)
        known = sorted((self.place[a] * len(words) + self.place[b], crc32(a + b" " + b) % buckets)
                       for a, b in pairs if a in self.place and b in self.place)
        # The last entry is no pair; it is what a code above all others meets.
        self.codes = np.array([c for c, _ in known] + [-1], np.int64)
        self.pair_buckets = np.array([b for _, b in known] + [0], np.int64)

    def features(self, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number and bucket of each word and of each pair."""
        lists = [piece.split() for _, piece, _ in group]
        words = list(chain.from_iterable(lists))
        sizes = np.array([len(x) for x in lists], np.int64)
        owner = np.repeat(np.array([i for i, _, _ in group], np.int64), sizes)
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        tail = np.flatnonzero(ids < 0)
        crc, spaced = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
        if len(self.crc):
            crc, spaced = self.crc[ids], self.spaced[ids]
        direct = [crc32(words[i]) for i in tail.tolist()]
        crc[tail] = direct
        spaced[tail] = [crc32(b" ", c) for c in direct]

        counted, paired = np.ones(len(words), bool), np.ones(max(len(words) - 1, 0), bool)
        ends = np.cumsum(sizes)
        counted[[e - n for e, n, (_, _, carried) in zip(ends, sizes, group) if carried and n]] = False
        paired[[e - 1 for e in ends if 0 < e < len(words)]] = False
        begins = np.flatnonzero(paired)
        codes = ids[begins] * len(self.crc) + ids[begins + 1]
        at = np.minimum(np.searchsorted(self.codes[:-1], codes), len(self.codes) - 1)
        seen = (ids[begins] >= 0) & (ids[begins + 1] >= 0) & (self.codes[at] == codes)
        pair = self.pair_buckets[at]
        unseen = begins[~seen]
        pair[~seen] = np.fromiter(map(crc32, [words[i] for i in (unseen + 1).tolist()], spaced[unseen].tolist()),
                                  np.int64, len(unseen)) % self.buckets
        return owner[counted], crc[counted].astype(np.int64) % self.buckets, owner[begins], pair


class Tally:
    """Counts by 64-bit key, and columns of values of each key's first place; the rarer half goes when there are too many."""

    def __init__(self, *kinds: type):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.columns = [np.zeros(0, kind) for kind in kinds]

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        own, first, n = np.unique(keys, return_index=True, return_counts=True)
        at, known = np.searchsorted(self.keys, own), np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        self.counts[at[known]] += n[known]
        at, first = at[~known], first[~known]
        self.keys, self.counts = np.insert(self.keys, at, own[~known]), np.insert(self.counts, at, n[~known])
        self.columns = [np.insert(old, at, new[first]) for old, new in zip(self.columns, columns)]
        if len(self.keys) > TABLE:
            often = np.sort(self.most(TABLE // 2))
            self.keys, self.counts, *self.columns = (x[often] for x in (self.keys, self.counts, *self.columns))

    def most(self, limit: int) -> np.ndarray:
        """The places of the largest counts, in no order."""
        if len(self.keys) <= limit:
            return np.arange(len(self.keys))
        return np.argpartition(self.counts, len(self.keys) - limit)[len(self.keys) - limit:]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, -1 where there is none."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = -1
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else at


def tally(group: Group, single: Tally, double: Tally) -> None:
    """Adds a group's words, which keep their bytes, and pairs, which keep their words' keys."""
    pieces = [piece for _, piece, _ in group]
    hashes, bounds = word_hashes(pieces)
    words = np.empty(len(hashes), object)
    words[:] = b" ".join(pieces).split()
    counted, paired = np.ones(len(hashes), bool), np.ones(max(len(hashes) - 1, 0), bool)
    counted[[a for a, b, (_, _, carried) in zip(bounds[:-1], bounds[1:], group) if carried and a < b]] = False
    paired[[b - 1 for b in bounds if 0 < b < len(hashes)]] = False
    single.add(hashes[counted], words[counted])
    double.add(window_hashes(hashes, 2)[paired], hashes[:-1][paired], hashes[1:][paired])


def spelled(single: Tally, double: Tally, words: int, pairs: int) -> Sequence[np.ndarray]:
    """The most frequent words and pairs as columns: first word, second word (None for a single word), count."""
    text, = single.columns
    short = np.array([len(w) <= HEAD_BYTES for w in text], bool)
    one, two = single.most(words), double.most(pairs)
    one = one[short[one]]
    a, b = (single.find(column[two]) for column in double.columns)
    # A pair is of use to the head only with both its words.
    held = (a >= 0) & (b >= 0)
    held[held] = short[a[held]] & short[b[held]]
    return (np.concatenate([text[one], text[a[held]]]), np.concatenate([np.full(len(one), None), text[b[held]]]),
            np.concatenate([single.counts[one], double.counts[two[held]]]))


def find_head(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, words: int = HEAD_WORDS,
              pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words and pairs of all documents, by counts that are exact but for rare entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = Tally(object), Tally(np.uint64, np.uint64)
        for batch in batches:
            for group in stretches(as_bytes(batch.column(0))):
                tally(group, single, double)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(spelled(single, double, words, pairs), (pa.binary(), pa.binary(), pa.int64()))],
            names=["a", "b", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "a binary, b binary, n long")
    counts = materialize(counts.groupBy("a", "b").agg(F.sum("n").alias("n")))

    return Head([bytes(r.a) for r in most(counts.where("b IS NULL"), words)],
                [(bytes(r.a), bytes(r.b)) for r in most(counts.where("b IS NOT NULL"), pairs)], buckets)


def most(rows: DataFrame, limit: int) -> list:
    """The most frequent rows, at most ``limit``: all whose count lies above a bound that is found from a histogram.

    Sorting for the first rows would send that many from every partition to the driver.
    """
    # Eight steps to a doubling, so a few hundred rows at most.
    band = F.floor(F.log2(F.col("n")) * 8).cast("int")
    total, least = 0, None
    for row in sorted(rows.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        total += row["count"]
        if total > limit:
            break
        least = row["band"]
    return [] if least is None else rows.where(band >= least).collect()


def bucket_totals(docs: DataFrame, head, text_col: str = "text") -> DataFrame:
    """Features per bucket, repeats counted; ``head`` is a broadcast :class:`Head`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = head.value
        totals = np.zeros(table.buckets, np.int64)
        for batch in batches:
            for group in stretches(as_bytes(batch.column(0))):
                _, single, _, double = table.features(group)
                totals += np.bincount(single, minlength=table.buckets) + np.bincount(double, minlength=table.buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(totals[held], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, head, text_col: str = "text") -> np.ndarray:
    """``floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B))))`` of every bucket, B buckets."""
    spark, buckets = docs.sparkSession, head.value.buckets
    s, t = (materialize(bucket_totals(d, head, text_col).withColumnRenamed("n", n)) for d, n in ((docs, "s"), (target, "t")))
    total_s, total_t = (float(d.agg(F.sum(n)).first()[0] or 0) for d, n in ((s, "s"), (t, "t")))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * F.lit(total_s + buckets)) / ((s + 1) * F.lit(total_t + buckets))
    gains = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        gains[row.bucket] = row.gain
    return gains


def weigh(docs: DataFrame, head, gains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, features and the floored mean of gains per document; ``head`` and ``gains`` are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gain = head.value, gains.value
        for batch in batches:
            words, sums, n = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for group in stretches(as_bytes(batch.column(1))):
                first, single, second, double = table.features(group)
                words += np.bincount(first, minlength=batch.num_rows)
                n += np.bincount(second, minlength=batch.num_rows)
                for owner, bucket in ((first, single), (second, double)):
                    # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                    sums += np.bincount(owner, gain[bucket], batch.num_rows).astype(np.int64)
            n += words
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x) for x in (words, n, weight))],
                                             names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", "text", text_key("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_words long, n_features long, weight long")


def noisy(weighed: DataFrame, seed: int) -> DataFrame:
    """Adds the score: the weight and Gumbel noise from the id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, rate: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (NULL if not drawn), n_words and text_key.

    ``rate`` in a hundred of the documents with at least ``least_words`` words are drawn, those with the highest scores.
    """
    context = docs.sparkSession.sparkContext
    head = context.broadcast(find_head(docs, text_col, buckets))
    gains = context.broadcast(bucket_gains(docs, target, head, text_col))
    scored = materialize(noisy(weigh(docs, head, gains, id_col, text_col), seed))
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = rate * eligible.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    ranked = dense_index(eligible, order, name="place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that repeat id and text stay if one of them was drawn."""
    chosen = report.where("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__key"))
    return docs.join(chosen, same, "left_semi")


# The table of CRC-32 is made from its polynomial, 0xEDB88320, eight steps for each byte.
ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
  SELECT doc_id, text, true AS raw FROM documents UNION ALL SELECT row_number() OVER (), text, false FROM benchmark),
words AS (
  SELECT doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT doc_id, raw, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counts AS (SELECT doc_id, raw, f, count(*) AS k FROM features GROUP BY ALL),
bytes AS (
  SELECT f, list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::UBIGINT) AS b
  FROM (SELECT DISTINCT f FROM counts)),
buckets AS (
  SELECT f, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, b),
    lambda c, x: xor(t[(xor(c, x) % 256 + 1)::BIGINT], c >> 8))) % 10000 AS bucket FROM bytes, crc),
held AS (SELECT doc_id, raw, bucket, sum(k) AS k FROM counts JOIN buckets USING (f) GROUP BY ALL),
totals AS (
  SELECT bucket, coalesce(sum(k) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (NOT raw), 0)::DOUBLE AS t FROM held GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000)
                                 / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS gain FROM totals),
weights AS (
  SELECT doc_id, floor(sum(k * gain) / sum(k))::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE raw GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
           AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE raw),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
