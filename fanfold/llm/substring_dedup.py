"""Removal of repeated word sequences, found through recompression.

A text is recompressed in rounds: runs of one word get a name, then, in each round, the names are divided into left and
right ones by a bit of their hash and every left-right pair gets a name. Names are 64-bit hashes of what they stand for, so
they are the same everywhere without a dictionary. Whether neighbours were joined depends on few words around them, and those
are tracked: a symbol's context is the words that decide it. Equal windows of words hold the same symbols, as far as
the symbols' contexts lie inside the window.

1. Every window chooses the symbol of the smallest name among those whose context it contains (or itself, if there is none).
   Equal windows choose equal symbols. The chosen symbols' contexts are hashed and Spark finds which occur more than once.
2. Only windows that chose a repeated symbol can be repeated. They are hashed (96 bits), and Spark finds for each
   sequence its earliest place; every other window of it is repeated.
3. Words covered by repeated windows are removed.

Hashes and places travel as arrays, a bucket of hashes to a task. A hash that a task has seen often is sent only as
often as it is needed (twice, or its earliest place), so no bucket is hot. Places come back by document. Texts are only
shuffled if a bitmap of bounded size says that they hold something repeated.

Defined cases: NULL text has no words; texts shorter than a window lose nothing. Of rows with one doc_id but different texts,
that with the smaller text hash comes first; rows that repeat doc_id and text are the same document and get the same
result each. A NULL doc_id comes last. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import as_bytes, id_and_text
from fanfold.llm.hashing import in_parts, mixed, powers, window_hashes, word_hashes
from fanfold.session import materialize

WINDOW = 20
ROUNDS = 4
PART_BYTES = 1 << 20
FLUSH = 1_000_000  # places that a task gathers before it sends them
BITMAP = 1 << 26  # bits, at most
LAST_ID = np.iinfo(np.int64).max  # the order of a NULL doc_id

_RUN, _LEFT, _RIGHT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def recompress(hashes: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols of all texts after ``rounds``, and the begins and ends of their contexts, all ascending.

    A context that would need words beyond the text ends one word outside it.
    """
    first = np.zeros(len(hashes), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    new = first.copy()
    new[1:] |= hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(hashes))
    names = mixed(hashes[starts] + (ends - starts).astype(np.uint64) * _RUN)
    low, high, first = starts - 1, ends + 1, first[starts]  # a run ends where another word is seen
    for r in range(rounds):
        right = (mixed(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(names), bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        kept = np.ones(len(names), bool)
        kept[1:] = ~joined[:-1]
        # A left symbol alone has seen its right neighbour, a right one its left neighbour.
        before = np.where(first, low, np.concatenate((low[:1], low[:-1])))
        last = np.append(first[1:], True)
        after = np.concatenate((high[1:], high[-1:]))
        low = np.where(right, before, low)
        high = np.where(joined, after, np.where(right | last, high, after))
        pair = mixed(names * _LEFT + np.concatenate((names[1:], names[-1:])) * _RIGHT)
        names = np.where(joined, pair, names)[kept]
        low, high, first = low[kept], high[kept], first[kept]
    return names, low, high


class Windows:
    """All windows of some texts and what each chose: an anchor is a range of words."""

    def __init__(self, texts: list[bytes], size: int):
        self.size = size
        self.hashes, self.bounds = word_hashes(texts)
        counts = np.maximum(np.diff(self.bounds) - size + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), counts)
        offset = np.repeat(np.cumsum(counts) - counts, counts)
        self.start = np.arange(len(self.text)) - offset  # within the text
        at = self.start + self.bounds[self.text]
        self.at = at
        if not len(at):
            self.code, self.low, self.high = at, at, at
            return
        names, low, high = recompress(self.hashes, self.bounds)
        a, b = np.searchsorted(low, at), np.searchsorted(high, at + size, "right")
        own = b <= a
        chosen = _argmin(names, np.where(own, 0, a), np.where(own, 1, b))
        self.low, self.high = np.where(own, at, low[chosen]), np.where(own, at + size, high[chosen])
        # An anchor's code within its text: an even number for a symbol, an odd one for a window.
        begins = np.searchsorted(low, self.bounds[:-1] - 1)  # a text's first symbol begins one word before it
        self.code = np.where(own, 2 * self.start + 1, 2 * (chosen - begins[self.text]))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, code) of every anchor once."""
        if not len(self.code):
            return np.zeros(0, np.uint64), self.text, self.code
        # Windows that follow each other mostly choose the same.
        change = np.ones(len(self.code), bool)
        change[1:] = (self.code[1:] != self.code[:-1]) | (self.text[1:] != self.text[:-1])
        low, high, text, code = self.low[change], self.high[change], self.text[change], self.code[change]
        up, down = powers(len(self.hashes) + 1)
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[:len(self.hashes)], out=sums[1:])
        return mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64) * _RUN), text, code


def _argmin(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the first smallest value in each range [a, b)."""
    tables, step = [np.arange(len(values))], 1
    longest = int((b - a).max())
    while 2 * step <= longest:
        last = tables[-1]
        other = last[step:]
        mine = last[:len(other)]
        tables.append(np.concatenate((np.where(values[other] < values[mine], other, mine), last[len(other):])))
        step *= 2
    level = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for k, best in enumerate(tables):
        own = np.flatnonzero(level == k)
        if len(own):
            x, y = best[a[own]], best[b[own] - (1 << k)]
            out[own] = np.where(values[y] < values[x], y, x)
    return out


PLACES = ("bucket int, known boolean, hash binary, check binary, doc binary, text_key binary, place binary")
_COLUMNS = [("hash", np.uint64), ("check", np.uint32), ("doc", np.int64), ("text_key", np.int64), ("place", np.uint32)]


class Sender:
    """Gathers places (hash, check, doc, text_key, place), thins them out, and packs them by bucket."""

    def __init__(self, buckets: int, earliest: bool):
        self.buckets, self.earliest, self.parts, self.size = buckets, earliest, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append([c.astype(kind) for c, (_, kind) in zip(columns, _COLUMNS)])
        self.size += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.size = [], 0
        hashes, check, doc, text_key, place = columns
        nth = _nth(hashes, check, doc, text_key, place)
        # Anchors are sent twice at most: then they are known to be repeated. Of windows the earliest is enough.
        known = nth >= (1 if self.earliest else 2)
        bucket = np.where(known, mixed(text_key.view(np.uint64)), hashes) % np.uint64(self.buckets)
        order = np.lexsort((np.arange(len(bucket)), bucket, known))
        cuts = np.flatnonzero(np.diff(bucket[order]) | np.diff(known[order].astype(np.uint64))) + 1
        rows = [[] for _ in range(2 + len(columns))]
        for part in np.split(order, cuts):
            is_known = bool(known[part[0]])
            rows[0].append(int(bucket[part[0]]))
            rows[1].append(is_known)
            for i, (c, (name, _)) in enumerate(zip(columns, _COLUMNS), 2):
                skip = is_known and name in ("hash", "check") or name == "check" and not self.earliest
                rows[i].append(b"" if skip else c[part].tobytes())
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * len(columns)]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)],
                                         names=["bucket", "known", *[n for n, _ in _COLUMNS]])


def _nth(hashes, check, doc, text_key, place) -> np.ndarray:
    """How many places with the same hash and check come before each place; a place that repeats wholly comes before none."""
    order = np.lexsort((place, text_key, doc, check, hashes))
    h, c, d, t, p = (x[order] for x in (hashes, check, doc, text_key, place))
    group = np.ones(len(order), bool)
    group[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    fresh = group.copy()
    fresh[1:] |= (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    rank = np.cumsum(fresh)
    out = np.empty(len(order), np.int64)
    out[order] = rank - np.maximum.accumulate(np.where(group, rank, 0))
    return out


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def repeated_places(sent: DataFrame, buckets: int, earliest: bool) -> DataFrame:
    """text_key and places (4-byte numbers, ascending) of what is repeated: of anchors every place of a hash that has several,
    of windows all places but the earliest. Written once."""

    def find(table: pa.Table) -> pa.Table:
        known = table.filter(table["known"])
        open_ = table.filter(pa.compute.invert(table["known"]))
        hashes, check, doc, text_key, place = (_column(open_, n, k) for n, k in _COLUMNS)
        check = check if earliest else np.zeros(len(hashes), np.uint32)
        nth = _nth(hashes, check, doc, text_key, place)
        if earliest:
            found = nth > 0
        else:
            several = np.unique(hashes[nth > 0])
            found = np.isin(hashes, several)
        keys = np.concatenate((text_key[found], _column(known, "text_key", np.int64)))
        places = np.concatenate((place[found], _column(known, "place", np.uint32)))
        part = mixed(keys.view(np.uint64)) % np.uint64(buckets)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        return pa.table({"part": pa.array([int(part[x[0]]) for x in parts], pa.int32()),
                         "text_key": pa.array([keys[x].tobytes() for x in parts], pa.binary()),
                         "place": pa.array([places[x].tobytes() for x in parts], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        keys, places = _column(table, "text_key", np.int64), _column(table, "place", np.uint32)
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
        keys, places = keys[fresh], places[fresh]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return pa.table({"text_key": pa.array(keys[begins], pa.int64()),
                         "places": pa.array([x.tobytes() for x in np.split(places, begins[1:])] if len(keys) else [], pa.binary())})

    found = sent.groupBy("bucket").applyInArrow(find, "part int, text_key binary, place binary")
    return materialize(found.groupBy("part").applyInArrow(gather, "text_key long, places binary"))


class Marked:
    """A bitmap of text keys, of a size that grows with their number up to a bound: it may name too many, never too few."""

    def __init__(self, found: DataFrame):
        self.bits = bits = min(BITMAP, 1 << (16 * found.count() + 1023).bit_length())

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, bool)
            for batch in batches:
                own[mixed(batch["text_key"].to_numpy().view(np.uint64)) % np.uint64(bits)] = True
            packed = np.packbits(own)
            some = np.flatnonzero(packed)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some].astype(np.int32))], names=["at", "byte"])

        rows = found.select("text_key").mapInArrow(marks, "at long, byte int").groupBy("at").agg(
            F.bit_or("byte").alias("byte")).toArrow()
        packed = np.zeros(bits // 8, np.uint8)
        packed[rows["at"].to_numpy()] = rows["byte"].to_numpy()
        self.shared = found.sparkSession.sparkContext.broadcast(np.unpackbits(packed).astype(bool))

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}

    def holds(self, keys: pa.Array) -> np.ndarray:
        return self.shared.value[mixed(keys.to_numpy().view(np.uint64)) % np.uint64(self.bits)]


def only(docs: DataFrame, marked: Marked) -> DataFrame:
    """The documents that ``marked`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked.holds(batch["text_key"])))

    return docs.mapInArrow(run, docs.schema)


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("text_key"))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy()


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """text_key and places: the starts of the windows of ``docs`` (doc_id, text, text_key) that also start earlier."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, earliest=False)
        for batch in batches:
            texts, ids, keys = as_bytes(batch["text"]), _ids(batch["doc_id"]), batch["text_key"].to_numpy()
            for a, b in in_parts(texts, PART_BYTES):
                hashes, text, code = Windows(texts[a:b], size).anchors()
                sender.add(hashes, np.zeros(len(hashes), np.uint32), ids[a:b][text], keys[a:b][text], code)
                if sender.size > FLUSH:
                    yield from sender.flush()
        yield from sender.flush()

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, earliest=True)
        for batch in batches:
            texts, ids, keys = as_bytes(batch["text"]), _ids(batch["doc_id"]), batch["text_key"].to_numpy()
            codes = [np.frombuffer(x, np.uint32) for x in batch["places"].to_pylist()]
            for a, b in in_parts(texts, PART_BYTES):
                w = Windows(texts[a:b], size)
                # (text, code) as one number each.
                wanted = np.concatenate([c.astype(np.int64) + (i << 33) for i, c in enumerate(codes[a:b])])
                some = np.flatnonzero(np.isin(w.code + (w.text.astype(np.int64) << 33), wanted))
                at, text = w.at[some], w.text[some]
                again = window_hashes(mixed(w.hashes ^ _LEFT), size)[at] >> np.uint64(32)
                sender.add(window_hashes(w.hashes, size)[at], again, ids[a:b][text], keys[a:b][text], w.start[some])
                if sender.size > FLUSH:
                    yield from sender.flush()
        yield from sender.flush()

    anchors = repeated_places(docs.mapInArrow(send_anchors, PLACES), buckets, earliest=False)
    held = only(docs, Marked(anchors)).join(anchors, "text_key").select("doc_id", "text", "text_key", "places")
    return repeated_places(held.mapInArrow(send_windows, PLACES), buckets, earliest=True)


def deduplicate(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words that stay."""
    keyed = _with_key(docs, id_col, text_col)
    found = repeated_windows(keyed, size)
    marked = Marked(found)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def finish(batch: pa.RecordBatch, places: list[bytes | None]) -> pa.RecordBatch:
        words_of, removed, digests, kept = [], [], [], []
        for text, starts in zip(as_bytes(batch["text"]), places):
            words = text.split()
            n = len(words)
            if starts:
                gone = np.zeros(n + 1, np.int64)
                begins = np.frombuffer(starts, np.uint32).astype(np.int64)
                gone[begins] += 1
                gone[begins + size] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0).tolist()]
            joined = b" ".join(words)
            words_of.append(n)
            removed.append(n - len(words))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined)
        columns = [batch["doc_id"], pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(~marked.holds(batch["text_key"])))
            yield finish(own, [None] * own.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch, batch["places"].to_pylist())

    joined = only(keyed, marked).join(found, "text_key", "left").select("doc_id", "text", "places")
    return keyed.mapInArrow(untouched, kind).unionByName(joined.mapInArrow(touched, kind))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
