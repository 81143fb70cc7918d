"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (A-Z lower-cased; words of digits, a-z and all characters outside ASCII) and a suffix
automaton over all their word sequences is built. A document's words stream through it; at each word the automaton
gives the longest suffix of what was read that occurs in any item. Where it is at least ``window`` words long, the last
``window`` words are a window of an item and are hit; an item shorter than that is hit as a whole. Runs of
words that are in no item cannot match and are skipped before.

The automaton is broadcast in blocks of at most ``BLOCK_WORDS`` item words (long items are cut into pieces that
overlap by a window, so no window is lost). One block is one pass over the documents. With several, each pass
writes what it hits, by a digest of the text, before the next block is built, so neither memory nor a broadcast grows with the
benchmark; short rows are joined at the end. Texts are shuffled only where spans are to be cut out with several blocks.

Defined cases: NULL text has no words, hits nothing and is not contaminated; so has an empty one. A NULL item
text gives no window; a NULL item_id is the item named "". Repeated items are one item per item_id; repeated documents
give repeated rows. With an empty benchmark nothing is hit. Other columns are carried unread or not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanfold.llm.common import BROADCAST_ROWS, as_bytes, free_names, id_and_text, per_batch
from fanfold.session import materialize

WINDOW = 10
BLOCK_WORDS = 100_000  # item words in one automaton: at most twice as many states
PIECE_WORDS = 5_000  # longer items are cut into overlapping pieces

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised over (item, words) pairs; see the module for what ``spans`` finds."""

    def __init__(self, pieces: Sequence[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w)
            coded.append((item, ids))
        self.shortest = min([window, *(len(ids) for _, ids in coded if ids)])
        self.items: dict[int, set[str]] = {}  # by the state of a window
        self.short: dict[int, dict[int, set[str]]] = {}  # by the state and length of a short item
        for item, ids in coded:
            for _, state, length in self.walk(ids, 0):
                if length >= window:
                    self.items.setdefault(self._shrunk(state), set()).add(item)
            if 0 < len(ids) < window:
                self.short.setdefault(state, {}).setdefault(length, set()).add(item)
        # From which matched length on something is hit in a state.
        never = 1 << 60
        self.hit_from = [never] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            own = [*self.short.get(state, ()), *([window] if self.length[state] >= window else ())]
            above = self.hit_from[self.link[state]] if state else never
            self.hit_from[state] = min([above, *own])

    def _extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None and self.length[old] == self.length[last] + 1:
            return old
        if old is not None:
            return self._split(last, word, old)
        new = self._add({}, self.length[last] + 1, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            old = self.next[last][word]
            self.link[new] = old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        return new

    def _add(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        """A copy of ``old`` for the shorter strings that end here."""
        copy = self._add(dict(self.next[old]), self.length[state] + 1, self.link[old])
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _shrunk(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, ids: Sequence[int], at: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) after each word."""
        moves, link, lengths, state, length = self.next, self.link, self.length, 0, 0
        for at, word in enumerate(ids, at):
            step = moves[state].get(word)
            while step is None and state:
                state = link[state]
                length = lengths[state]
                step = moves[state].get(word)
            if step is None:
                length = 0
            else:
                state = step
                length += 1
            yield at, state, length

    def spans(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Word positions of what is hit, as begin, end, begin, end, …, disjoint and ascending; and the items."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[int] = []
        items: set[str] = set()
        hit_from, window = self.hit_from, self.window
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < self.shortest:
                continue
            for at, state, length in self.walk(ids[begin:end].tolist(), begin):
                if length < hit_from[state]:
                    continue
                reach = 0
                if length >= window:
                    reach = window
                    items |= self.items[self._shrunk(state)]
                up = state
                while up > 0:
                    for short, names in self.short.get(up, {}).items():
                        if short <= length:
                            reach = max(reach, short)
                            items |= names
                    up = self.link[up]
                first = at + 1 - reach
                while spans and spans[-2] >= first:
                    first = min(first, spans[-2])
                    del spans[-2:]
                if spans and spans[-1] >= first:
                    spans[-1] = at + 1
                else:
                    spans += [first, at + 1]
        return spans, items


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id",
             text_col: str = "text") -> Iterator[SuffixAutomaton]:
    """Automata of blocks of item pieces; the driver holds one block at a time."""
    step = PIECE_WORDS

    def start():
        def work(batch: pa.RecordBatch):
            items, sizes, texts = [], [], []
            for item, text in zip(batch["item"].to_pylist(), as_bytes(batch["text"])):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, min(1, len(words))), step):
                    piece = words[at:at + step + window - 1]
                    items.append(item)
                    sizes.append(len(piece))
                    texts.append(b" ".join(piece).decode())
            return items, sizes, texts

        return work

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             F.col(text_col).cast("string").alias("text"))
    pieces = per_batch(items, "item string, size int, words string", start)
    total = pieces.agg(F.sum("size")).first()[0] or 0
    blocks = -(-2 * total // block_words) if total > block_words else 1
    for block in range(blocks):
        # Half full on average, so that uneven hashing stays within a block's bound.
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block) if blocks > 1 else pieces
        yield SuffixAutomaton([(r.item, r.words.encode().split()) for r in own.toLocalIterator()], window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
             block_words: int = BLOCK_WORDS, names: Sequence[str] = ("n_words", "spans", "items"),
             keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and the number of words, spans (begin, end, …) and items, called ``names``."""
    kept = list(docs.columns if keep is None else keep)
    n_words, spans, items = names
    plain = docs.select(*kept).schema
    blocks = automata(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        schema = T.StructType([*plain.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, T.ArrayType(T.IntegerType())),
                               T.StructField(items, T.ArrayType(T.StringType()))])
        return per_batch(docs, schema, _pass(docs.sparkSession.sparkContext.broadcast(first), kept, text_col))
    found = [hits(docs, a, text_col) for a in (first, second)]
    del first, second
    for automaton in blocks:
        found.append(hits(docs, automaton, text_col))
    digest, = free_names(docs, "digest_of_text")
    rows = per_batch(docs.withColumn(digest, _digest(text_col)), plain.add(digest, T.BinaryType()).add(n_words, T.LongType()),
                     _counting([*kept, digest], text_col))
    return rows.join(_merged(found, digest, spans, items), digest, "left").select(
        *kept, n_words, F.coalesce(spans, F.array().cast("array<int>")).alias(spans),
        F.coalesce(items, F.array().cast("array<string>")).alias(items))


def _digest(text_col: str):
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def hits(docs: DataFrame, automaton: SuffixAutomaton, text_col: str = "text") -> DataFrame:
    """digest, spans and items of the different texts that ``automaton`` hits, written once; its broadcast is given up."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def start():
        own = shared.value

        def work(batch: pa.RecordBatch):
            digests, spans, items = [], [], []
            for digest, text in zip(batch["digest"].to_pylist(), as_bytes(batch["text"])):
                found, named = own.spans(words_of(text))
                if found:
                    digests.append(digest)
                    spans.append(found)
                    items.append(sorted(named))
            return digests, spans, items

        return work

    rows = docs.select(F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest"))
    found = per_batch(rows, "digest binary, spans array<int>, items array<string>", start)
    # Copies of a text are hit alike; one of each task is shuffled.
    out = materialize(found.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
    shared.destroy()
    return out


def _merged(found: list[DataFrame], digest: str, spans: str, items: str) -> DataFrame:
    """One row per text from the hits of several blocks."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # A text has one row for every block that hits it.
    rows = rows.groupBy("digest").agg(F.collect_list("spans").alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def start():
        def work(batch: pa.RecordBatch):
            return batch["digest"], [union(*lists) for lists in batch["spans"].to_pylist()], batch["items"]

        return work

    return per_batch(rows, f"`{digest}` binary, `{spans}` array<int>, `{items}` array<string>", start)


def _pass(shared, kept: list[str], text_col: str):
    def start():
        automaton = shared.value

        def work(batch: pa.RecordBatch):
            n_words, spans, items = [], [], []
            for text in as_bytes(batch[text_col]):
                words = words_of(text)
                n_words.append(len(words))
                found, named = automaton.spans(words)
                spans.append(found)
                items.append(sorted(named))
            return *(batch[c] for c in kept), n_words, spans, items

        return work

    return start


def _counting(kept: list[str], text_col: str):
    def start():
        def work(batch: pa.RecordBatch):
            return *(batch[c] for c in kept), [len(words_of(t)) for t in as_bytes(batch[text_col])]

        return work

    return start


def union(*lists: list[int]) -> list[int]:
    """The union of lists of spans."""
    out: list[int] = []
    for begin, end in sorted(span for own in lists for span in zip(own[::2], own[1::2])):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def covered(spans: str):
    """Number of words in a column of spans."""
    return F.expr(f"aggregate(transform({spans}, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = annotate(id_and_text(docs, id_col, text_col), benchmark, window, keep=["doc_id"])
    return rows.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.2, min_span: int = 1,
                  window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated text, same columns.

    A document whose share of hit words exceeds ``max_coverage`` goes (0: any hit). From the others, hit spans of at
    least ``min_span`` words are cut out of the text, with the white space after them; the rest is unchanged.
    """
    if max_coverage <= 0:
        return _drop_hit(docs, benchmark, window, text_col, block_words)
    n_words, spans, items = names = free_names(docs, "n_words", "spans", "items")
    rows = annotate(docs, benchmark, window, text_col, block_words, names)
    kept, columns = rows.where(covered(f"`{spans}`") <= max_coverage * F.col(n_words)), docs.columns

    def start():
        def work(batch: pa.RecordBatch):
            texts = [t if t is None or not s else cut(t.encode(), s, min_span).decode()
                     for t, s in zip(batch[text_col].to_pylist(), batch[spans].to_pylist())]
            return [pa.array(texts, batch[c].type) if c == text_col else batch[c] for c in columns]

        return work

    return per_batch(kept, docs.schema, start)


def _drop_hit(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int) -> DataFrame:
    """``docs`` without the rows that hold any window: only texts go through Python, and digests of the hit ones come back.

    Digests of up to ``BROADCAST_ROWS`` texts are broadcast; more are joined by a shuffle.
    """
    digest, = free_names(docs, "digest_of_text")
    found = [hits(docs, automaton, text_col).select(F.col("digest").alias(digest))
             for automaton in automata(benchmark, window, block_words)]
    digests = found[0]
    for more in found[1:]:
        digests = digests.unionByName(more)
    digests = digests.distinct()  # a text may be hit by several blocks
    n = digests.count()
    if not n:
        return docs
    return docs.withColumn(digest, _digest(text_col)).join(
        F.broadcast(digests) if n <= BROADCAST_ROWS else digests, digest, "left_anti").select(*docs.columns)


def cut(text: bytes, spans: list[int], min_span: int) -> bytes:
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2]):
        if end - begin >= min_span:
            kept.append(text[at:places[begin][0]])
            at = places[end][0] if end < len(places) else len(text)
    return b"".join([*kept, text[at:]])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, i, item_id, k FROM doc_windows JOIN item_windows USING (k, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
