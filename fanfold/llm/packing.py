"""Packing token sequences into as few bins as possible by swap-based local search.

Documents are tokenised where they are read and cut into pieces of at most ``capacity`` tokens. Full pieces are bins of
their own. The others are dealt to blocks of bounded size; a task packs a block (largest first, into the
fullest bin that has room) and then improves it by local search: the emptiest bin gives documents to other underfull
bins by a move, a one-for-one or a two-for-one exchange, each of which raises the sum of squared fills, until it is empty or no
exchange helps. Every block hands its emptiest bins on to a round with fewer blocks, until one block is left, so what
a block could not fill is filled across blocks. Only lengths and keys are shuffled, never texts or tokens.

Defined cases: NULL text is empty; an empty text is its closing id alone. Rows that repeat are packed each. Texts
longer than a bin give full pieces and a shorter last one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import WORD_GAPS, as_bytes, bounded_cache, give_back, id_and_text
from fanfold.session import materialize

CAPACITY = 2048
BLOCK_PIECES = 4_000  # pieces that one task packs at once
HANDED_ON = 6  # bins that a block hands on to the next round
TARGETS = 64  # underfull bins that one step of the search looks at
CACHED_WORDS = 100_000  # about 20 MB
CACHED_BYTES = 4_000_000  # of words, for long ones
CLOSING_ID = 0

# Letters below U+0600 that stay single letters in every normal form and case.
_LETTERS = "".join(re.escape(c) for c in map(chr, range(0x80, 0x600))
                   if c.isalpha() and c.lower().isalpha() and len(c.lower()) == 1 and normalize("NFC", c) == c)
# Words of these signs fall into units by the tokenizer's own rule: contractions, letters, single digits, other signs.
SIMPLE = re.compile(f"[!-~{_LETTERS}]+")
UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{_LETTERS}]+|[0-9]|[^a-zA-Z0-9{_LETTERS}]+")

# In a text of these signs all bytes above ASCII belong to letters, so its units are found in its bytes.
PLAIN = re.compile(f"[{WORD_GAPS}!-~{_LETTERS}]*")
# Words that no normal form and no change of case alters.
LOWER = re.compile(f"[a-z{''.join(c for c in _LETTERS if c == c.lower())}]+")
UNIT_BYTES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+").findall

PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def word_coder(path: str):
    """Texts to little-endian 32-bit ids.

    The tokenizer lower-cases, drops white space and joins nothing across it, so a word's ids do not depend on its
    neighbours, and words are looked up in a cache that lives as long as the Python worker.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # The same model behind the two steps that words of small letters need: cutting at spaces, and bytes as signs.
    small = Tokenizer(tokenizer.model)
    small.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    cache: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}  # the cache before it was full last: words that come again go back into the cache
    held = 0  # bytes of the words in the cache

    def one_by_one(words: list[bytes]) -> None:
        for word, found in zip(words, tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            cache[word] = np.array(found.ids, "<u4").tobytes()

    def together(words: list[bytes], coder: Tokenizer) -> None:
        """Words of letters only, as one text; each is one unit, whose last token bears the word-end mark."""
        text = b" ".join(words).decode()
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(words):  # the tokenizer divides a word that looks whole here
            return one_by_one(words)
        packed, begin = ids.tobytes(), 0
        for word, stop in zip(words, (stops * 4).tolist()):
            cache[word] = packed[begin:stop]
            begin = stop

    def has_added(word: bytes) -> bool:
        lower = word.lower()
        return any(token in lower for token in added)

    def learn(new: set[bytes]) -> None:
        letters, others, units = [], [], {}
        for word in new:
            (letters if word.isalpha() or word.decode().isalpha() else others).append(word)
        for word in others:
            text = word.decode()
            if SIMPLE.fullmatch(text) and not (b"<|" in word and has_added(word)):
                units[word] = [u.encode() for u in UNIT.findall(text)]
        letters += [u for u in set().union(*units.values()).difference(cache) if u.decode().isalpha()]
        lower = [w for w in letters if LOWER.fullmatch(w.decode())]
        for words, coder in (lower, small), (list(set(letters).difference(lower)), tokenizer):
            for at in range(0, len(words), 1000):
                together(words[at:at + 1000], coder)
        one_by_one([u for u in {*others, *(u for parts in units.values() for u in parts)} if u not in cache
                    and (u not in units or len(units[u]) == 1)])
        for word, parts in units.items():
            if len(parts) > 1:
                cache[word] = b"".join(map(cache.__getitem__, parts))

    def units_of(text: bytes) -> list[bytes]:
        """Units of a text of plain signs, words of any other."""
        # Added tokens are matched before anything is lower-cased, so words that hold one in any case stay as they are.
        if b"<|" in text and has_added(text):
            return [w if has_added(w) else w.lower() for w in text.split()]
        lower = text.lower()
        return UNIT_BYTES(lower) if PLAIN.fullmatch(lower.decode()) else lower.split()

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal cache, older, held
        split = [units_of(t) for t in texts]
        if 2 * len(cache) > CACHED_WORDS or 2 * held > CACHED_BYTES:
            cache, older, held = {}, cache, 0
        new = set().union(*split).difference(cache)
        held += sum(map(len, new))
        again = new.intersection(older)
        cache.update(zip(again, map(older.__getitem__, again)))
        learn(new.difference(again))
        return [b"".join(map(cache.__getitem__, words)) for words in split]

    return encode


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])
    closing, width = np.array([CLOSING_ID], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_coder(tokenizer)
        for batch in batches:
            texts, rows = as_bytes(batch["text"]), []
            for begin in range(0, len(texts), 500):
                part = zip(batch["doc_id"][begin:begin + 500].to_pylist(), encode(texts[begin:begin + 500]))
                for doc_id, ids in part:
                    ids += closing
                    for n, at in enumerate(range(0, len(ids), width)):
                        one = ids[at:at + width]
                        rows.append((doc_id, n, at // 4, len(one) // 4, zlib.crc32(one)))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class Bins:
    """Bins of lengths under one capacity and the search that empties them."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fills: list[int] = []

    def fill_greedily(self, order: list[int]) -> None:
        room: list[tuple[int, int]] = sorted((self.capacity - f, b) for b, f in enumerate(self.fills))
        for i in order:
            size = self.lengths[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fills.append(0)
            self.bins[b].append(i)
            self.fills[b] += size
            if left > size:
                insort(room, (left - size, b))

    def least(self) -> int:
        """Bins that no packing can do without: by total length, and by documents of more than half a bin."""
        total = sum(self.fills)
        return max(-(-total // self.capacity), sum(2 * n > self.capacity for n in self.lengths))

    def search(self) -> None:
        """Local search by steps that raise the sum of squared fills, until no step is left or no bin can go.

        Givers are taken from the emptiest bin up, takers from the fullest down.
        """
        least, stuck = self.least(), False
        while not stuck and sum(1 for f in self.fills if f) > least:
            stuck = True
            under = sorted((f, b) for b, f in enumerate(self.fills) if 0 < f < self.capacity)
            for fill, giver in under[:-1]:
                if self.fills[giver] == fill and self._give(giver, under):
                    stuck = False
                    if not self.bins[giver]:
                        break

    def _give(self, giver: int, under: list[tuple[int, int]]) -> bool:
        """Exchanges documents of ``giver`` for tokens of fuller bins; whether there was any step."""
        moved = False
        while self.bins[giver]:
            best = None
            for looked, (_, taker) in enumerate(reversed(under)):
                fill = self.fills[taker]
                free = self.capacity - fill
                if not free or taker == giver or fill < self.fills[giver]:
                    continue
                found = self._exchange(giver, taker, free)
                if found:
                    rise = found[0] * (found[0] + fill - self.fills[giver])
                    if best is None or rise > best[0]:
                        best = (rise, taker, found)
                if best and (found and found[0] == free or looked > TARGETS):
                    break
            if best is None:
                return moved
            moved = True
            _, taker, (gain, out, back) = best
            self.bins[giver] = [i for i in self.bins[giver] if i not in out] + list(back)
            self.bins[taker] = [i for i in self.bins[taker] if i not in back] + list(out)
            self.fills[giver] -= gain
            self.fills[taker] += gain
        return moved

    def _exchange(self, giver: int, taker: int, free: int):
        """(tokens, documents out, documents back) with the most tokens that fit in ``free``: a move, one for one, two for
        one or one for two; None if there is none."""
        size = self.lengths
        out = sorted(self.bins[giver], key=size.__getitem__)
        back = self.bins[taker]
        sizes = [size[i] for i in out]
        best = (0, (), ())
        at = bisect_right(sizes, free)
        if at:
            best = (sizes[at - 1], (out[at - 1],), ())
        for j in back:
            if best[0] == free:
                break
            at = bisect_right(sizes, free + size[j])
            if at and sizes[at - 1] - size[j] > best[0]:
                best = (sizes[at - 1] - size[j], (out[at - 1],), (j,))
        if best[0] < free:
            for x in range(len(out)):
                for j in back:  # two for one
                    most = free + size[j] - sizes[x]
                    at = bisect_right(sizes, most, 0, x)
                    if at and sizes[x] + sizes[at - 1] - size[j] > best[0]:
                        best = (sizes[x] + sizes[at - 1] - size[j], (out[x], out[at - 1]), (j,))
                if best[0] == free:
                    break
        if best[0] < free:
            few = sorted(back, key=size.__getitem__)
            for x in range(len(out)):
                for p in range(len(few)):  # one for two: the smallest pair that still fits
                    least = sizes[x] - free - size[few[p]]
                    for q in range(p + 1, len(few)):
                        if size[few[q]] >= least:
                            gain = sizes[x] - size[few[p]] - size[few[q]]
                            if gain > best[0]:
                                best = (gain, (out[x],), (few[p], few[q]))
                            break
                if best[0] == free:
                    break
        return best if best[0] > 0 else None


def pack_block(lengths: list[int], capacity: int, groups: list[int] | None = None) -> list[int]:
    """The bin of every length; ``groups`` are the bins of an earlier round to start from."""
    bins = Bins(lengths, capacity)
    if groups is None:
        bins.fill_greedily(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)))
    else:
        places: dict[int, int] = {}
        for i, g in enumerate(groups):
            b = places.setdefault(g, len(places))
            if b == len(bins.bins):
                bins.bins.append([])
                bins.fills.append(0)
            bins.bins[b].append(i)
            bins.fills[b] += lengths[i]
    bins.search()
    result = [0] * len(lengths)
    for b, members in enumerate(bins.bins):
        for i in members:
            result[i] = b
    return result


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` needs the columns of :func:`pieces_of`."""
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    done = [rows.where(full).select(*PIECE, F.col("row").alias("bin"), F.lit(0).cast("long").alias("block"),
                                    F.lit(0).alias("round"), F.col("row"))]
    open_rows = rows.where(~full).select(*PIECE, "row", F.lit(None).cast("long").alias("bin"))
    count = open_rows.count()
    number = 0
    while count:
        number += 1
        blocks = -(-count // block_pieces)
        # A bin of an earlier round stays together; new pieces are dealt singly.
        dealt = open_rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("bin", "row")), F.lit(blocks)))
        packed = materialize(dealt.groupBy("block").applyInArrow(
            _packer(capacity, blocks > 1), f"{PIECES}, row long, bin long, block long, more boolean").withColumn(
                "round", F.lit(number)))
        done.append(packed.where(~F.col("more")).select(*PIECE, "bin", "block", "round", "row"))
        if blocks == 1:
            break
        # Numbers of bins are dense within a block, so the pair is one number that stays unique.
        open_rows = packed.where("more").select(*PIECE, "row", (F.col("block") * 2**31 + F.col("bin")).alias("bin"))
        count = open_rows.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return _placed(out)


def _packer(capacity: int, hand_on: bool):
    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = batch["length"].to_pylist()
        old = batch["bin"].to_pylist()
        bins = pack_block(lengths, capacity, old if old and old[0] is not None else None)
        fills: dict[int, int] = {}
        for b, n in zip(bins, lengths):
            fills[b] = fills.get(b, 0) + n
        emptiest = sorted((f, b) for b, f in fills.items() if f < capacity)[:HANDED_ON if hand_on else 0]
        passed = {b for _, b in emptiest}
        return pa.Table.from_arrays(
            [*(batch[c] for c in [*PIECE, "row"]), pa.array(bins, pa.int64()), batch["block"],
             pa.array([b in passed for b in bins], pa.bool_())],
            names=[*PIECE, "row", "bin", "block", "more"])

    return run


def _placed(rows: DataFrame) -> DataFrame:
    """Numbers the bins and lays the pieces of each one after another. A bin has at most ``capacity`` pieces."""
    from pyspark.sql.window import Window as W

    before = W.partitionBy("round", "block", "bin").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    first = W.partitionBy("round", "block", "bin").orderBy("row")
    return rows.select(*PIECE, F.first("row").over(first).alias("sequence_id"),
                       F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs, tokenizer, capacity, id_col, text_col), capacity)
