"""Token counts by a finite-state transducer compiled from a subword vocabulary.

The vocabulary is a byte-pair one whose pieces hold the word mark only at their beginning, so a word mark after
another character always begins a new token. Its encoder is compiled, transition by transition as texts need them, into
a deterministic transducer: a state is what the next characters can still depend on (the longest suffix that begins a
piece, and the last token and relative count at each of its positions), and a transition on a character carries the
number of tokens by which the count grows. Two facts make that finite and exact: a prefix of an encoding is the encoding
of a prefix, and a token sequence is an encoding if and only if each neighbouring pair is one.

A text is cut into chunks of equal length anywhere. A chunk's state map sends an entry state to an exit state and a
count: beyond its first word mark it no longer depends on the entry state; before that the map is worked out for the state
that the characters ahead of the chunk leave, and for any other where composition needs it. Maps compose associatively and
are combined by a prefix scan of logarithmic depth; each is applied to a state once, so the time is linear in the text.

Defined cases: NULL text is empty; an empty text has no bytes and no tokens; characters outside the vocabulary count as
one token per UTF-8 byte; texts of any length are counted whole; rows that repeat give rows that repeat. Other columns
are not read. Nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from fanfold.llm.common import as_texts, bounded_cache, id_and_text, per_batch

MARK = "▁"  # fixed value: the vocabulary's word mark, which stands for a space
CHUNK = 1 << 16  # code points
WARM_UP = 64  # characters ahead of a chunk from which its entry state is foreseen
CACHED_WORDS = 300_000
CACHED_STATES = 200_000
CACHED_PAIRS = 400_000
_SHUT = -2
_NONE = -1  # the last token where a word begins or an unknown character ended


class CountTransducer:
    """A lazily compiled deterministic transducer; ``step(state, character)`` gives (next state, count change)."""

    def __init__(self, ranks: dict[str, float]):
        self.ids = {piece: i for i, piece in enumerate(ranks)}
        self.pieces = list(ranks)
        self.ranks = ranks
        self.prefixes = {piece[:k] for piece in ranks for k in range(1, len(piece) + 1)}
        self.whole = [self.encode(piece) == [piece] for piece in self.pieces]
        self.pairs = bounded_cache(CACHED_PAIRS, self._is_pair)
        self.shapes = bounded_cache(CACHED_PAIRS, self._shape)
        self._reset()

    def _reset(self) -> None:
        self.keys: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._state(("", (_NONE,), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return self.numbers[key]

    def encode(self, text: str) -> list[str]:
        """The definition: join the neighbours that form the piece of the best rank, leftmost first."""
        parts = list(text)
        while True:
            best = min(((-self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.ranks), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _is_pair(self, pair: tuple[int, int]) -> bool:
        a, b = self.pieces[pair[0]], self.pieces[pair[1]]
        return self.encode(a + b) == [a, b]

    def _compile(self, state: int, character: str) -> tuple[int, int]:
        tail, last, count = self.keys[state]
        old = count[-1]
        if character not in self.prefixes:
            return self.start, len(character.encode())
        if character == MARK and tail and tail[-1] != MARK:
            tail, last, count = "", (_NONE,), (0,)  # a new word, whatever came before
        candidates, k, shut = self.shapes[tail + character]
        for j, piece in candidates:
            if last[j] == _NONE or last[j] != _SHUT and self.pairs[last[j], piece]:
                break
        else:  # a character that is a prefix but no piece
            return self.start, len(character.encode())
        now = count[j] + 1
        last, count = [*last[k:], piece], [c - now for c in count[k:]] + [0]
        for i in shut:
            last[i], count[i] = _SHUT, 0
        return self._state((tail[k:] + character if k <= len(tail) else "", tuple(last), tuple(count))), now - old

    def _shape(self, text: str) -> tuple:
        """Of a suffix: (place, piece) of the pieces that end it, where the next state's suffix begins, and the places
        in that where no token can begin; they are blanked, so that more states are one."""
        candidates = [(j, p) for j in range(len(text)) if (p := self.ids.get(text[j:])) is not None and self.whole[p]]
        k = next((k for k in range(len(text)) if text[k:] in self.prefixes), len(text))
        return candidates, k, [j - k for j in range(k, len(text)) if text[j:] not in self.prefixes]

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(exit state, tokens emitted); call :meth:`tidy` between texts to bound memory."""
        total, table = 0, self.next
        for character in text:
            row = table[state]
            step = row.get(character)
            if step is None:
                step = row[character] = self._compile(state, character)
            state = step[0]
            total += step[1]
        return state, total

    def tidy(self) -> bool:
        """Forgets all states when there are very many; no state number may be held across it."""
        if len(self.keys) > CACHED_STATES:
            self._reset()
            return True
        return False


_BOUNDARY = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class StateMap:
    """Entry state -> (exit state, count) of a chunk, or of two neighbouring maps; what is known of it is kept.

    A chunk's map is ``text``, up to its first word mark, and what follows whatever the entry state: ``count`` tokens and
    ``end``, an exit state (None: the chunk has no such mark).
    """

    def __init__(self, transducer: CountTransducer, text: str = "", count: int = 0, end: int | None = None,
                 parts: tuple[StateMap, StateMap] | None = None):
        self.transducer, self.text, self.count, self.end, self.parts = transducer, text, count, end, parts
        self.known: dict[int, tuple[int, int]] = {}

    def __call__(self, entry: int) -> tuple[int, int]:
        found = self.known.get(entry)
        if found is None:
            if self.parts:
                state, before = self.parts[0](entry)
                state, after = self.parts[1](state)
                found = state, before + after
            else:
                state, count = self.transducer.run(entry, self.text)
                found = (state, count) if self.end is None else (self.end, count + self.count)
            self.known[entry] = found
        return found


class ChunkCounter:
    """State maps of chunks and their composition."""

    def __init__(self, transducer: CountTransducer):
        self.transducer = transducer
        # A whole word: a mark and what follows up to the next one.
        self.words = bounded_cache(CACHED_WORDS, lambda word: transducer.run(transducer.start, MARK + word)[1])

    def chunk_map(self, chunk: str, before: str = "") -> StateMap:
        """The map of a chunk, worked out for the state that ``before``, the characters ahead of it, most likely leave: an
        encoding soon forgets where it began. Composition asks for others where they occur."""
        first = _BOUNDARY.search(chunk)
        if first is None:
            made = StateMap(self.transducer, chunk)
        else:
            head, rest = chunk[:first.start()], chunk[first.start() + 1:]
            words = rest.split(MARK)
            if "" in words:  # runs of marks belong to the word after them
                words = [w[1:] for w in _BOUNDARY.split(MARK + rest)]
            tail = words.pop()
            state, count = self.transducer.run(self.transducer.start, MARK + tail)
            made = StateMap(self.transducer, head, count + sum(map(self.words.__getitem__, words)), state)
        made(self.transducer.run(self.transducer.start, before)[0])
        return made

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``."""
        return StateMap(self.transducer, parts=(a, b))

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes of the composition, in a logarithmic number of rounds of independent steps."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def maps(self, text: str, chunk: int) -> list[StateMap]:
        self.transducer.tidy()  # the cached words keep counts, not states
        marked = MARK + text.replace(" ", MARK)
        return [self.chunk_map(marked[i:i + chunk], marked[max(0, i - WARM_UP):i]) for i in range(0, len(marked), chunk)]

    def prefix_counts(self, text: str, chunk: int = CHUNK) -> list[int]:
        """The count up to the end of each chunk, as if the text ended there; none for an empty text."""
        return [m(self.transducer.start)[1] for m in self.scan(self.maps(text, chunk))] if text else []

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """The last prefix alone: neighbouring maps are composed until one is left."""
        maps = self.maps(text, chunk) if text else []
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0](self.transducer.start)[1] if maps else 0


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model; refuses kinds that the transducer does not cover."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm, normal, own = model.normalizer_spec, 1, 4
    pieces = {p.piece: p.score for p in model.pieces if p.type == normal}
    if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or any(p.type == own for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in pieces)):
        raise ValueError(f"{path}: only byte-fallback BPE with identity normalisation and leading word marks is supported")
    return pieces


@lru_cache(maxsize=2)
def counter(path: str) -> ChunkCounter:
    """One per Python worker, shared by the tasks that run in it."""
    return ChunkCounter(CountTransducer(read_vocabulary(path)))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``vocabulary`` is a path every executor has."""

    def start():
        count = counter(vocabulary).count

        def work(batch: pa.RecordBatch):
            texts = as_texts(batch["text"])
            tokens = [count(t) for t in texts]
            return batch["doc_id"], [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]

        return work

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
                     start)
