"""Fill-in-middle transformation over seekable compressed frames.

:func:`store` cuts a text at every ``frame_bytes`` bytes (between code points) into frames that are compressed by zstandard
on their own, and notes how many units and code points lie before each. :func:`infill` finds the two cuts of a text by
these counts, decompresses only the frames that hold a cut, and moves every other frame unopened to its place in the output.
:func:`digests`, :func:`restore` and :func:`texts` read an output's frames in order, one at a time; ``restore`` finds the
marks in the output and uses nothing else but its form. Nothing is shuffled, and a lost task repeats its own rows only.

A unit is a word with the white space before it (``[\\x20\\x09-\\x0D]``), or the white space that ends a text. The prefix ends
after the smaller and the middle after the larger of two unit numbers drawn from the document's id.

Defined cases: NULL text counts as empty. Texts that are empty, that contain a mark, or that the draw leaves out are
``plain``: the output is the text, and prefix_chars and middle_chars are NULL. A NULL doc_id draws as an empty id.
Rows that repeat an id are transformed each for itself; an empty table gives an empty result. Other columns are not
read. A word longer than a frame spans frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from fanfold.llm.common import as_bytes, id_and_text, per_batch

FRAME_BYTES = 1 << 16
LEVEL = 1

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

STORED = ("doc_id long, n long, n_bytes long, n_chars long, marked boolean, "
          "units array<long>, chars array<long>, starts array<long>, frames array<binary>")
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, starts array<long>, frames array<binary>"
DIGESTS = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
           "restored_sha256 string")

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(raw: bytes) -> np.ndarray:
    """Where white space follows a word inside ``raw``; its own end is not among them."""
    gap = _GAP[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(~gap[:-1] & gap[1:]) + 1


def count_chars(raw: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80))


def cut_frames(raw: bytes, frame_bytes: int) -> Iterator[tuple[int, bytes, bool]]:
    """Start, bytes and whether a unit ends with the frame."""
    at = 0
    while at < len(raw):
        end = min(at + frame_bytes, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield at, raw[at:end], end == len(raw) or (not _GAP[raw[end - 1]] and bool(_GAP[raw[end]]))
        at = end


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES,
          level: int = LEVEL) -> DataFrame:
    """Every text as independent frames with the units, code points and bytes before each; may be written as it is."""

    def start():
        pack = zstandard.ZstdCompressor(level=level)

        def one(raw: bytes):
            n = chars = 0
            units, before, starts, frames = [], [], [], []
            for at, part, ends in cut_frames(raw, frame_bytes):
                units.append(n)
                before.append(chars)
                starts.append(at)
                frames.append(pack.compress(part))
                n += len(unit_ends(part)) + ends
                chars += count_chars(part)
            return n, len(raw), chars, any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)), units, before, starts, frames

        def work(batch: pa.RecordBatch) -> Sequence:
            rows = [one(raw) for raw in as_bytes(batch.column(1))]
            return [batch.column(0), *(zip(*rows) if rows else [[]] * 8)]

        return work

    return per_batch(id_and_text(docs, id_col, text_col), STORED, start)


class Frames:
    """A sequence of frames that is read from any byte on, one frame at a time."""

    def __init__(self, starts: Sequence[int], frames: Sequence[bytes], open_frame):
        self.starts, self.frames, self.open_frame = starts, frames, open_frame

    def read(self, lo: int = 0, hi: int | None = None) -> Iterator[bytes]:
        """The bytes from ``lo`` to ``hi`` (the end if not given), frame by frame."""
        for i in range(max(bisect_right(self.starts, lo) - 1, 0), len(self.starts)):
            at = self.starts[i]
            if hi is not None and at >= hi:
                return
            part = self.open_frame(self.frames[i])
            yield part[max(lo - at, 0):None if hi is None else hi - at]

    def section(self, lo: int, hi: int, n_bytes: int, pack) -> Iterator[tuple[int, bytes]]:
        """Size and frame of everything from ``lo`` to ``hi``; only frames at a cut are opened and packed anew."""
        for i in range(max(bisect_right(self.starts, lo) - 1, 0), len(self.starts)):
            at = self.starts[i]
            end = self.starts[i + 1] if i + 1 < len(self.starts) else n_bytes
            if at >= hi or lo == hi:
                return
            if lo <= at and end <= hi:
                yield end - at, self.frames[i]
            else:
                part = self.open_frame(self.frames[i])[max(lo - at, 0):hi - at]
                if part:
                    yield len(part), pack(part)

    def find(self, mark: bytes, lo: int) -> int:
        """Place of the first ``mark`` from ``lo`` on, also where two frames share it."""
        held, at = b"", lo
        for part in self.read(lo):
            held += part
            found = held.find(mark)
            if found >= 0:
                return at + found
            at += max(len(held) - len(mark) + 1, 0)
            held = held[max(len(held) - len(mark) + 1, 0):]
        raise ValueError(f"the output holds no {mark.decode()}")


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def locate(k: int, units: Sequence[int], chars: Sequence[int], starts: Sequence[int], frames: Sequence[bytes],
           open_frame) -> tuple[int, int]:
    """Bytes and code points before the end of the k-th unit; opens the frame that holds it."""
    if k == 0:
        return 0, 0
    i = bisect_left(units, k) - 1
    raw = open_frame(frames[i])
    ends, nth = unit_ends(raw), k - units[i]
    size = int(ends[nth - 1]) if nth <= len(ends) else len(raw)
    return starts[i] + size, chars[i] + count_chars(raw[:size])


def infill(stored: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, level: int = LEVEL) -> DataFrame:
    """The outputs of :func:`store`'s texts as frames: ``rate`` in a hundred are cut, and ``spm_rate`` in a hundred of these
    begin with the suffix."""

    def start():
        packer, unpacker = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
        pack, unpack = packer.compress, unpacker.decompress
        marks = {m: (len(m), pack(m)) for m in (PREFIX, SUFFIX, MIDDLE)}

        def one(doc_id, n, n_bytes, marked, units, chars, starts, frames):
            h1, h2, h3, h4 = draws(doc_id, seed)
            if not n_bytes or marked or h3 % 100 >= rate:
                return n, "plain", None, None, starts, frames
            last = {}  # the frame opened last; both cuts often lie in one

            def open_frame(frame):
                if id(frame) not in last:
                    last.clear()
                    last[id(frame)] = unpack(frame)
                return last[id(frame)]

            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, a_chars = locate(first, units, chars, starts, frames, open_frame)
            b, b_chars = locate(second, units, chars, starts, frames, open_frame)
            text, form = Frames(starts, frames, open_frame), "spm" if h4 % 100 < spm_rate else "psm"
            head, tail = (PREFIX, 0, a), (SUFFIX, b, n_bytes)
            sizes, out, at = [], [], 0
            for mark, lo, hi in ((tail, head) if form == "spm" else (head, tail)) + ((MIDDLE, a, b),):
                for size, frame in (marks[mark], *text.section(lo, hi, n_bytes, pack)):
                    sizes.append(at)
                    out.append(frame)
                    at += size
            return n, form, a_chars, b_chars - a_chars, sizes, out

        def work(batch: pa.RecordBatch) -> Sequence:
            names = ("doc_id", "n", "n_bytes", "marked", "units", "chars", "starts", "frames")
            rows = [one(*row) for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))]
            return [batch.column(0), *(zip(*rows) if rows else [[]] * 6)]

        return work

    return per_batch(stored, OUTPUT, start)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, from the output and its form alone."""
    if form == "plain":
        yield from output.read()
        return
    # Both forms begin with a mark and end with the middle; what lies between the marks changes places.
    second, width = (PREFIX, SUFFIX)[form == "psm"], len(MIDDLE)
    turn = output.find(second, width)
    end = output.find(MIDDLE, turn + width)
    first, other = (width, turn), (turn + width, end)
    prefix, suffix = (first, other) if form == "psm" else (other, first)
    yield from output.read(*prefix) if prefix[0] < prefix[1] else ()
    yield from output.read(end + width)
    yield from output.read(*suffix) if suffix[0] < suffix[1] else ()


def sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _read(outputs: DataFrame, schema: str, columns: Sequence[str], read) -> DataFrame:
    """``columns`` of the outputs and what ``read`` gives of each output's frames and form."""

    def start():
        unpack = zstandard.ZstdDecompressor().decompress

        def work(batch: pa.RecordBatch) -> Sequence:
            at = batch.schema.get_field_index
            starts, frames, forms = (batch.column(at(c)).to_pylist() for c in ("starts", "frames", "form"))
            rows = [read(Frames(s, f, unpack), form) for s, f, form in zip(starts, frames, forms)]
            made = zip(*rows) if rows else [[]] * (len(schema.split(",")) - len(columns))
            return [*(batch.column(at(c)) for c in columns), *made]

        return work

    return per_batch(outputs, schema, start)


def digests(outputs: DataFrame) -> DataFrame:
    """SHA-256 of every output and of the text rebuilt from it."""
    return _read(outputs, DIGESTS, ("doc_id", "n", "form", "prefix_chars", "middle_chars"),
                 lambda frames, form: (sha256(frames.read()), sha256(restored(frames, form))))


def texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts."""
    return _read(outputs, "doc_id long, form string, output string", ("doc_id", "form"),
                 lambda frames, form: (b"".join(frames.read()).decode(),))


def restore(outputs: DataFrame) -> DataFrame:
    """The texts rebuilt from outputs and forms."""
    return _read(outputs, "doc_id long, text string", ("doc_id",),
                 lambda frames, form: (b"".join(restored(frames, form)).decode(),))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
n AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
