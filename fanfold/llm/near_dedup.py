"""Near-duplicate detection: banded MinHash, sequential Bayesian verification, exact links, connected components.

1. Texts with the same set of shingles are one class; its first row stands for it. Copies need no signature of their own.
2. A class's signature has 128 MinHash values of 16 bits; four make the key of a band. Classes that share a band are
   candidates: first each class of a bucket with the bucket's smallest (a star). After those links are known, buckets that
   still hold several components are compared in blocks, across components. That is done in steps, the likeliest
   pairs first; each pair belongs to one step, and is left out only if its texts are in one component by then. So no link
   between components is missed, and no bucket has to list the pairs of a group that is one component already.
3. A candidate pair's signatures are compared in batches. After each, the pair is dropped when the posterior probability
   of a similarity of at least the threshold is below ``MISS``, or when sketches of the full sets show that they differ in
   too many members. So a large group of texts that are somewhat less alike is not listed pair by pair.
4. The survivors' full sets decide: 100 * intersection >= percent * union.
5. Links make components; a component's id is its smallest doc_id.

A pair of exactly the threshold's similarity shares no band with probability (1 - 0.75 ** 4) ** 32 < 6e-6.

Every step is keyed by pair, class or salted block; hot buckets, pivots and groups of copies are spread.
Sets are made again from the texts where survivors need them; a bitmap of bounded size tells which.

Defined cases: NULL, empty and blank texts have no shingles and are linked with nothing: each is its own component and
stays. A NULL doc_id comes last in its component. Rows that repeat a doc_id are documents of their own; of those with the
smallest doc_id of a component the first in the input stays. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import as_bytes, give_back, id_and_text, spread, text_key
from fanfold.llm.components import components
from fanfold.llm.hashing import in_parts, mixed, window_hashes, word_hashes
from fanfold.session import materialize

WORDS = 5
PERCENT = 75
ROWS, BANDS = 4, 32
BATCH = 32  # signature values compared at once
STEPS = (-6,)  # matches above those expected at the threshold, at which a step of the comparison across components ends
SKETCH = 2048  # bits
PROFILE = BANDS + SKETCH // 64 + 1
MISS = 1e-6  # posterior probability of a link at which a pair is dropped
PART_BYTES = (1 << 18) - 1024  # with the gaps between texts still within the powers that hashing starts with
BATCH_ROWS = 500  # documents whose sets a task holds at once
BLOCK = 2048  # classes of a bucket in a block: two blocks are compared in a second or so, and are 1.2 MB
MEMBERS = 200  # sets compared with a pivot in one group
BITMAP = 1 << 26  # bits, at most: 8 MB

_random = np.random.Generator(np.random.PCG64(7))
_FACTORS = _random.integers(1 << 32, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
_TERMS = _random.integers(1, 1 << 64, ROWS * BANDS, np.uint64)


def shingle_sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for begin, end in in_parts(texts, PART_BYTES):
        hashes, bounds = word_hashes([t.lower() for t in texts[begin:end]])
        windows = window_hashes(hashes, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(windows[a:b - size + 1])
            elif b > a:  # fewer words: the whole sequence is one shingle, unlike any longer one
                yield mixed(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of 16 bits, as one 64-bit key per band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        permuted = _FACTORS[:, None] * shingles[None, at:at + 512] + _TERMS[:, None]
        np.minimum(least, permuted.min(1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For every remainder of a hash by ``SKETCH`` whether it is left an odd number of times, as bits of 64-bit values.

    Two sets differ in at least as many members as their sketches do in bits.
    """
    odd = np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches and sizes of pairs of profiles leave a similarity of at least ``percent`` possible.

    100 * common >= percent * union says the same as (100 + percent) * differing <= (100 - percent) * both sizes.
    """
    # Unsigned: of a negative number bitwise_count counts the bits of its absolute value.
    differing = np.bitwise_count((a[:, BANDS:-1] ^ b[:, BANDS:-1]).astype(np.uint64)).sum(1, dtype=np.int64)
    differing = np.maximum(differing, np.abs(a[:, -1] - b[:, -1]))
    return (100 + percent) * differing <= (100 - percent) * (a[:, -1] + b[:, -1])


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bit_of(key: bytes, bits: int) -> int:
    return int.from_bytes(key[:8], "little") % bits


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: sets take more room than their texts."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, set_key and sig (NULL without shingles): its profile, which is the keys of
    its bands, its sketch and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, keys, sigs = [], [], []
            for shingles in shingle_sets(as_bytes(batch["text"])):
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                sigs.append(np.concatenate([signature(shingles), sketch(shingles), [len(shingles)]]) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])
        give_back()

    return id_and_text(docs, id_col, text_col).withColumn("text_key", text_key("text")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, set_key binary, sig array<long>")


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = ROWS * BANDS) -> list[int]:
    """For every number of batches seen, the fewest matches with which a pair goes on.

    With a uniform prior the similarity's posterior after m of n matches is Beta(m + 1, n - m + 1).
    """
    out = []
    for n in range(batch, total + 1, batch):
        # P(similarity >= t) after m of n is P(Binomial(n + 1, t) <= m).
        below, least = 0.0, n + 1
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                least = m
                break
        out.append(least)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of ``a`` and ``b`` (16-bit values) that no batch drops, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= m]
    return alive, matches[alive]


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of profiles as rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy().reshape(len(array), PROFILE)


def _signature(profiles: np.ndarray) -> np.ndarray:
    """The 16-bit values of rows of profiles."""
    return np.ascontiguousarray(profiles[:, :BANDS]).view(np.uint16)


def prune(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential verification and the sketches do not drop."""
    least = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _values(batch["sig_a"]), _values(batch["sig_b"])
                alive = survivors(_signature(a), _signature(b), least)[0]
                yield batch.select(["a", "b"]).take(pa.array(alive[may_link(a[alive], b[alive], percent)]))

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def sets_of(nodes: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """node and shingles of ``nodes``, made again from the texts and written once. ``keys`` has node and set_key."""
    needed = materialize(nodes.join(keys, "node"))
    bits = min(BITMAP, 1 << (16 * needed.count() + 1023).bit_length())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for key in batch["set_key"].to_pylist():
                bit = bit_of(key, bits)
                own[bit >> 3] |= 1 << (bit & 7)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].astype(np.int32))], names=["at", "byte"])

    # At most one row for every byte of the bitmap, whatever the input's size.
    found = needed.select("set_key").mapInArrow(marks, "at long, byte int").groupBy("at").agg(
        F.bit_or("byte").alias("byte")).toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    bitmap[found["at"].to_numpy()] = found["byte"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = shared.value, set()
        for batch in small_batches(batches):
            keys, found = [], []
            for shingles in shingle_sets(as_bytes(batch["text"])):
                if len(shingles):
                    key = set_key(shingles)
                    bit = bit_of(key, bits)
                    if marked[bit >> 3] >> (bit & 7) & 1 and key not in seen:  # copies in a task are sent once
                        seen.add(key)
                        keys.append(key)
                        found.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["set_key", "shingles"])
        give_back()

    made = texts.select("text").mapInArrow(sets, "set_key binary, shingles binary").groupBy("set_key").agg(
        F.first("shingles").alias("shingles"))
    return materialize(needed.join(made, "set_key").select("node", "shingles"))


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, written once."""
    # A pivot's members are dealt to groups of bounded size; the pivot's set goes to each.
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups"))
    left = pairs.join(groups, "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("member_set")), "a").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("salt"), "member_set")
    right = groups.select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).join(
        sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_set")), "pivot")

    def compare(members: pa.Table, pivot: pa.Table) -> pa.Table:
        own = np.frombuffer(pivot["pivot_set"][0].as_py(), np.uint64) if pivot.num_rows else None
        alike = []
        for shingles in members["member_set"].to_pylist():
            other = np.frombuffer(shingles, np.uint64)
            common = len(np.intersect1d(own, other, assume_unique=True))
            alike.append(100 * common >= percent * (len(own) + len(other) - common))
        return members.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return materialize(left.groupBy("b", "salt").cogroup(right.groupBy("pivot", "part")).applyInArrow(compare, "a long, b long"))


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) after more ``links`` (a, b), written once.

    Components stand for their nodes: only those that the links join are worked on, however many nodes they have.
    """
    numbers = both_ends(links).join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    numbers = materialize(numbers)
    ends = [numbers.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")) for end in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    merged = materialize(components(between).select(F.col("node").alias("component"), F.col("component").alias("least")))
    return materialize(known.unionByName(numbers).distinct().join(spread(merged, merged.count()), "component", "left").select(
        "node", F.coalesce("least", "component").alias("component")))


def leftover_pairs(members: DataFrame, sigs: DataFrame, known: DataFrame, least: list[int], percent: int, low: int, high: int) -> DataFrame:
    """Pairs of different components in buckets that hold several, which verification and the sketches do not drop, with at
    least ``low`` and less than ``high`` matches.

    ``members``: band, key, node; ``known``: node, component of the nodes that have links.
    """
    labelled = members.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "component"))
    mixed_buckets = sizes.groupBy("band", "key").agg(largest.alias("largest"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = labelled.join(mixed_buckets.select(
        "band", "key", F.col("largest.component").alias("main"), blocks(F.col("largest.n")).alias("main_blocks"),
        blocks(F.col("others")).alias("blocks")), ["band", "key"])
    # The largest component of a bucket is dealt to blocks -1, -2, … and meets only the blocks 0, 1, … of the others, which
    # meet each other too: a few strays beside many near copies are what is sent to every block, not the copies.
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    rows = rows.withColumn("block", F.when(is_main, -1 - own).otherwise(own))
    meet = lambda n, pair: F.transform(F.sequence(F.lit(0), n - 1), pair)
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    block = F.col("block")
    groups = F.when(is_main, meet(F.col("blocks"), lambda b: xy(block, b))).otherwise(F.concat(
        meet(F.col("main_blocks"), lambda b: xy(-1 - b, block)), meet(F.col("blocks"), lambda b: xy(F.least(block, b), F.greatest(block, b)))))
    dealt = rows.select("node", "component", "band", "key", "block", F.inline(groups)).join(sigs.select("node", "sig"), "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes, comp = table["node"].to_numpy(), table["component"].to_numpy()
        profiles = _values(table["sig"])
        values, keys = _signature(profiles), profiles[:, :BANDS]
        band, block = int(table["band"][0].as_py()), table["block"].to_numpy()
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        left = np.flatnonzero(block == x)
        right = np.flatnonzero(block == y)
        out_a, out_b = [], []
        for i in left.tolist():
            js = right[comp[right] != comp[i]]
            if x == y:
                js = js[nodes[js] < nodes[i]]
            # The first band a pair shares is the one that compares it.
            js = js[~(keys[js, :band] == keys[i, :band]).any(1)]
            if len(js):
                alive, matches = survivors(np.broadcast_to(values[i], (len(js), values.shape[1])), values[js], least)
                js = js[alive[(matches >= low) & (matches < high)]]
                js = js[may_link(profiles[[i]], profiles[js], percent)]
                out_a += np.maximum(nodes[js], nodes[i]).tolist()
                out_b += np.minimum(nodes[js], nodes[i]).tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("band", "key", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_key, which tells texts apart."""
    texts = id_and_text(docs, id_col, text_col)
    rows = materialize(signatures(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    classes = materialize(rows.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min_by("sig", "row").alias("sig"), F.min("row").alias("node"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")))
    sigs = classes.select("node", "sig")
    bands = sigs.select("node", F.posexplode(F.slice("sig", 1, BANDS)).alias("band", "key"))
    buckets = materialize(bands.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
                          .where("n > 1").select("band", "key", "pivot"))
    members = materialize(bands.join(buckets, ["band", "key"]))
    keys = classes.select("node", "set_key")
    stars = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = materialize(prune(stars, sigs, percent, miss))
    sets = sets_of(both_ends(pairs), keys, texts)
    known = materialize(components(exact_links(pairs, sets, percent)))
    members = members.select("band", "key", "node")
    least, total = least_matches(percent / 100, miss), ROWS * BANDS
    lows = [min(total, max(least[-1], total * percent // 100 + step)) for step in STEPS] + [least[-1]]
    for high, low in zip([total + 1, *lows], lows):
        rest = materialize(leftover_pairs(members, sigs, known, least, percent, low, high).join(pairs, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            new = materialize(both_ends(rest).join(sets, "node", "left_anti"))
            if not new.isEmpty():
                sets = sets.unionByName(sets_of(new, keys, texts))
            known = joined(known, exact_links(rest, sets, percent))
    labelled = classes.select("set_key", "node", "first").join(known, "node", "left").select(
        "set_key", "first", F.coalesce("component", "node").alias("component"))
    firsts = labelled.groupBy("component").agg(F.min("first").alias("first"))
    found = materialize(labelled.select("set_key", "component").join(firsts, "component").select(
        "set_key", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row")))
    return rows.select("doc_id", "text_key", "n_shingles", "set_key", "row").join(found, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a)
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id)
"""
