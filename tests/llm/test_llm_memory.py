"""What a Python worker holds at once and keeps, which counts beside the heap of its executor."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fanfold.llm import hashing, language_id, near_dedup, packing
from fanfold.llm.queries import tokenizer_file
from fanfold.session import materialize

MB = 1_000_000


def words(seed: int, count: int, length: int) -> list[bytes]:
    letters = np.random.Generator(np.random.PCG64(seed)).integers(97, 123, (count, length), np.uint8)
    return [row.tobytes() for row in letters]


def traced(run) -> tuple[int, int]:
    """Bytes held after ``run`` and at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("count", "length", "most"), [(20_000, 10, 30 * MB), (500, 2_000, 25 * MB)])
def test_the_cache_of_words_is_bounded(count, length, most):
    coder = packing.word_coder.__wrapped__(tokenizer_file("word_bpe_49k.json"))
    first = [b" ".join(words(0, count, length)), b"the same words"]
    ids = coder(first)

    def run():
        for seed in range(1, 15):
            coder([b" ".join(words(seed, count, length))])

    assert traced(run)[0] < most
    assert coder(first) == ids


def test_words_that_come_again_are_coded_once(monkeypatch):
    import tokenizers

    real, coded, path = tokenizers.Tokenizer, Counter(), tokenizer_file("word_bpe_49k.json")

    class Recording:
        def __init__(self, model=None, whole=None):
            object.__setattr__(self, "whole", whole or real(model))

        from_file = classmethod(lambda cls, path: cls(whole=real.from_file(path)))
        __getattr__ = lambda self, name: getattr(self.whole, name)
        __setattr__ = lambda self, name, value: setattr(self.whole, name, value)

        def encode_batch_fast(self, texts, **how):
            coded.update(word for text in texts for word in text.split())
            return self.whole.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Recording)
    monkeypatch.setattr(packing, "CACHED_WORDS", 4000)
    coder, often = packing.word_coder.__wrapped__(path), words(0, 500, 8)
    texts = [b" ".join(often + words(seed, 1500, 8)) for seed in range(1, 10)]
    ids = [coder([text])[0] for text in texts]
    assert {coded[word.decode()] for word in often} == {1}
    plain = real.from_file(path)
    for text, own in zip(texts, ids):
        assert np.frombuffer(own, "<u4").tolist() == plain.encode(text.decode(), add_special_tokens=False).ids


def test_words_of_small_letters_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    small = [chr(c) for c in range(0x61, 0x600) if packing.LOWER.fullmatch(chr(c))]
    texts = [" ".join(f"{a}{b}th{a}" for b in small[at::97]) for at, a in enumerate(small)]
    plain, coded = Tokenizer.from_file(path), packing.word_coder(path)([t.encode() for t in texts])
    assert len(small) > 400
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_labelling_takes_little_memory_at_once():
    sizes = len(language_id.ORDERS) * language_id.BUCKETS, len(language_id.SCRIPT_NAMES)
    model = language_id.Model(["a", "b", "c", "d"], np.ones((sizes[0], 4)), np.ones((sizes[1], 4)))
    texts = [" ".join(w.decode() for w in words(seed, 300, 7)) for seed in range(200)]
    list(model.label(texts[:1]))  # the tables of letters
    assert traced(lambda: list(model.label(texts)))[1] < 30 * MB


def test_sets_take_little_memory_at_once():
    texts = [b" ".join(words(seed, 300, 7)) for seed in range(400)]
    hashing._powers.clear()
    found = [s.copy() for s in near_dedup.shingle_sets(texts)]
    hashing._powers.clear()
    assert traced(lambda: [None for _ in near_dedup.shingle_sets(texts)])[1] < 25 * MB
    for text, own in zip(texts[::50], found[::50]):
        assert np.array_equal(next(near_dedup.shingle_sets([text])), own)


def test_a_written_step_holds_few_long_rows_at_once(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key, None)
    spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("x"), 10_000).alias("text")).write.parquet(f"{tmp_path}/t")
    found = materialize(spark.read.parquet(f"{tmp_path}/t").mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r.rows for r in found) == 2000 and max(r.bytes for r in found) < 1.5 * MB
    assert spark.conf.get(key, None) == before
