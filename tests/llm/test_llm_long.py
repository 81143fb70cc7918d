"""Very long texts take time in proportion, and long and short paths give the same results."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanfold.llm import language_id, pii, token_counts, toxicity
from fanfold.llm.queries import tokenizer_file

UNSPACED = "".join(chr(c) for c in np.random.Generator(np.random.PCG64(1)).integers(0x3041, 0x3090, 1_000_000))


def seconds(run, *args) -> float:
    begin = time.perf_counter()
    run(*args)
    return time.perf_counter() - begin


@pytest.fixture(scope="module")
def lexicon():
    return toxicity.Lexicon({" vile ": 3.0, " vil": 2.0, " ass ": 4.0}, ["vile weather", "weather vile", "the ass"])


def test_token_counts_of_unspaced_text(monkeypatch):
    counter = token_counts.counter(tokenizer_file("piece_bpe_32k.model"))
    counter.count(UNSPACED[:200_000])  # compiles the transitions
    short, long = seconds(counter.count, UNSPACED[:100_000]), seconds(counter.count, UNSPACED)
    assert long < 15 * short + 1
    import sentencepiece

    library, part = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model")), UNSPACED[:3000]
    for warm_up in (0, 1, 64):
        monkeypatch.setattr(token_counts, "WARM_UP", warm_up)
        for chunk in (5, 64, 1000):
            assert counter.count(part, chunk) == len(library.encode(part))
            assert counter.prefix_counts(part, chunk)[-1] == len(library.encode(part))


@pytest.mark.parametrize("part", ["a-", "a%", "x at ", "x at a.", "@a", " dot ", "one ", "+4 "])
def test_disguises_in_long_texts(part):
    spans = lambda text: pii.all_spans(text, pii.base_spans(text))
    short, long = (seconds(spans, "x dot y " + part * n) for n in (10_000, 100_000))
    assert long < 15 * short + 1


# What a bare address is, by its definition: the leftmost name at which the whole pattern matches.
WHOLE = pii.re.compile(rf"(?<![\w@.])[a-z0-9][a-z0-9._%+-]*{pii._BARE.pattern}", pii.re.I)
BARE = st.sampled_from([*"a1.-_%é@ ", " at ", " dot ", " dot com", "name", "host", " at b dot org", " at c.d dot pl", "  at  "])


@settings(max_examples=3000, deadline=None)
@given(st.lists(BARE, max_size=12).map("".join))
def test_bare_addresses_are_found_as_by_the_whole_pattern(text):
    assert [m.span("at") for m in pii.bare_addresses(text)] == [m.span("at") for m in WHOLE.finditer(text)]


@pytest.mark.parametrize("words", ["vile weather ", "weather vile weather ", "vile x ", "the ass "])
def test_exceptions_in_long_texts(lexicon, words):
    short, long = (seconds(lexicon.matches, toxicity.fold(words * n)) for n in (5_000, 50_000))
    assert long < 15 * short + 1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["vile", "weather", "the", "ass", "vilest", "of"]), max_size=10))
def test_matches_are_those_outside_exceptions(lexicon, words):
    begins = [1 + sum(len(w) + 1 for w in words[:i]) - 1 for i in range(len(words))]
    expected = []
    for i, word in enumerate(words):
        weight = {"vile": 3.0, "vilest": 2.0, "ass": 4.0}.get(word)
        pairs = {" ".join(words[max(j, 0):j + 2]) for j in (i - 1, i)}
        if weight and not pairs & set(lexicon.exceptions):
            expected.append((begins[i], weight))
    assert lexicon.matches(toxicity.fold(" ".join(words))) == expected


def test_whole_words_of_any_length_are_candidates():
    assert toxicity.features(" an ox grazes ") == {" an ", " ox ", " grazes ", " graz", " graze", " grazes"}


@pytest.mark.parametrize("text", ["abc d éя " * 9000, "の" * 60_000 + " a", "abcdefg" * 9000, "a " * 30_001])
def test_languages_by_blocks_of_letters(monkeypatch, text):
    rng = np.random.Generator(np.random.PCG64(2))
    counts = rng.integers(0, 50, (len(language_id.ORDERS) * language_id.BUCKETS, 4)).astype(float)
    model = language_id.Model([*"abcd"], counts, np.ones((len(language_id.SCRIPT_NAMES), 4)))
    words = language_id.Words([text])
    whole = model.word_scores(words)
    monkeypatch.setattr(language_id, "BATCH_CELLS", 4 * 1777)
    np.testing.assert_allclose(model.word_scores(words), whole, rtol=1e-4)
    all_buckets, at = words.buckets(), len(words.letters) // 3
    assert (words.buckets(at, at + 50) == all_buckets[:, at:at + 50]).all()
