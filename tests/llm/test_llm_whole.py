"""Results do not depend on bounds of what is broadcast, nor on shortcuts."""

from __future__ import annotations

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from fanfold.llm import pii, subword_lm
from fanfold.llm.common import in_remainder, table
from fanfold.llm.queries import tokenizer_file


def test_scores_do_not_depend_on_how_many_words_are_broadcast(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")

    def scores(most):
        monkeypatch.setattr(subword_lm.frequent_words, "__defaults__", (most,))
        rows = subword_lm.score(docs, ~in_remainder("doc_id", 5, 1), tokenizer_file("piece_bpe_32k.model")).collect()
        return {r.doc_id: (r.n_known, r.base_score, r.score) for r in rows}

    all_words = scores(1_000_000)
    for most in (0, 50, 3000):
        some = scores(most)
        assert some.keys() == all_words.keys()
        assert all(some[d] == pytest.approx(all_words[d], rel=1e-5) for d in some)


PARTS = st.sampled_from([*"a1 9.,-([{<>})]@\t\n", "plus ", "Plus", " at ", " dot ", "dot", "at", "ät", "point", "punkt", "one", "zwei",
                         "name", "host", "com", "а", "é", "＠", "٣"])


@settings(max_examples=2000, deadline=None)
@example(["call plus 49 151 2345678 now"])
@given(st.lists(PARTS, max_size=14))
def test_texts_that_no_gate_opens_for_stay_as_they_are(parts):
    text = "".join(parts)
    if not pii.is_disguised(text):
        assert pii.normalise(text).text == text


@pytest.mark.parametrize(("text", "phone"), [("call plus 49 151 2345678 now", "plus 49 151 2345678"), ("plus 1 (212) 555-0199", "plus 1 (212) 555-0199")])
def test_a_spelled_plus_alone_is_a_disguise(text, phone):
    spans = pii.all_spans(text, pii.base_spans(text))
    assert [text[b:e] for b, e in spans["phone"]] == [phone]
