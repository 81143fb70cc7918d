"""Parts of the text operators against their definitions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanfold.llm import components, decontamination, hashing, language_id, near_dedup, packing, pii, subword_lm
from fanfold.llm import substring_dedup, token_counts, toxicity
from fanfold.llm.queries import tokenizer_file

ODD_TEXT = st.text(st.one_of(st.sampled_from("ab .,'\n\t▁1é日İΣ"), st.characters(blacklist_categories=("Cs",))), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=ODD_TEXT, chunk=st.integers(1, 9))
def test_chunks_compose_to_the_whole_count(counter, library, text, chunk):
    assert counter.count(text, chunk) == len(library.encode(text))


def test_prefix_counts_are_counts_of_prefixes(counter, library):
    text = "the transducer  reads any chunk of it"
    counts = counter.prefix_counts(text, 7)
    # The first character of the marked text is the mark put before it.
    assert counts == [len(library.encode(text[:7 * i - 1])) for i in range(1, len(counts))] + [len(library.encode(text))]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD_TEXT, max_size=5))
def test_words_are_coded_as_in_the_whole_text(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain, coded = Tokenizer.from_file(path), packing.word_coder(path)([t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


ADDED = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|end", "oftext|>", "<|"]
PIECES = [*ADDED, "don't", "'S", "we're", "'", "''s", "$$", "A", "x1", "42", ".", ",", "İ", "ǅ", "É", "é", "e\u0301", "ſ", "中", "文字", "\u00a0", "\x85",
          "²", "\u0345", "Σ", "ς", "ı", "ß", "ﬁ", "\u0130", "١", "-", "\u2019s", " ", " ", " ", "\n", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=3))
def test_word_codes_with_added_tokens_and_odd_letters(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain, coded = Tokenizer.from_file(path), packing.word_coder(path)([t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_simple_letter_is_one():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = [f"a{chr(c)}b$ {chr(c)} x{chr(c)}" for c in range(0x21, 0x600) if not 0xd800 <= c < 0xe000]
    plain, coded = Tokenizer.from_file(path), packing.word_coder(path)([t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("low, high, n", [(1, 2047, 500), (300, 1200, 400), (1, 60, 800), (1025, 2047, 50), (2047, 2047, 3)])
def test_local_search_keeps_documents_and_never_adds_bins(low, high, n):
    lengths = sorted((random.Random(n).randint(low, high) for _ in range(n)), reverse=True)
    greedy = packing.Bins(lengths, 2048)
    greedy.fill_greedily(list(range(n)))
    bins = packing.pack_block(lengths, 2048)
    fills = {}
    for b, size in zip(bins, lengths):
        fills[b] = fills.get(b, 0) + size
    assert len(bins) == n and max(fills.values()) <= 2048
    assert -(-sum(lengths) // 2048) <= len(fills) <= len(greedy.bins)


def test_word_hashes_follow_words():
    texts = ["a b\u000ba", "", "é  a", " x\n", " y"]
    hashes, bounds = hashing.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().split()]
    assert np.diff(bounds).tolist() == [len(t.encode().split()) for t in texts] and len(words) == len(hashes)
    assert len(set(hashes.tolist())) == len(set(words))
    assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(words, hashes.tolist()), 2))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=6), size=st.integers(2, 12))
def test_equal_windows_choose_equal_anchors(texts, size):
    windows = substring_dedup.Windows([" ".join(t).encode() for t in texts], size)
    chosen = {}
    for text, start, low, high, at in zip(windows.text, windows.start, windows.low, windows.high, windows.at):
        words = tuple(texts[text][start:start + size])
        assert len(words) == size
        assert at <= low < high <= at + size
        assert chosen.setdefault(words, (low - at, high - at)) == (low - at, high - at)
    assert len(windows.at) == sum(max(0, len(t) - size + 1) for t in texts)


@settings(max_examples=150, deadline=None)
@given(items=st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=5),
       text=st.lists(st.sampled_from("abcde"), max_size=40), window=st.integers(2, 5))
def test_automaton_finds_every_window(items, text, window):
    coded = [(str(i), [w.encode() for w in words]) for i, words in enumerate(items)]
    spans, named = decontamination.SuffixAutomaton(coded, window).spans([w.encode() for w in text])
    hit, expected = set(), set()
    for i, words in enumerate(items):
        k = min(len(words), window)
        for at in range(len(words) - k + 1 if k else 0):
            for b in range(len(text) - k + 1):
                if text[b:b + k] == words[at:at + k]:
                    hit.update(range(b, b + k))
                    expected.add(str(i))
    assert {p for a, b in zip(spans[::2], spans[1::2]) for p in range(a, b)} == hit and named == expected
    assert spans == sorted(spans)


def test_cutting_spans_leaves_the_rest():
    assert decontamination.cut(b"One, two THREE; four five.", [1, 3], 1) == b"One, four five."
    assert decontamination.cut(b"a b c", [0, 3], 1) == b""
    assert decontamination.cut(b"a b c", [1, 2], 2) == b"a b c"


def test_sequential_verification_is_the_posterior():
    least = near_dedup.least_matches(0.75, 1e-6)
    for batches, m in enumerate(least, 1):
        n = 32 * batches
        grid = (np.arange(200_000) + 0.5) / 200_000

        def above(matches):
            density = np.exp(matches * np.log(grid) + (n - matches) * np.log1p(-grid))
            return density[grid >= 0.75].sum() / density.sum()

        assert above(m) >= 1e-6 > above(m - 1)


def test_survivors_drop_only_below_the_bound():
    least = near_dedup.least_matches(0.75, 1e-6)
    a = np.zeros((3, 128), np.uint16)
    b = a.copy()
    b[1, :] = 1
    b[2, ::4] = 1  # three quarters match
    alive, matches = near_dedup.survivors(a, b, least)
    assert alive.tolist() == [0, 2] and matches.tolist() == [128, 96]


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in found} == {(x, root(x)) for x in linked} and len(found) == len(linked)


def test_lattice_sums_all_segmentations():
    lattice = subword_lm.Lattice(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "c"])
    weights = lattice.weights(lattice.first_uses([-1, -2, -3, -4, -5, -6, -7, -8])[:, None])

    def total(text, at=0):
        if at == len(text):
            return 1.0
        ways = sum(math.exp(weights[lattice.pieces.index(text[at:b]), 0]) * total(text, b)
                   for b in range(at + 1, len(text) + 1) if text[at:b] in lattice.pieces)
        if text[at] not in lattice.pieces:
            ways += math.exp(weights[lattice.n, 0] * len(text[at].encode())) * total(text, at + 1)
        return ways

    words = ["a", "ab", "abab", "cab", "bbbbaba", "éa", "", "a" * 14]
    logs = lattice.sums(words, weights)[:, 0]
    assert np.allclose(logs, [math.log(total("▁" + w)) for w in words])
    # Expected uses are the derivatives of the sums.
    uses = lattice.sums(words, weights, np.ones(len(words)))
    for piece in range(lattice.n + 1):
        moved = weights.copy()
        moved[piece] += 1e-6
        assert (lattice.sums(words, moved).sum() - logs.sum()) / 1e-6 == pytest.approx(uses[piece], abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-9, 9)] * 3), min_size=1, max_size=5), st.floats(0.1, 9))
def test_viterbi_is_the_best_path(rows, penalty):
    scores = np.array(rows)

    def value(path):
        return sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    best = max(value(p) for p in itertools.product(range(3), repeat=len(rows)))
    assert value(language_id.viterbi(scores, penalty).tolist()) == pytest.approx(best)


@pytest.mark.parametrize("text, found", [
    ("write to kim [at] sample [dot] org soon", ["email:kim [at] sample [dot] org"]),
    ("write to kim.lee at mail dot sample dot com.", ["email:kim.lee at mail dot sample dot com"]),
    ("ring plus four nine three zero one two three four five six", ["phone:plus four nine three zero one two three four five six"]),
    ("host one zero dot zero dot zero dot seven up", ["ip:one zero dot zero dot zero dot seven"]),
    ("＋４９ ３０ １２３４５６", ["phone:＋４９ ３０ １２３４５６"]),
    ("kіm@sample.org and +49 30 1234567", ["email:kіm@sample.org", "email:m@sample.org", "phone:+49 30 1234567"]),
    ("look at the dot over there at noon", []),
    ("one two three of them", []),
    ("", []),
])
def test_disguises_map_back_to_the_source(text, found):
    spans = pii.all_spans(text, pii.base_spans(text))
    assert [f"{kind}:{text[a:b]}" for kind in pii.KINDS for a, b in spans[kind]] == found


def test_redaction():
    assert pii.redact("a kim@sample.org b") == "a [email] b"
    assert pii.redact("a kіm@sample.org b") == "a [email] b"


def test_lexicon_folds_counts_and_excepts():
    lexicon = toxicity.Lexicon({" grot": 3.0, " vile ": 2.0}, ["vile weather"])
    assert [w for _, w in lexicon.matches(toxicity.fold("A GROTTY gr0tty vile, vileness"))] == [3.0, 3.0, 2.0]
    assert lexicon.matches(toxicity.fold("such vile weather")) == []
    assert lexicon.matches(toxicity.fold("")) == []
    assert toxicity.fold("grоtty") == " grotty "  # a Cyrillic letter


def test_words_of_texts_keep_their_places():
    words = language_id.Words(["ab cd", "", "é1"])
    assert words.lengths.tolist() == [2, 2, 1] and words.bounds.tolist() == [0, 2, 2, 3]
    assert words.buckets().shape == (3, 5) and words.buckets().max() < 3 * language_id.BUCKETS
    # A word's buckets do not depend on what stands around it.
    alone = language_id.Words(["cd"]).buckets()
    assert (words.buckets()[:, 2:4] == alone).all()


def test_components_that_are_stars_already_take_no_step(spark, rows, monkeypatch):
    steps, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: steps.append(1) or write(df))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 1), (4, 2), (4, 4), (5, 1)], "a long, b long")
    assert rows(components.components(stars)) == [(1, 1), (2, 2), (4, 2), (5, 1), (7, 1), (9, 1)]
    assert len(steps) == 1
    assert rows(components.components(stars.where("a > 100"))) == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(i + 2, i + 1) for i in range(0, 39, 2)], "a long, b long")
    assert rows(components.components(chain)) == sorted([(i, 0) for i in range(41)], key=repr)


def test_steps_of_components_list_no_edge_twice(spark, monkeypatch):
    plans, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    edges = [(i, 1) for i in range(2, 300)] + [(300, 299), (1, 300), (0, 5)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(found) == [(i, 0) for i in range(301)]
    assert len(plans) > 1 and not any("Generate" in p or "Expand" in p for p in plans)


def test_later_links_work_on_components_not_on_their_nodes(spark, rows, monkeypatch):
    sizes = []
    monkeypatch.setattr(near_dedup, "components", lambda edges: sizes.append(edges.count()) or components.components(edges))
    known = [(i, i % 3) for i in range(300)]
    links = [(7, 9), (300, 4), (302, 301), (5, 2)]
    found = near_dedup.joined(spark.createDataFrame(known, "node long, component long"), spark.createDataFrame(links, "a long, b long"))
    assert sizes == [4]
    want = [(i, 2 if i % 3 == 2 else 0) for i in range(300)] + [(300, 0), (301, 301), (302, 301)]
    assert rows(found) == sorted(want, key=repr)
    assert rows(near_dedup.joined(found, spark.createDataFrame([], "a long, b long"))) == rows(found)


def test_sketches_drop_pairs_below_the_threshold_and_no_link():
    rng = np.random.default_rng(5)
    for size in (1, 5, 40, 300, 4000):
        dropped = 0
        for share in rng.uniform(0.3, 1, 60):
            pool = rng.integers(0, 1 << 64, 2 * size, np.uint64)
            common = int(share * size)
            sets = [np.unique(pool[:size]), np.unique(np.concatenate([pool[:common], pool[size:2 * size - common]]))]
            a, b = (np.concatenate([near_dedup.signature(s), near_dedup.sketch(s), [len(s)]])[None, :] for s in sets)
            both = len(np.intersect1d(*sets))
            linked = 100 * both >= 75 * (len(sets[0]) + len(sets[1]) - both)
            possible = bool(near_dedup.may_link(a, b, 75)[0])
            assert possible or not linked
            dropped += not possible
        assert dropped or size > 300
    assert not near_dedup.may_link(*(np.concatenate([np.zeros(near_dedup.PROFILE - 1, np.int64), [n]])[None, :] for n in (74, 100)), 75)[0]
