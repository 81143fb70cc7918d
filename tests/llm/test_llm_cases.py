"""Defined results for NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fanfold.llm import decontamination, exact_dedup, language_id, near_dedup, packing, pii, subword_lm, substring_dedup
from fanfold.llm import common, token_counts, toxicity
from fanfold.llm.common import in_remainder, keep_rows, text_key
from fanfold.llm.queries import tokenizer_file

WORDS = [f"word{i}" for i in range(60)]
PROSE = " ".join(WORDS)
LONG = " ".join(f"long{i * i % 7919}" for i in range(30_000))
ROWS = [
    (1, PROSE), (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id but with some words of its own in it"),
    (5, PROSE.replace(" ", "\n")), (6, PROSE + "  "), (6, PROSE + "  "), (7, PROSE + " and a tail"), (8, LONG), (9, LONG),
    (10, "short one"), (11, "SHORT one"), (12, "12 34 !!"), (None, None), (13, "é" * 5), (14, "x" * 300_000),
]
CLASHES = {name: "clash" for name in (
    "row", "run", "bin", "block", "score", "lang_pred", "n_words", "spans", "items", "keep_id", "keep_key", "text_key", "sig",
    "set_key", "node", "places", "label", "place", "length", "piece", "kept", "text_to_label", "N_Words")}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    rows = rows.withColumns({"lang": F.when(F.col("doc_id") > 2, F.lit("en")), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return rows.select("*", *[F.lit(v).alias(k) for k, v in CLASHES.items() if k != "N_Words"])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[5:20])), (2, None), (None, "short ONE"), (3, ""), (1, " ".join(WORDS[5:20]))],
                                 "item_id long, text string")


def by_row(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def per_document(value):
    return sorted(((d, *value(t or "")) for d, t in ROWS), key=repr)


def test_exact(docs):
    frame = exact_dedup.deduplicate(docs)
    groups = {}
    for d, t in ROWS:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), d is None, d or 0, d))
    expected = []
    for d, t in ROWS:
        norm = "".join((t or "").split())
        expected.append((d, min(groups[norm])[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    assert by_row(frame, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(expected, key=repr)
    assert frame.where("kept").count() == len(groups)  # one row of each group, repeated rows or not
    assert frame.where("kept AND doc_id = 6").count() == 1


def test_near(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    component = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    # Shingles ignore case and kinds of white space; 10 and 11 have one shingle each, the same.
    assert component == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 10: 10, 11: 10, 12: 12, 13: 13, 14: 14}
    assert sorted(r.n_shingles for r in rows) == sorted(
        len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0 for w in ((t or "").lower().split() for _, t in ROWS))
    assert len(rows) == len(ROWS)
    assert sorted(r.doc_id for r in rows if r.kept and r.doc_id) == [1, 2, 3, 4, 8, 10, 12, 13, 14]


def test_substrings(docs):
    rows = substring_dedup.deduplicate(docs, keep_text=True).collect()
    seen, expected = set(), []
    for d, t in sorted({(d, t) for d, t in ROWS}, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").split()
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        expected += [(d, len(words), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())] * ROWS.count((d, t))
    assert sorted(map(tuple, ((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in rows)), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("text", [["a"] * 60, ["a", "b"] * 30, ["a"] * 25 + ["b"] + ["a"] * 25, list("abcab") * 9])
def test_substrings_of_periodic_texts(spark, text):
    rows = [(1, " ".join(text)), (2, " ".join(text[::-1])), (3, " ".join(["c", *text]))]
    seen, expected = set(), {}
    for d, t in rows:
        words, gone = t.split(), set()
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        expected[d] = len(gone)
    found = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == expected


@pytest.mark.parametrize("block_words", [100_000, 20])
def test_benchmark(docs, items, block_words):
    rows = decontamination.annotate(docs.select("doc_id", "text"), items, block_words=block_words)
    found = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in rows.collect() if r.doc_id}
    assert found[1] == (60, [5, 20], ["1"]) and found[5] == found[1] and found[7][1] == [5, 20]
    assert found[10] == (2, [0, 2], [""]) and found[11][1] == [0, 2]
    assert found[2] == found[3] == found[4] == (0, [], []) and found[12][1] == []
    report = decontamination.report(docs, items)
    assert report.count() == len(ROWS) and report.where("contaminated").count() == 7
    clean = decontamination.decontaminate(docs, items, max_coverage=0.5)
    assert clean.columns == docs.columns
    assert {r.text for r in clean.where("doc_id = 7").collect()} == {" ".join([*WORDS[:5], *WORDS[20:], "and a tail"])}
    assert clean.where("doc_id in (10, 11)").count() == 0 and clean.where("doc_id = 8").first().text == LONG
    assert decontamination.decontaminate(docs, items, max_coverage=0.5, block_words=block_words).exceptAll(clean).isEmpty()
    untouched = decontamination.decontaminate(docs, items, max_coverage=0.0, block_words=block_words)
    assert untouched.columns == docs.columns and untouched.count() == len(ROWS) - 7
    assert untouched.exceptAll(docs).isEmpty()
    empty = items.limit(0)
    assert decontamination.decontaminate(docs, empty, max_coverage=0.0).count() == len(ROWS)
    assert decontamination.report(docs, empty).where("contaminated").count() == 0


def test_packing(docs):
    rows = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=64).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
        assert r.start == 64 * r.piece and 0 < r.length <= 64
    assert len(pieces[6, 0]) == 2 and [r.length for r in pieces[3, 0]] == [1]  # repeated rows; the closing id alone
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = {}
    for sequence, offset, length in places:
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
    assert max(at.values()) <= 64


def test_counts_spans_and_scores_of_every_row(spark, docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = by_row(token_counts.count_tokens(docs, path, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert found == per_document(lambda t: (len(t.encode()), n := len(library.encode(t)), n > 50))
    assert by_row(pii.find(docs), "doc_id", "n_email", "spans") == per_document(lambda t: (0, ""))
    rows = subword_lm.score(docs, ~in_remainder("doc_id", 5, 1), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.doc_id) == sorted((d, len((t or "").split()) + 1) for d, t in ROWS if d)
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {round(r.score, 9) for r in rows if r.n_tokens == 1} == {round(next(r.score for r in rows if r.doc_id == 3), 9)}


def test_languages(docs):
    rows = language_id.predict(docs, language_id.train(docs), keep=["doc_id"], spans=True).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id}
    assert len(rows) == len(ROWS)
    assert all(found[d] == ("und", 0.0) for d in (2, 3, 4, 12)) and found[1] == ("en", 1.0) and found[14] == ("en", 1.0)
    nothing = language_id.predict(docs, language_id.train(docs.where("lang IS NULL")), keep=["doc_id"])
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    one_label = toxicity.train(docs, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score(docs, one_label).collect()} == {one_label.score("")}
    assert toxicity.train(docs, labels.limit(0)).score("any") == 0.5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs, items):
    path = tmp_path_factory.mktemp("tables")
    docs.drop("n_words").withColumn("N_Words", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_keep_columns_and_apply_their_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{number}-{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        kept.append(sorted((r.doc_id or -1) for r in docs.select("doc_id").collect()))
    assert kept[0] == [-1, 1, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14]
    assert kept[1] == [-1, 6, 7, 8, 10, 11, 13, 14]
    assert kept[2] == [-1, 6, 8, 10, 13, 14]
    assert kept[3] == [-1, 8, 13, 14]
    assert sorted(set(kept[4])) == kept[3]
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])


def test_every_operator_and_stage_takes_empty_tables(spark, docs, items, folder):
    none = docs.limit(0).drop("n_words", "score", "lang_pred")
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    frames = [
        exact_dedup.deduplicate(none), near_dedup.near_duplicates(none), substring_dedup.deduplicate(none),
        decontamination.report(none, items), packing.pack_documents(none, tokenizer_file("word_bpe_49k.json")),
        token_counts.count_tokens(none, vocabulary), pii.find(none), subword_lm.score(none, ~in_remainder("doc_id", 5, 1), vocabulary),
        language_id.predict(none, language_id.train(none), keep=["doc_id"]),
        toxicity.score(none, toxicity.train(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))),
        *[stage(spark, none, folder) for _, stage in corpus_pipeline.STAGES]]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_near_copies_beside_a_stray(spark):
    """A large group of near copies with strays that share its buckets, over several blocks."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(60)]
    texts += [" ".join(base[:k] + [f"s{k}x{i}" for i in range(90 - k)]) for k in (40, 50, 60, 66, 70, 74, 78) for i in range(3)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    block, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        near_dedup.BLOCK = block
    assert found == dict(enumerate(label)) and len(set(label)) > 5


def test_rows_are_dropped_by_key_however_many(spark, monkeypatch):
    rows = [(i % 7 if i % 5 else None, f"t{i % 11}" if i % 4 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    decided = docs.select("doc_id", text_key("text").alias("text_key"), (F.length("text") > 2).alias("kept")).na.fill(False, ["kept"])
    expected = sorted({r for r in rows if r[1] is not None and len(r[1]) > 2}, key=repr)
    for most in (1000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, keep_rows(docs, decided).collect()), key=repr) == expected
