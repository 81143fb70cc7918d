"""The text operators on whole small tables: against SQL, against brute force, and by held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fanfold.llm import queries
from fanfold.llm.queries import tokenizer_file
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = duck.execute(queries.ORACLES[name])
    theirs = canonical([d[0] for d in found.description], found.fetchall())
    frame = queries.QUERIES[name](spark, FOLDER)
    ours = canonical(frame.columns, frame.collect())
    assert ours == theirs and ours[1]


def test_packing_is_whole_and_tight(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = queries.QUERIES["op1_best_fit_packing"](spark, FOLDER).collect()
    expected = set()
    for doc_id, text, _ in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.add((doc_id, n, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


def test_token_counts_equal_the_library(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in queries.QUERIES["op6_token_counts"](spark, FOLDER).collect()}
    for doc_id, text, _ in documents:
        n = len(library.encode(text or ""))
        assert (rows[doc_id].n_bytes, rows[doc_id].n_tokens, rows[doc_id].over_limit) == (len((text or "").encode()), n, n > 4096)


def plain_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def digits(m):
        return [int(c) for c in m[0] if c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in email.finditer(text)],
        "ip": [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in card.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in phone.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_personal_data_keeps_every_plain_span(spark, documents):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_pii"](spark, FOLDER).collect()}
    for doc_id, text, _ in documents:
        spans = plain_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in spans for a, b in spans[k])
        row = rows[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(s) for s in spans.values()]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(row.spans.split(",")) | {""}


def test_baseline_of_the_language_model(spark, documents):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_subword_lm"](spark, FOLDER).collect()}
    words = {d: [*(t or "").encode().lower().split(), None] for d, t, _ in documents}
    counts = Counter(w for d in words if rest(d, 5) != 1 for w in words[d])
    n, v = sum(counts.values()), len(counts)
    for doc_id, own in words.items():
        row = rows[doc_id]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (rest(doc_id, 5) == 1, len(own), n)
        assert row.n_known == sum(counts[w] > 0 for w in own)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert row.score < 0


def test_language_model_beats_its_baseline_on_held_out_texts(spark):
    rows = [r for r in queries.QUERIES["op5_subword_lm"](spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_accuracy_on_held_out_texts(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").fetchall())
    rows = queries.QUERIES["op9_language_id"](spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (rest(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES["op10_toxicity"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    caught = [r.predicted for r in held if toxic[r.doc_id] == 1]
    assert sum(caught) >= 0.85 * len(caught)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
