"""Licence scans, importance resampling and fill-in-middle against brute force, on small tables with every defined case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanfold.llm import fill_in_middle, importance, license_scan
from fanfold.llm.queries import QUERIES

GPL = next(t.text for t in license_scan.TEMPLATES if t.text.startswith("this program is free"))
MIT = next(t.text for t in license_scan.TEMPLATES if t.text.startswith("permission is hereby"))
NOISE = random.Random(5)
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (None, "no id but words, and CC-BY too"), (4, "All rights reserved."), (4, "All rights reserved."),
    (5, "cc by " * 500), (6, f"Copyright 2020\n{GPL.upper()}\nand more"), (7, MIT.replace("copy", "COPIES")), (8, MIT[40:]),
    (9, "license under the MIT\nLicense; " + "x" * 70_000), (10, "General Public \u212a License: general public liçense"), (11, "reserved rights all"),
    (12, "a <P> b <S> c <M> d"), (13, "é" * 9 + " ü" * 40), (14, "one"), (15, " lead and trail \x0b\x0c "), (16, "\x1c\x85\xa0 a\x00b"),
    *[(100 + i, "".join(NOISE.choice(["ab", "Ba", "c", "cc", "by", "é", " ", " ", "\n", "-", "<", "P>"]) for _ in range(NOISE.randrange(400))))
      for i in range(60)],
    (20, " ".join(f"w{i % 977}" for i in range(50_000))), (None, None),
]
CLASHES = ("words", "found", "present", "likely", "places", "bucket", "n", "rank", "weight", "score", "units", "frames", "form", "place")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def same(frame, expected):
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == sorted(expected, key=repr)


def licences(rows):
    """By comparing every template with every place of every text."""
    held = Counter(w for _, t in rows for w in set(words(t)))
    weigh = lambda w: 1 + math.floor(1000 * math.log((len(rows) + 1) / (held[w] + 1)))
    for d, t in rows:
        w, base, found = words(t), [], []
        at = lambda i: w[i] if 0 <= i < len(w) else None
        for template in license_scan.TEMPLATES:
            text = template.text.split()
            keys = [(license_scan.find_words(text, k.split()), k.split()) for k in template.keys]
            for s in range(-len(text), len(w)):
                if all(at(s + k + i) == x for k, key in keys for i, x in enumerate(key)):
                    cover = sum(weigh(x) for i, x in enumerate(text) if at(s + i) == x) / sum(map(weigh, text))
                    found.append((template.label, cover))
                    base += [(template.label, s)] if template.base else []
        yield (d, len(w), len(base), min((s for _, s in base), default=None), max((s for _, s in base), default=None),
               ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, c in found if c >= 0.75})),
               max((c for _, c in found), default=0.0))


def test_licences(docs):
    index = license_scan.build_index(docs)
    expected = list(licences(ROWS))
    same(license_scan.report(license_scan.scan(docs, index)), expected)
    labels = {e[0]: e[6] for e in expected}
    assert labels[4] == "reserved" and labels[5] == "cc-by" and labels[6] == "gpl" and labels[7] == "mit" and labels[9] == "mit"
    plan = license_scan.scan(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def drawn(rows, target, rate, least, seed, buckets):
    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in (*w, *map(" ".join, zip(w, w[1:])))]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    scored = []
    for d, x in rows:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    order = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(order[:rate * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in scored]


TARGET = ["cc by c ab", None, "", "Ab ba ab-ba c cc by", "w1 w2 w3"]


@pytest.mark.parametrize("rate, least, buckets", [(25, 20, 10_000), (100, 0, 7), (0, 1, 100)])
def test_resampling(spark, docs, rate, least, buckets):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    report = importance.resample(docs, target, rate, least, 3, buckets)
    same(report.select("doc_id", "n_features", "weight", "score", "rank"), drawn(ROWS, TARGET, rate, least, 3, buckets))
    chosen = importance.draw(docs, report)
    assert chosen.columns == docs.columns
    assert (rate == 0) == chosen.isEmpty()


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("known", [0, 3, 50])
def test_features_by_head_and_tail(stretch, known):
    texts = [(t or "").encode() for _, t in ROWS if len(t or "") < 5000]
    split = [words(t.decode()) for t in texts]
    common = [w.encode() for w, _ in Counter(w for x in split for w in x).most_common(known)]
    pairs = [(a.encode(), b.encode()) for (a, b), _ in Counter(p for x in split for p in zip(x, x[1:])).most_common(2 * known)]
    head, found = importance.Head(common, pairs, 1000), Counter()
    for group in importance.stretches(texts, stretch):
        first, single, second, double = head.features(group)
        found.update(zip(first.tolist(), single.tolist()))
        found.update(zip(second.tolist(), double.tolist()))
    assert found == Counter((i, zlib.crc32(f.encode()) % 1000) for i, w in enumerate(split)
                            for f in (*w, *map(" ".join, zip(w, w[1:]))))


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 20])
def test_tallies_of_words_and_pairs(monkeypatch, stretch):
    texts = [(t or "").encode() for _, t in ROWS if len(t or "") < 5000]
    split = [[w.encode() for w in words(t.decode())] for t in texts]
    expected = Counter((w, None) for x in split for w in x) + Counter(p for x in split for p in zip(x, x[1:]))
    single, double = importance.Tally(object), importance.Tally(np.uint64, np.uint64)
    for group in importance.stretches(texts, stretch):
        importance.tally(group, single, double)
    a, b, n = importance.spelled(single, double, 10**6, 10**6)
    assert dict(zip(zip(a, b), n.tolist())) == {k: v for k, v in expected.items() if all(len(w or b"") <= importance.HEAD_BYTES for w in k)}

    monkeypatch.setattr(importance, "TABLE", 8)  # the most frequent stay
    single, double = importance.Tally(object), importance.Tally(np.uint64, np.uint64)
    for i in range(50):
        importance.tally([(0, b"often so %d" % i, False)], single, double)
    a, b, n = importance.spelled(single, double, 2, 1)
    assert set(zip(a, b, n.tolist())) == {(b"often", None, 50), (b"so", None, 50), (b"often", b"so", 50)} and len(single.keys) <= 8


def test_finding_the_head_takes_less_than_using_it():
    rng = np.random.Generator(np.random.PCG64(5))
    vocabulary = [b"w%d" % i for i in range(50_000)]
    texts = [b" ".join(vocabulary[i] for i in (50_000 * rng.random(20_000) ** 4).astype(int).tolist()) for _ in range(60)]
    groups = list(importance.stretches(texts))

    def seconds(work) -> float:
        begin = time.process_time()
        for group in groups:
            work(group)
        return time.process_time() - begin

    single, double = importance.Tally(object), importance.Tally(np.uint64, np.uint64)
    finding = seconds(lambda group: importance.tally(group, single, double))
    a, b, _ = importance.spelled(single, double, importance.HEAD_WORDS, importance.HEAD_PAIRS)
    head = importance.Head([x for x, y in zip(a, b) if y is None], [(x, y) for x, y in zip(a, b) if y is not None], 10_000)
    assert finding < 1.2 * seconds(head.features)


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def infilled(rows, seed, rate, spm):
    for d, t in rows:
        t, h = t or "", hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
        u, (h1, h2, h3, h4) = UNIT.findall(t), (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            yield d, len(u), "plain", None, None, t
        elif h4 % 100 < spm:
            yield d, len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
        else:
            yield d, len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("frame_bytes, rate, spm", [(1, 100, 50), (7, 100, 50), (1000, 50, 80), (1 << 16, 100, 0), (1 << 16, 0, 0)])
def test_infill(docs, frame_bytes, rate, spm):
    some = [r for r in ROWS if frame_bytes > 100 or len(r[1] or "") < 5000]
    picked = docs if frame_bytes > 100 else docs.where("text IS NULL OR length(text) < 5000")
    outputs = fill_in_middle.infill(fill_in_middle.store(picked, frame_bytes=frame_bytes), 9, rate, spm)
    expected = list(infilled(some, 9, rate, spm))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    same(fill_in_middle.digests(outputs), [(*e[:5], sha(e[5]), sha(t)) for e, (_, t) in zip(expected, some)])
    same(fill_in_middle.texts(outputs), [(e[0], e[2], e[5]) for e in expected])
    same(fill_in_middle.restore(outputs), [(d, t or "") for d, t in some])


def test_only_cut_frames_are_opened():
    raw = " ".join(f"word{i}" for i in range(10_000)).encode()
    parts = list(fill_in_middle.cut_frames(raw, 1000))
    opened = []
    frames = fill_in_middle.Frames([p[0] for p in parts], [p[1] for p in parts], lambda f: opened.append(f) or f)
    pieces = list(frames.section(1500, 50_500, len(raw), lambda part: part))
    assert b"".join(f for _, f in pieces) == raw[1500:50_500] and len(opened) == 2


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_importance", "op13_fill_in_middle"])
def test_empty_tables(spark, tmp_path, name):
    for table, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([], f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
