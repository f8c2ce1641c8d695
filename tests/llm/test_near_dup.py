from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np

from quaymark.llm import near_dup as nd

from llm_rows import make, words


def groups(spark, docs, threshold=0.8):
    """Components of all pairs by exact similarity."""
    rows = docs.select("doc_id", "text").collect()
    idf = nd.shingle_idf(docs)
    bags = {}
    for r in rows:
        h, tf = nd.shingles(nd.word_ids(r["text"]))
        bags[r["doc_id"]] = (h, nd.weights(h, tf, idf))
    label = {i: i for i in bags}
    for a, b in itertools.combinations(sorted(bags), 2):
        if nd.similarity(bags[a], bags[b]) >= threshold:
            x, y = label[a], label[b]
            label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    return label


def edited(rng, text, share):
    parts = text.split()
    for i in rng.sample(range(len(parts)), int(len(parts) * share)):
        parts[i] = words(rng, 1)
    return " ".join(parts)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, 150)
        for k in range(rng.choice([1, 3, 12])):
            rows.append((i, edited(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.04])) if k else base, "en", "s"))
            i += 1
    rng.shuffle(rows)
    docs = make(spark, rows)
    rows = nd.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == groups(spark, docs)
    sizes = Counter(r["group_id"] for r in rows if r["doc_id"] == r["class_id"])
    assert all((r["n_links"] > 0) == (sizes[r["group_id"]] > 1) for r in rows)


def test_a_large_star_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "STAR", 4)
    rng = random.Random(15)
    base = words(rng, 120)
    docs = make(spark, [(i, f"{base} end{i}" if i else base, "en", "s") for i in range(60)])
    found = nd.near_duplicates(docs).collect()
    assert {r["group_id"] for r in found} == {0} and max(r["n_links"] for r in found) == 59


def test_weights_depend_on_shares_of_the_corpus(spark):
    rng = random.Random(16)
    texts = [words(rng, 40) + " one phrase of many texts here" if i % 4 == 0 else words(rng, 40) for i in range(200)]
    small = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    large = make(spark, [(i, texts[i % 200], "en", "s") for i in range(2000)])
    h, tf = nd.shingles(nd.word_ids("one phrase of many texts here"))
    a, b = (nd.weights(h, tf, nd.shingle_idf(d)) for d in (small, large))
    np.testing.assert_allclose(a, b, rtol=0.02)


def test_very_long_texts(spark):
    rng = random.Random(17)
    long = " ".join(words(rng, 2000) for _ in range(100))
    docs = make(spark, [(1, long, "en", "s"), (2, long + " more", "en", "s"), (3, "x" * 2_000_000, "en", "s")])
    assert {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 1200, dtype=np.uint64))[:1000]
    w = rng.uniform(0.5, 3, 1000).astype(np.float32)
    sampler = nd.Sampler()
    agree = []
    for shift in range(0, 100, 2):
        part = h[shift : shift + 900]
        both = np.concatenate((h, part))
        keys = sampler.bands(both, np.concatenate((w, w[shift : shift + 900])), np.array([0, 1000]))
        true = float(w[shift : shift + 900].sum() / w.sum())
        agree.append((keys[0] == keys[1]).mean() - true**nd.ROWS)
    assert abs(np.mean(agree)) < 0.04


def test_odd_rows(spark, odd_docs):
    found = nd.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["group_id"] == by[2]["group_id"] == by[3]["group_id"] == 1
    assert by[5]["group_id"] == by[6]["group_id"] == 5 and by[8]["group_id"] == by[7]["group_id"] == 7
    assert all(r["group_id"] in (1, 5) for r in found if r["doc_id"] is None)
    kept = nd.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 7, 9, 10, 11]


def test_repeated_id_stays_once(spark):
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    docs = make(spark, [(1, a, "en", "s"), (1, a, "en", "s"), (2, b, "en", "s"), (2, words(rng, 60), "en", "s")])
    assert sorted(r["doc_id"] for r in nd.one_of_each(docs).collect()) == [1, 2]


def test_empty_table(spark, no_docs):
    assert nd.near_duplicates(no_docs).count() == 0
    assert nd.one_of_each(no_docs).count() == 0
