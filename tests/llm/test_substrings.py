"""Substring dedup against windows compared one by one."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quaymark.llm import substrings as s

from llm_rows import make, words


def slow(rows):
    """Result by doc_id and text, from every window of every text."""
    first = {}
    key = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - s.WINDOW + 1):
            k, here = tuple(w[p : p + s.WINDOW]), (key(i), p)
            first[k] = min(first.get(k, here), here)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - s.WINDOW + 1):
            if (key(i), p) > first[tuple(w[p : p + s.WINDOW])]:
                gone.update(range(p, p + s.WINDOW))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


def check(spark, rows):
    found = s.without_repeats(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert order(tuple(r) for r in found) == order(slow(rows))


def test_equals_every_window(spark, monkeypatch):
    rng = random.Random(11)
    stock = [words(rng, 60) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randint(0, 40), "ab")]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(stock).split()
            a = rng.randint(0, 30)
            parts += [" ".join(t[a : a + rng.randint(5, 60)]), words(rng, rng.randint(0, 12), "abc")]
        rows.append((rng.choice([i, i, i, None, 7]), "\n\t ".join(parts)))
    rows += [(200 + i, stock[0]) for i in range(5)] + [(7, rows[3][1]), (7, rows[3][1])]
    check(spark, rows)


def test_runs_and_periods(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["x", "x", "x y", "x y z", "y"]) for _ in range(rng.randint(15, 120)))) for i in range(40)]
    rows += [(100, "x " * 300), (101, "x " * 40), (102, "x y " * 100), (103, "y x " * 60 + "q"), (104, "a b c " * 50)]
    check(spark, rows)


def test_small_pieces_give_the_same(spark):
    rng = random.Random(8)
    base = words(rng, 200).split()
    rows = [(i, " ".join(base[rng.randint(0, 99) : rng.randint(100, 200)])) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = s.without_repeats(odd_docs)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert order(tuple(r) for r in found.collect()) == order(slow(rows))
    assert s.without_repeats(no_docs).collect() == []
    text = {(r["doc_id"], r["n_words"]): r["kept_text"] for r in s.without_repeats(odd_docs, with_text=True).collect()}
    assert text[(2, 0)] == ""


def test_word_names_are_those_of_bytes():
    rng = random.Random(2)
    texts = [None, "", " a  bb\tccc\x0b\x0cdd\r\n", "a" * 500 + " " + "a" * 499, "é ß 😀 \x1f\x1c x", " ".join("q" * rng.randint(1, 70) for _ in range(99))]
    counts, one, two = s.word_names(pa.array(texts))
    split = [(t or "").encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    by_word = defaultdict(set)
    for w, a, b in zip([w for ws in split for w in ws], one.tolist(), two.tolist(), strict=True):
        by_word[w].add((a, b))
    assert all(len(v) == 1 for v in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word)


def test_a_symbol_is_settled_by_its_words():
    """What is settled within a passage is found at the same places of it in any surroundings."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        middle = rng.integers(0, 4, 40)
        sets = []
        for _ in range(3):
            left, right = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(0, 30))
            names = s._mix(np.concatenate([left, middle, right]).astype(np.uint64))
            low, high = s._rounds(names, np.array([len(names)]), s.ROUNDS)
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            a = len(left)
            sets.append({(x - a, y - a) for x, y in zip(low.tolist(), high.tolist(), strict=True) if x >= a and y <= a + 40})
        assert sets[0] == sets[1] == sets[2]


def test_registered_query_equals_every_window(spark, sf_dir):
    from quaymark.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = QUERIES["op11_recompressed_substrings"](spark, sf_dir)
    assert order(tuple(r) for r in found.collect()) == order(slow(rows))
