"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from quaymark.llm import spelling as s

from llm_rows import make

LOWER = str.maketrans(s.UPPER, s.LOWER)


def slow_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow(rows):
    n = slow_counts(rows)
    by_length, forms, out = {}, {}, []
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    found = {w: [o for k in (-1, 0, 1) for o in by_length.get(len(w) + k, ()) if o != w and near(w, o)] for w in n}
    for w, others in found.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(found[w]), n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def check(spark, rows):
    found = s.variants(make(spark, [(i, t, "en", "s") for i, t in rows]))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow(rows)


def test_equals_all_pairs(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "ababababab", "straßenname", "ÀÉÎÕÜÿ", "àéîõüÿ"]
    tokens = []
    for stem in stems:
        for depth, times in ((0, 700), (1, 60), (2, 12), (3, 6)):
            for _ in range(1 if not depth else 5):
                w = list(stem)
                for _ in range(depth):
                    at, letter = rng.randrange(len(w)), rng.choice("abcéÿ")
                    rng.choice([lambda: w.insert(at, letter), lambda: w.pop(at), lambda: w.__setitem__(at, letter)])()
                tokens += ["".join(w)] * rng.randint(times // 2, times)
    rng.shuffle(tokens)
    rows = [(rng.choice([i, 3, None]), rng.choice([" ", "1", "_", "×. "]).join(tokens[i * 40 : i * 40 + 40]).replace("a", rng.choice("aA"))) for i in range(len(tokens) // 40)]
    assert len(slow(rows)) > 50 and any(r[1] and r[2] != r[1] for r in slow(rows))
    check(spark, rows)


def test_scrambled_letters_are_not_near(spark):
    rows = [(1, " ".join(["listen", "silent", "tinsel", "enlist", "silenty", "linsel", "tinsels"] * 6))]
    check(spark, rows)


def test_long_words_and_odd_rows(spark, odd_docs, no_docs):
    long = "ab" * 3000
    check(spark, [(1, f"{long} {long}c {long[1:]} " * 5), (2, None), (3, ""), (None, "planted " * 5)])
    found = s.variants(odd_docs)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert s.variants(no_docs).collect() == []


def test_words_and_what_comes_of_them_are_never_broadcast(spark, monkeypatch):
    ran, keep = [], s.keep

    def run(df):
        rows = df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(s, "keep", lambda df, name: (run(df), keep(df, name))[1])
    docs = make(spark, [(1, "lantern " * 130 + "lanterne " * 26 + "lanternes " * 5, "en", "s")])
    assert sorted((r["word"], r["root"], r["n_near"]) for r in run(s.variants(docs))) == [("lantern", "lantern", 1), ("lanterne", "lantern", 2), ("lanternes", "lantern", 1)]
    assert sum("SortMergeJoin" in plan for plan in ran) >= 4
    assert not [plan for plan in ran if "Broadcast" in plan]


def test_registered_query_equals_all_pairs(spark, sf_dir):
    from quaymark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_anagram_variants"](spark, sf_dir).collect()), key=str) == slow(rows)
