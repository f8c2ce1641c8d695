from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.llm import lang_id as l

from llm_rows import make, words


def grams(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    found = Counter()
    for word in letters.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip() and (n > 1 or g != " "))
    return found


def code(g):
    value = 0
    for c in g:
        value = value << 21 | ord(c)
    return value


@pytest.mark.parametrize("text", ["Hello, world", "a", "éÉ ß 😀x 12", "", None, " .. ", "one-two three"])
def test_ngrams(text):
    codes, counts = l.ngrams(text)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in grams(text).items()}


def test_profiles_and_distance_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    profiles = {}
    for lang in sorted({r["lang"] for r in train}):
        total = sum((grams(r["text"]) for r in train if r["lang"] == lang), Counter())
        profiles[lang] = sorted(total, key=lambda g: (-total[g], code(g)))[: l.PROFILE]
    found = {r["doc_id"]: r for r in l.language_of_documents(docs).collect()}
    size = max(map(len, profiles.values()))
    for r in rows:
        own = grams(r["text"])
        top = sorted(own, key=lambda g: (-own[g], code(g)))[: l.TOP]
        far = {k: sum(min(abs(p.index(g) - i), size) if g in p else size for i, g in enumerate(top)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert found[r["doc_id"]]["lang_pred"] == best
        assert found[r["doc_id"]]["score"] == pytest.approx(1 - far[best] / (size * len(top)))
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = l.language_of_documents(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98


def test_odd_rows(spark, odd_docs, no_docs):
    found = l.language_of_documents(odd_docs).toPandas()
    assert len(found) == odd_docs.count()
    no_letter = found[found["lang_pred"] == "und"]
    assert {1, 2, 3, 10} <= set(no_letter["doc_id"].dropna()) and (no_letter["score"] == 0).all()
    assert found["score"].between(0, 1).all()
    assert l.language_of_documents(no_docs).count() == 0
    assert l.Ranker({}).predict("word") == ("und", 0.0)
    assert np.all(np.diff(l.top_ngrams("aa bb cc", 2).astype(float)) != 0)


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(12)
    train = make(spark, [(1, words(rng, 300, "abcdef"), "aa", "s"), (2, words(rng, 300, "uvwxyz"), "zz", "s")])
    profiles = l.learn_profiles(train)
    docs = make(spark, [(3, words(rng, 400_000, "abcdef"), "x", "s"), (4, "u" * 2_000_000, "x", "s"), (5, "", "x", "s")])
    docs = docs.withColumns({"_found": F.lit(1), "found": F.lit(2), "row": F.lit(3)})
    rows = {r["doc_id"]: r for r in l.identify(docs, profiles).collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 5)] == ["aa", "zz", "und"] and rows[3]["_found"] == 1 and rows[3]["row"] == 3
