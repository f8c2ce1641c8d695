from __future__ import annotations

import random

import corpus_pipeline as cp

from quaymark.llm import lang_id, near_dup, quality, secrets

from llm_rows import make, words


def test_stages_do_what_their_operators_say(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        stock = "abcdefg" if i % 2 else "nopqrstuvw"
        text = words(rng, rng.randint(60, 120), stock)
        if i % 10 == 4:
            text += '\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
        rows.append((i, text, "en" if i % 2 else "fr", "s"))
    rows += [(200, rows[0][1], "fr", "s"), (201, rows[0][1] + " more", "fr", "t"), (202, "123 456", "en", "s"), (203, None, "en", "s"), (204, "too short", "en", "s")]
    docs = make(spark, rows)
    kept = docs
    for name, stage in cp.STAGES:
        before = kept
        kept = stage(spark, before, "unused")
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.select("doc_id").distinct().collect())
        if name == "language":
            found = lang_id.language_of_documents(before).collect()
            assert ids == sorted(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= cp.LEAST_SCORE)
            assert not {202, 203} & set(ids)
        elif name == "quality_rules":
            assert ids == sorted(r["doc_id"] for r in quality.judge(before).collect() if r["kept"])
            assert 204 not in ids
        elif name == "near_duplicates":
            assert ids == sorted(r["doc_id"] for r in near_dup.near_duplicates(before).collect() if r["kept"])
            assert not {200, 201} & set(ids)
        elif name == "secret_scan":
            want = {r["doc_id"]: secrets.redact(r["text"]) for r in before.collect()}
            assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        else:
            tokens = sum(len(r["text"].split()) for r in before.collect())
            assert sum(r["n_tokens"] for r in kept.collect()) == tokens


def test_empty_table(spark, no_docs):
    kept = no_docs
    for _, stage in cp.STAGES:
        kept = stage(spark, kept, "unused")
    assert kept.count() == 0


def test_odd_rows_pass_every_stage(spark, odd_docs, tmp_path):
    """Null ids, languages and sources, repeats, very long texts and clashing columns, written and read between the stages."""
    kept = odd_docs
    for name, stage in cp.STAGES:
        before = kept
        stage(spark, before, "unused").write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert kept.columns == odd_docs.columns and kept.count() <= before.count()
            texts = [r["text"] for r in kept.collect()]
            assert None not in texts and all(t.strip() for t in texts)
        if name == "near_duplicates":
            assert len(texts) == len(set(texts))
    assert kept.where("n_tokens < 0 OR bin_id IS NULL").count() == 0
