from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quaymark.llm import quality as q

from llm_rows import make, words


def counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize(
    "text", [None, "", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx ", "é b # | é b # | q", "a\x1cb \x0b c\x85d", "a b c d a b c d e f " * 20]
)
def test_counts(text):
    assert q.text_statistics(text)[:5] == counts(text)


def brute_mcd(x):
    """Centre, scatter and scale of one group in numpy."""
    p = len(q.STATS)
    floors = np.square(q.FLOORS)
    quart = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    s = np.sqrt(((quart[2] - quart[0]) / 1.349) ** 2 + floors)
    z = (x - quart[1]) / s
    norm = (z**2).sum(axis=1, keepdims=True)
    scores = [np.tanh(z), z / np.sqrt(np.where(norm > 0, norm, 1)), z / np.sqrt(1 + norm)]

    def limit(mu, cov, share):
        d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
        bins = np.floor(np.log2(np.maximum(d, 1e-12)) * q.BINS)
        return bins, np.sort(bins)[int(np.ceil(len(bins) * share)) - 1]

    ends = []
    for y in [None, *scores]:
        corr = np.eye(p)
        if y is not None:
            m = y.T @ y
            d = np.sqrt(np.diag(m))
            with np.errstate(all="ignore"):
                corr = np.nan_to_num(m / np.outer(d, d))
            np.fill_diagonal(corr, 1)
            corr = (1 - q.RIDGE) * corr + q.RIDGE * np.eye(p)
        mu, cov = quart[1], corr * np.outer(s, s)
        for _ in range(q.STEPS):
            bins, top = limit(mu, cov, q.SHARE)
            near = x[bins <= top]
            mu = near.mean(axis=0)
            cov = (np.cov(near.T) if len(near) > 1 else np.zeros((p, p))) + np.diag(floors)
        ends.append((np.linalg.slogdet(cov)[1], mu, cov))
    _, mu, cov = min(ends, key=lambda e: round(e[0], 9))
    _, mid = limit(mu, cov, 0.5)
    return mu, cov, max(1.0, 2 ** ((mid + 0.5) / q.BINS) / q.chi2_quantile(0.5, p))


def brute(frame: pd.DataFrame):
    """Distances by doc_id: each language and source drawn towards its language and the corpus."""
    x = frame[list(q.STATS)].to_numpy()
    top, out = brute_mcd(x), {}
    for _, of_lang in frame.groupby("lang"):
        lang = q.drawn(len(of_lang), *brute_mcd(of_lang[list(q.STATS)].to_numpy()), top)
        for _, rows in of_lang.groupby("source"):
            values = rows[list(q.STATS)].to_numpy()
            mu, cov, scale = q.drawn(len(rows), *brute_mcd(values), lang)
            d = np.einsum("ij,jk,ik->i", values - mu, np.linalg.inv(cov), values - mu) / scale
            out |= dict(zip(rows["doc_id"], d, strict=True))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        text = words(rng, rng.randint(60, 200)).capitalize()
        if i % 20 == 3:
            text = " ".join(w + "###" for w in text.split())
        if i % 20 == 7:
            text = text.upper()
        rows.append((i, text, "en" if i % 2 else "fr", "s" if i < 200 else f"t{i}"))
    return rows


def test_verdicts_equal_brute_force(spark):
    docs = make(spark, corpus())
    found = {r["doc_id"]: r for r in q.judge(docs).collect()}
    frame = pd.DataFrame([(i, lang, src, *q.text_statistics(t)[5]) for i, t, lang, src in corpus()], columns=["doc_id", "lang", "source", *q.STATS])
    limit = q.chi2_quantile(q.CUTOFF, len(q.STATS))
    want = brute(frame)
    assert len(want) == len(frame)
    for i, d in want.items():
        assert found[i]["distance"] == pytest.approx(d, rel=1e-6)
        assert found[i]["kept"] == (d <= limit)
    junk = [i for i in range(200) if i % 20 in (3, 7)]
    assert not any(found[i]["kept"] for i in junk)
    assert all(found[i]["kept"] for i in range(200) if i not in junk)
    assert sorted(r["doc_id"] for r in q.keep_good(docs).select("doc_id").collect()) == sorted(i for i, r in found.items() if r["kept"])


def test_sources_keep_their_own_ways(spark):
    """One source writes with symbols; its texts are no outliers there, but would be elsewhere."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        ws = words(rng, 120).split()
        if i % 3 == 0 or i == 100:
            ws = [w + "#" for w in ws]
        rows.append((i, " ".join(ws), "en", "marks" if i % 3 == 0 else "plain"))
    found = {r["doc_id"]: r["kept"] for r in q.judge(make(spark, rows)).collect()}
    assert [i for i, kept in found.items() if not kept] == [100]


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = make(spark, corpus())
    want = {r["doc_id"]: r["distance"] for r in q.judge(docs).collect()}
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    found = {r["doc_id"]: r["distance"] for r in q.judge(docs).collect()}
    assert found == pytest.approx(want, rel=1e-9)


def test_chi_square():
    assert q.chi2_quantile(0.5, 5) == pytest.approx(4.35146, abs=1e-5)
    assert q.chi2_quantile(0.999, 5) == pytest.approx(20.51501, abs=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    found = q.judge(odd_docs).collect()
    assert len(found) == odd_docs.count()
    want = sorted(counts(r["text"]) for r in odd_docs.collect())
    assert sorted(tuple(r[c] for c in q.COUNTS) for r in found) == want
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)
    assert q.keep_good(odd_docs).columns == odd_docs.columns
    assert q.judge(no_docs).count() == 0 and q.keep_good(no_docs).count() == 0
