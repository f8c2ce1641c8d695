from __future__ import annotations

import random
from collections import Counter, defaultdict

from quaymark.llm import packing as p

from llm_rows import make, words


def slow(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, placed = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        fits = [
            (r, b) for b, (r, s, c, _) in enumerate(bins)
            if r > 0 and r >= sizes[i] and (sources[i] < 0 or sources[i] not in s) and not c & set(clusters[i])
        ]
        if not fits:
            bins.append([capacity, set(), set(), 0])
            fits = [(capacity, len(bins) - 1)]
        b = min(fits)[1]
        placed[i] = (b, bins[b][3])
        bins[b][0] -= sizes[i]
        bins[b][1].add(sources[i])
        bins[b][2] |= set(clusters[i])
        bins[b][3] += 1
    return placed


def test_best_fit_equals_looking_at_every_bin():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(0, 60)
        sizes = [rng.randint(0, 100) for _ in range(n)]
        sources = [rng.randint(-1, 4) for _ in range(n)]
        clusters = [[rng.randint(0, 10) for _ in range(rng.randint(0, 3))] for _ in range(n)]
        assert p.best_fit(sizes, sources, clusters, 100) == slow(sizes, sources, clusters, 100)


def test_pieces_cover_texts_and_bins_keep_the_rules(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(40)]
    rows = [(i, texts[i % 30], "en", f"s{i % 3}" if i % 4 else None) for i in range(120)]
    found = p.pack(make(spark, rows), capacity=100, shard_docs=30).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        bins[r["bin_id"]].append(r)
    for i, text, _, _ in rows:
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in got) == len(text.split())
        assert [r["first_token"] for r in got] == [100 * k for k in range(len(got))]
    for held in bins.values():
        assert sum(r["n_tokens"] for r in held) <= 100
        assert sorted(r["place"] for r in held) == list(range(len(held)))
        sources = Counter(rows[r["doc_id"]][3] for r in held)
        clusters = Counter(rows[r["doc_id"]][1].lower() for r in held if rows[r["doc_id"]][1])
        assert all(n == 1 for s, n in sources.items() if s is not None)
        assert all(n == 1 for n in clusters.values())


def jaccard(a, b):
    x, y = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_share_no_bin(spark):
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = words(rng, 200).split()
        for k in range(4):
            edited = list(base)
            if k:
                edited[rng.randrange(200)] = f"edit{k}"
            rows.append((len(rows), " ".join(edited), "en", f"s{len(rows)}"))
    rows += [(900, None, "en", "u"), (901, "", "en", "v")]
    bins = defaultdict(list)
    for r in p.pack(make(spark, rows)).collect():
        bins[r["bin_id"]].append(r["doc_id"])
    assert len(bins) < 150
    for held in bins.values():
        held = [i for i in held if i < 900]
        assert all(jaccard(rows[i][1], rows[j][1]) < 0.8 for i in held for j in held if i < j)


def test_very_long_text(spark):
    found = p.pack(make(spark, [(1, "word " * 400_000, "en", "s"), (2, "x" * 3_000_000, "en", "s")])).collect()
    assert sum(r["n_tokens"] for r in found) == 400_001


def test_rows_of_one_doc_id_spread_over_shards(spark):
    found = p.pack(make(spark, [(1, f"word{i}", "en", None) for i in range(200)]), shard_docs=20).collect()
    assert len({r["bin_id"] >> 32 for r in found}) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    found = p.pack(odd_docs).collect()
    want = sum(len((r["text"] or "").split()) for r in odd_docs.collect())
    assert sum(r["n_tokens"] for r in found) == want
    assert sum(r["piece"] == 0 for r in found) == odd_docs.count()
    assert p.pack(no_docs).count() == 0
