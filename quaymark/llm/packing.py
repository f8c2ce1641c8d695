"""Conflict-constrained best-fit packing of documents into token bins.

A document longer than ``capacity`` is cut into full pieces, each a bin of its
own, and a rest that is packed. Items go largest first (ties by doc_id, then
place) into the bin with the least residual that still holds them and has
neither a document of the same source nor one of a same duplicate cluster:
open bins are kept ordered by residual, each carries a bitmap of its sources
and one of its clusters, and the search goes from the first bin large enough
to its successors until a compatible one is found. If none is, a bin opens.

A document is in ``BANDS`` duplicate clusters, one for each band of ``ROWS``
minimum hashes of its five-word shingles: a bin has no two documents that
share a band. Copies share all; texts of a shingle similarity of 0.8 share none with a
probability of 5 in a million. Within a bin only pairs matter, so no groups
are built from the clusters.

Rows are dealt to shards by a hash of doc_id and place in the input, about ``shard_docs`` to a shard,
and each shard is packed alone: bins never span shards, a shard's size does
not grow with the data, and no source or cluster gathers in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import MIX, mixed, shingle_hashes, word_ids

CAPACITY = 2048
SHARD_DOCS = 2000
BANDS = 12
ROWS = 2
#: One odd multiplier for each minimum hash.
ODD = np.random.default_rng(29).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def best_fit(sizes: list[int], sources: list[int], clusters: list[list[int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in bin) of each item; sources (-1 for none) and clusters are small ints."""
    bits: dict[int, int] = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    source_maps: list[int] = []
    cluster_maps: list[int] = []
    used: list[int] = []
    placed = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size = sizes[i]
        source = 1 << sources[i] if sources[i] >= 0 else 0
        # Bits only for clusters that occur: numbers are dealt as they come.
        cluster = 0
        for c in clusters[i]:
            cluster |= 1 << bits.setdefault(c, len(bits))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not source_maps[b] & source and not cluster_maps[b] & cluster:
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(used)
            source_maps.append(0)
            cluster_maps.append(0)
            used.append(0)
        placed[i] = (b, used[b])
        used[b] += 1
        source_maps[b] |= source
        cluster_maps[b] |= cluster
        if residual > size:
            insort(open_bins, (residual - size, b))
    return placed


def _numbers(values: pd.Series) -> list[int]:
    """0, 1, ... for values that occur more than once, -1 for others and nulls: they conflict with nothing."""
    codes, _ = pd.factorize(values)
    counts = np.bincount(codes[codes >= 0], minlength=1)
    return np.where((codes >= 0) & (counts[codes] > 1), codes, -1).tolist()


def _shared(bands: list) -> list[list[int]]:
    """For each item the numbers of its bands that another item has too, -1 left out."""
    flat = np.concatenate([np.empty(0, np.int64), *[b for b in bands if b is not None]])
    numbers, held, at = _numbers(pd.Series(flat)), [], 0
    for b in bands:
        n = 0 if b is None else len(b)
        held.append([x for x in numbers[at : at + n] if x >= 0])
        at += n
    return held


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = [0 if b is None or not len(b) else int(b[0]) for b in rows["bands"]]
        rows = rows.assign(first=first).sort_values(["doc_id", "n_tokens", "first"], na_position="last", kind="stable")
        n = rows["n_tokens"].to_numpy()
        full = n // capacity
        times = full + ((n % capacity > 0) | (n == 0))
        at = np.repeat(np.arange(len(rows)), times)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        size = np.where(piece < full[at], capacity, n[at] % capacity)
        clusters = _shared([rows["bands"].iloc[i] for i in at])
        placed = best_fit(size.tolist(), _numbers(rows["source"].iloc[at]), clusters, capacity)
        shard = int(rows["shard"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].iloc[at].astype("Int64").to_numpy(),
                "piece": piece,
                "first_token": piece * capacity,
                "n_tokens": size,
                "bin_id": [(shard << 32) | b for b, _ in placed],
                "place": [p for _, p in placed],
            }
        )

    return run


def band_keys(text: str | None) -> tuple[int, np.ndarray | None]:
    """Number of words, and the band keys of the text's five-word shingles; None without words."""
    ids = word_ids(text)
    h = shingle_hashes(ids)
    if not len(h):
        return 0, None
    least = np.array([mixed(h * odd).min() for odd in ODD], np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = mixed(key * MIX + least[:, row])
    return len(ids), key.view(np.int64)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [band_keys(text) for text in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "source": batch["source"],
                "row": batch["row"],
                "n_tokens": [n for n, _ in found],
                "bands": [keys for _, keys in found],
            }
        )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text, source); tokens are white-space words.

    Returns ``doc_id, piece, first_token, n_tokens, bin_id, place``:
    the pieces of a row cover all its tokens, a bin holds at most ``capacity``.
    Words count without their case for clusters; a text of fewer than five is one shingle.
    A null or empty text is one piece of 0 tokens, in no cluster. A null source conflicts
    with no source. A repeated row is packed again, in another bin.
    An empty table gives no rows.
    """
    # The place in the input, which a retried task repeats, spreads the rows of one doc_id.
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    base = rows.mapInPandas(_measure, "doc_id long, source string, row long, n_tokens long, bands array<long>")
    shards = max(1, -(-docs.count() // shard_docs))
    sharded = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
    return sharded.select("doc_id", "source", "n_tokens", "bands", "shard").groupBy("shard").applyInPandas(
        _pack(capacity),
        "doc_id long, piece long, first_token long, n_tokens long, bin_id long, place long",
    )
