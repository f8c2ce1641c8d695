"""Substring dedup by recompression: long repeats are found from shared symbols.

A text is a string of words, each named by 64-bit hashes of its bytes. Rounds
of recompression shorten it: maximal runs of one symbol get the name of symbol
and length, then the alphabet is halved (by a bit of the name, another for each
round) and a symbol of the left half followed by one of the right half gets the
name of the pair. Names are functions of what they stand for, so they are the
same in the whole corpus. Which symbols arise at a place depends on the words
about it only; every symbol carries the range of words that settles it
(``_rounds``), and each occurrence of that range has the same symbol.

A window of ``WINDOW`` words takes, of the symbols that its own words settle,
the one of least hash as its anchor: equal windows have equal anchors. The
windows of one anchor form a stretch. Spark groups the stretches by anchor:

* an anchor with one stretch in the corpus: none of its windows repeats;
* a stretch that occurs earlier word for word: all its windows repeat;
* an anchor with several different stretches: their windows are compared.

The second Spark round compares those windows by 128-bit names and takes the
first place of each; the third removes the words that repeating windows cover.
A window without a settled symbol (runs and other short periods) is its own
stretch.

Within an Arrow batch an anchor or window is sent once for each place that can
be first, so a common one brings a row for each batch and not for each text;
stretches of an anchor that differs within a batch are dealt out by their own
place. Texts travel twice, to meet what was found on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 20
ROUNDS = 3
#: Text bytes that are worked on at once; one longer text is worked on alone.
PIECE_BYTES = 4 << 20
#: Longer words are named by a digest, shorter ones eight bytes at a time.
LONG_WORD = 64
BASE = 0x9E3779B97F4A7C15
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Keeps the first n of eight bytes.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_names(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and two names of each word."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0])
    raw = np.zeros(size + 8, np.uint8)
    if size:
        raw[:size] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    edges = at - at[0]
    blank = BLANK[raw[:size]]
    before, after = np.ones(size + 1, bool), np.ones(size + 1, bool)
    before[1:] = np.append(blank[:-1], True) if size else True
    after[:-1] = np.append(blank[1:], True) if size else True
    before[edges] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~blank & before[:size])
    lengths = np.flatnonzero(~blank & after[:size]) + 1 - starts
    counts = np.diff(np.searchsorted(starts, edges))
    eight = np.ndarray((size + 1,), "<u8", raw.data, 0, (1,))
    part = eight[starts] & FIRST_BYTES[np.minimum(lengths, 8)]
    names = [_mix((part + U(seed)) ^ _mix(lengths.astype(U) + U(seed))) for seed in SEEDS]
    for k in range(8, LONG_WORD, 8):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        part = eight[starts[more] + k] & FIRST_BYTES[np.minimum(lengths[more] - k, 8)]
        for name, seed in zip(names, SEEDS, strict=True):
            name[more] = _mix(name[more] * U(5) ^ (part + U(seed)))
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(raw[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=16).digest()
        names[0][i], names[1][i] = np.frombuffer(digest, U)
    return counts, names[0], names[1]


class _Contents:
    """Names of word ranges, by prefix sums."""

    def __init__(self, names: np.ndarray) -> None:
        powers = np.cumprod(np.full(len(names) + 1, BASE, U))
        self.back = np.cumprod(np.full(len(names) + 1, pow(BASE, -1, 1 << 64), U))
        self.sums = np.zeros(len(names) + 1, U)
        np.cumsum(names * powers[:-1], out=self.sums[1:])

    def name(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U))


def _rounds(words: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that settle each symbol after so many rounds: first, and one past the last.

    Both rise from symbol to symbol. At the ends of a text they lie outside of it, as
    another text may go on there.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    name, start, stop = words, np.arange(n), np.arange(1, n + 1)
    low, high = start, stop
    for r in range(rounds):
        salt = U((r + 1) * BASE & (1 << 64) - 1)
        # Runs: a symbol's neighbours must differ. They do where the words next to it differ; else the neighbour must be settled.
        joined = text[1:] == text[:-1]
        same = joined & (name[1:] == name[:-1])
        first = np.flatnonzero(np.append(True, ~same))
        last = np.append(first[1:], len(name)) - 1
        length = (last - first + 1).astype(U)
        left_open, right_open = np.append(True, ~joined)[first], np.append(~joined, True)[last]
        begin, end = start[first], stop[last]
        alike_left = ~left_open & (words[begin - 1] == words[stop[first] - 1])
        alike_right = ~right_open & (words[np.minimum(end, n - 1)] == words[start[last]])
        low_new = np.minimum(low[first], np.where(alike_left, low[first - 1], begin - 1))
        high_new = np.maximum(high[last], np.where(alike_right, high[np.minimum(last + 1, len(high) - 1)], end + 1))
        named = name[first]
        name = np.where(length > 1, _mix(named ^ _mix(length + salt)), named)
        start, stop, low, high, text = begin, end, low_new, high_new, text[first]
        # Pairs: left half before right half. A single symbol of the left half rests on what follows it, of the right half on what comes before.
        left = (_mix(name ^ salt) & U(1)).astype(bool)
        joined = text[1:] == text[:-1]
        pair = np.append(left[:-1] & ~left[1:] & joined, False)
        second = np.append(False, pair[:-1])
        single = ~pair & ~second
        follows = np.append(np.where(joined, high[1:], stop[:-1] + 1), stop[-1] + 1)
        precedes = np.append(start[0] - 1, np.where(joined, low[:-1], start[1:] - 1))
        high_new = np.where(single & left, np.maximum(high, follows), high)
        low_new = np.where(single & ~left, np.minimum(low, precedes), low)
        i = np.flatnonzero(pair)
        name, stop = name.copy(), stop.copy()
        name[i] = _mix(_mix(name[i] + salt) * U(3) + name[i + 1])
        stop[i] = stop[i + 1]
        high_new[i] = np.maximum(high_new[i], high_new[i + 1])
        low_new[i] = np.minimum(low_new[i], low_new[i + 1])
        kept = ~second
        name, start, stop, low, high, text = name[kept], start[kept], stop[kept], low_new[kept], high_new[kept], text[kept]
    return low, high


def _least(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where keys is least in each range, leftmost of equals; no range is empty."""
    depth = np.log2(high - low).astype(np.int64)
    found = np.zeros(len(low), np.int64)
    at = np.arange(len(keys))
    for k in range(int(depth.max(initial=-1)) + 1):
        if k:
            other = at[1 << (k - 1) :]
            here = at[: len(other)]
            at = np.where(keys[here] <= keys[other], here, other)
        mine = np.flatnonzero(depth == k)
        a, b = at[low[mine]], at[high[mine] - (1 << k)]
        found[mine] = np.where(keys[a] <= keys[b], a, b)
    return found


def stretches(counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's name and own name of every stretch, in order of place."""
    n = len(one)
    room = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    window = np.flatnonzero(room >= WINDOW)
    if not len(window):
        return window, window, window.astype(U), window.astype(U)
    contents, others = _Contents(one), _Contents(two)
    low, high = _rounds(one, counts, ROUNDS)
    name = contents.name(np.maximum(low, 0), np.minimum(high, n))
    first, past = np.searchsorted(low, window), np.searchsorted(high, window + WINDOW, "right")
    has = past > first
    anchor = np.full(len(window), -1)
    anchor[has] = _least(name, first[has], past[has])
    new = np.append(True, (anchor[1:] != anchor[:-1]) | ~has[1:] | (window[1:] != window[:-1] + 1))
    at = np.flatnonzero(new)
    begin, many = window[at], np.diff(np.append(at, len(window)))
    alone = contents.name(begin, begin + WINDOW)
    key = np.where(has[at], name[anchor[at]], alone)
    return begin, many, key, others.name(begin, begin + many + WINDOW - 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts have about ``PIECE_BYTES``."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            held = sizes[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(sizes, held + PIECE_BYTES, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _ranks(ids: pa.Array) -> np.ndarray:
    """Ids as numbers in their order, null first."""
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    _, rank = np.unique(filled, return_inverse=True)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, rank)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each place belongs to."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _first_of_each(run: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, run[1:] != run[:-1]))[run] if len(run) else run


#: A row's mark (``MARK_BITS`` of a hash of its text, which tells rows of one doc_id apart) goes above its place in one number.
PLACE_BITS, MARK_BITS = 38, 26
#: place: start * 128 + number of windows * 4 + mixed * 2 + loose.
STRETCH = "doc_id long, pk long, own long, spot long"


def _send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        counts, one, two = word_names(piece.column("text"))
        begin, many, key, own = stretches(counts, one, two)
        text = np.repeat(np.arange(len(counts)), counts)[begin]
        base = (np.cumsum(counts) - counts)[text]
        place = (begin - base) * 32 + many
        rank, mark = _ranks(piece.column("doc_id"))[text], piece.column("mark").to_numpy()[text]
        order = np.lexsort((mark, place, rank, own, key))
        key, own, place, rank, mark, text = key[order], own[order], place[order], rank[order], mark[order], text[order]
        run = _runs(key, own)
        first = _first_of_each(run)
        # Only the first place of a stretch is sent, once.
        sent = (place == place[first]) & (rank == rank[first])
        sent &= np.append(True, (run[1:] != run[:-1]) | (mark[1:] != mark[:-1]))[: len(sent)]
        key, own, place, mark, text = key[sent], own[sent], place[sent], mark[sent], text[sent]
        run = _runs(key)
        first = _first_of_each(run)
        differs = np.zeros(len(key), bool)
        np.logical_or.at(differs, first, own != own[first])
        mixed = differs[first]
        loose = mixed & (first != np.arange(len(key)))
        pk = np.where(loose, _mix(own ^ place.astype(U)), key)
        place = place * 4 + mixed * 2 + loose
        ids, spot = piece.column("doc_id").take(pa.array(text)), (mark.astype(np.int64) << PLACE_BITS) | place
        yield pa.RecordBatch.from_arrays([ids, pa.array(pk.view(np.int64)), pa.array(own.view(np.int64)), pa.array(spot)], ["doc_id", "pk", "own", "spot"])


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


WINDOWS = "doc_id long, one long, two long, spot long, stop int"


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to compare (stop null), and ranges of words that repeating windows cover."""
    for piece in _pieces(batches):
        counts, one, two = word_names(piece.column("text"))
        n = len(one)
        edges = np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)
        listed = piece.column("listed")
        sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = listed.flatten().to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(len(counts)), sizes)
        begin, many = (rows >> 6) + (edges - counts)[whose], (rows >> 1) & 31
        # A window that is in no listed stretch repeats; one in a listed stretch is compared or stands alone.
        repeats = edges[text] - np.arange(n) >= WINDOW
        each = np.repeat(begin - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        repeats[each] = False
        window = np.unique(each[np.repeat(rows & 1 == 1, many)])
        contents, others = _Contents(one), _Contents(two)
        key, own = contents.name(window, window + WINDOW), others.name(window, window + WINDOW)
        rank, mark = _ranks(piece.column("doc_id")), piece.column("mark").to_numpy()
        doc = text[window]
        start = window - (edges - counts)[doc]
        order = np.lexsort((mark[doc], start, rank[doc], own, key))
        window, key, own, doc, start = window[order], key[order], own[order], doc[order], start[order]
        run = _runs(key, own)
        first = _first_of_each(run)
        is_first = (rank[doc] == rank[doc[first]]) & (start == start[first])
        repeats[window[~is_first]] = True
        is_first &= np.append(True, (run[1:] != run[:-1]) | (mark[doc[1:]] != mark[doc[:-1]]))[: len(doc)]
        key, own, doc, start = key[is_first], own[is_first], doc[is_first], start[is_first]
        # Words under repeating windows, as ranges within each text.
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(repeats)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        covered = np.cumsum(cover[:n]) > 0
        low, high = _ranges(covered)
        inner = edges[(edges > 0) & (edges < n)]
        inner = np.unique(inner[covered[inner - 1] & covered[inner]]) if n else inner
        low, high = np.sort(np.append(low, inner)), np.sort(np.append(high, inner))
        whose = text[low] if len(low) else low
        base = (edges - counts)[whose]
        spread = _mix(low.astype(U) + _mix(mark[whose].astype(U)))
        ids = piece.column("doc_id").take(pa.array(np.append(doc, whose)))
        stops = pa.array(np.append(np.zeros(len(doc), np.int64), high - base).astype(np.int32), mask=np.arange(len(doc) + len(low)) < len(doc))
        begin = np.append(start, low - base)
        spot = (np.append(mark[doc], mark[whose]).astype(np.int64) << PLACE_BITS) | begin
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.append(key, spread).view(np.int64)), pa.array(np.append(own, spread).view(np.int64)), pa.array(spot), stops],
            ["doc_id", "one", "two", "spot", "stop"],
        )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, digests, texts = [], [], [], []
            for raw, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (raw or b"").split()  # at exactly \x20 and \x09-\x0D
                kept = words
                if spans:
                    gone = np.zeros(len(words), bool)
                    for s in spans:
                        gone[s["start"] : s["stop"]] = True
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                text = b" ".join(kept)
                totals.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["mark"] == found["mark"])
    return docs.join(found, same, "left").drop(found["doc_id"]).drop(found["mark"])


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``WINDOW`` words that starts earlier too.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``
    (``doc_id, text``; other columns are not read), and ``kept_text`` if asked
    for. Earlier means a smaller doc_id, or the same doc_id and an earlier
    start; a null doc_id comes before all. Rows that share a doc_id count as one
    document: equal places take nothing from each other, so a row that is there
    twice stays twice. Null and empty texts have no words, texts of fewer than
    ``WINDOW`` words lose none; an empty table gives an empty one.
    """
    mark = F.hash(F.coalesce("text", F.lit(""))).bitwiseAND((1 << MARK_BITS) - 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    whose = F.shiftrightunsigned("spot", PLACE_BITS).cast("int").alias("mark")
    place = F.col("spot").bitwiseAND((1 << PLACE_BITS) - 1)
    sent = texts.mapInArrow(_send_stretches, STRETCH)
    at = F.shiftright(place, 2)
    here, mixed, loose = F.struct("doc_id", at), place.bitwiseAND(2) > 0, place.bitwiseAND(1) > 0
    anchors, same = Window.partitionBy("pk"), Window.partitionBy("pk", "own")
    grouped = sent.withColumns(
        {
            "several": F.max(mixed).over(anchors) | (F.min("own").over(anchors) != F.max("own").over(anchors)),
            "first": F.min(F.when(~loose, here)).over(same),
        }
    )
    alone = grouped.where(loose | (here == F.col("first")))
    entry = at * 2 + (F.col("several") | mixed).cast("long")
    listed = alone.groupBy("doc_id", whose).agg(F.collect_set(entry).alias("listed"))
    windows = _beside(texts, listed).select("doc_id", "mark", "text", "listed").mapInArrow(_send_windows, WINDOWS)
    here = F.struct("doc_id", place)
    first = F.min(F.when(F.col("stop").isNull(), here)).over(Window.partitionBy("one", "two"))
    repeats = windows.withColumn("first", first).where(F.col("stop").isNotNull() | (here != F.col("first")))
    start = place.cast("int")
    span = F.struct(start.alias("start"), F.coalesce("stop", start + WINDOW).alias("stop"))
    spans = repeats.groupBy("doc_id", whose).agg(F.collect_set(span).alias("spans"))
    found = _beside(texts, spans).select("doc_id", "text", "spans").mapInArrow(_cut(with_text), RESULT)
    return found if with_text else found.drop("kept_text")
