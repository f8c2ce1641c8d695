"""Near-duplicate groups by improved consistent weighted sampling (ICWS).

Texts are lower-cased, split on white space and cut into five-word shingles
(a shorter text is one shingle). A shingle weighs

    tf * (1 + IDF_SHARE * idf),   idf = min(1, ln(N / df) / ln(TOLD))  in 0..1,

with N and df over all documents: shingles in less than one of TOLD documents
weigh the same, so the weights depend on shares of the corpus, not on its size.
df comes from a count sketch of 2**SKETCH_BITS buckets filled by every
document, less a bucket's median load; both grow with N, and at less than
2**SKETCH_BITS / TOLD shingles a document the rest of a bucket stays below the
least share told. The idf is smoothed and narrow for the sake of right
results: under plain tf * idf the edited words of a near copy, which are rare, outweigh
the shared ones, which its own group makes frequent (figures in the README).

Each document gets BANDS x ROWS consistent weighted samples (Ioffe's scheme:
two documents share a sample with a probability equal to their weighted
Jaccard similarity). Documents that share a band are candidates; a link is a
pair whose exact weighted Jaccard similarity is at least ``threshold``. Groups
are the connected components of links and of exact copies.

Buckets are never expanded into all pairs. First each text of a bucket is
compared with the bucket's least member, which is then done. Where the others of a bucket
are in several components of those links, the weight S of each text's shingles
that any other such text has is counted: a pair's similarity is at most
m / (W + W' - m) with m the lesser S and W, W' the total weights. The member
of the largest S / W is the second centre of comparison, such a member outside
the bucket's largest component the third. Then the texts outside the largest
component are compared with those texts of its other components that a finer
bound admits: m is the sum of lesser weights over HIST parts of the shingles.
So no link that could join two components of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 3
SKETCH_BITS = 18
IDF_SHARE = 0.5
TOLD = 128
#: Pairs of one centre that are verified in one task.
STAR = 256
HIST = 128
TABLE = 1 << 14
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 200_000


class _WordIds(dict):
    """64-bit hashes of words, kept while they fit a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_ids = _WordIds()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_ids(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """The hash of each run of five words in order; of fewer words, one of all; none for no words."""
    if not len(ids):
        return np.empty(0, np.uint64)
    width = min(WORDS, len(ids))
    n = len(ids) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mixed(h * MIX + ids[i : n + i])
    return h


def shingles(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    return np.unique(shingle_hashes(ids), return_counts=True)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    held, size, docs = [], 0, 0
    for batch in batches:
        for text in batch["text"]:
            h, _ = shingles(word_ids(text))
            held.append((h >> np.uint64(64 - SKETCH_BITS)).astype(np.intp))
            size += len(h)
            docs += 1
            if size >= CHUNK:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
    if size:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(counts[used], docs)})


def shingle_idf(docs: DataFrame) -> np.ndarray:
    """idf by sketch bucket: a float32 table of 2**SKETCH_BITS entries (1 MB)."""
    rows = (
        docs.select("text").mapInPandas(_sketch, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    loads = np.zeros(1 << SKETCH_BITS)
    inside = rows[rows["bucket"] >= 0]
    loads[inside["bucket"].to_numpy()] = inside["n"].to_numpy()
    total = max(2.0, float(rows.loc[rows["bucket"] < 0, "n"].sum()))
    df = np.clip(loads - np.median(loads), 1, total)
    return np.minimum(1, np.log(total / df) / np.log(TOLD)).astype(np.float32)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.intp)
    return tf.astype(np.float32) * (np.float32(1) + np.float32(IDF_SHARE) * idf[at])


class Sampler:
    """ICWS samples of many documents at once."""

    def __init__(self, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        k = BANDS * ROWS
        self.r = rng.gamma(2, 1, (k, TABLE)).astype(np.float32)
        self.lnc = np.log(rng.gamma(2, 1, (k, TABLE))).astype(np.float32)
        self.beta = rng.random((k, TABLE), np.float32)
        self.odd = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of band keys for each document; ``starts`` are its offsets in h."""
        lnw = np.log(w)
        keys = np.empty((len(starts), BANDS), np.int64)
        low = np.uint64(0xFFFFFFFF)
        for band in range(BANDS):
            key = np.full(len(starts), band + 1, np.uint64)
            for row in range(ROWS):
                k = band * ROWS + row
                hk = h * self.odd[k]
                hk ^= hk >> np.uint64(32)
                r = self.r[k].take((hk >> np.uint64(50)).astype(np.intp))
                lnc = self.lnc[k].take(((hk >> np.uint64(36)) & np.uint64(TABLE - 1)).astype(np.intp))
                beta = self.beta[k].take(((hk >> np.uint64(22)) & np.uint64(TABLE - 1)).astype(np.intp))
                t = np.floor(lnw / r + beta)
                ln_a = np.maximum(lnc - r * (t - beta + np.float32(1)) + np.float32(128), np.float32(1e-3))
                tag = (hk * MIX) ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
                packed = (ln_a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | ((tag >> np.uint64(20)) & low)
                key = mixed(key * MIX + (np.minimum.reduceat(packed, starts) & low))
            keys[:, band] = key.view(np.int64)
        return keys


def _signatures(idf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, table = Sampler(), idf.value
        for batch in batches:
            ids, held, size, begin = batch[["id", "real"]], [], 0, 0
            for i, text in enumerate(batch["text"]):
                words = word_ids(text)
                digest = xxhash.xxh3_128(words.tobytes()).intdigest()
                h, tf = shingles(words)
                held.append((digest, h, weights(h, tf, table)))
                size += len(h)
                if size >= CHUNK or i + 1 == len(ids):
                    yield _signed(sampler, ids.iloc[begin : i + 1], held)
                    held, size, begin = [], 0, i + 1

    return run


def _signed(sampler: Sampler, ids: pd.DataFrame, held: list) -> pd.DataFrame:
    full = [x for x in held if len(x[1])]
    bands = iter(())
    if full:
        lens = np.array([len(x[1]) for x in full])
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        bands = iter(sampler.bands(np.concatenate([x[1] for x in full]), np.concatenate([x[2] for x in full]), starts))
    return pd.DataFrame(
        {
            "id": ids["id"].to_numpy(),
            "real": ids["real"].to_numpy(),
            "hi": [(x[0] >> 64) - (1 << 63) for x in held],
            "lo": [(x[0] & ((1 << 64) - 1)) - (1 << 63) for x in held],
            "w": [float(x[2].sum(dtype=np.float64)) for x in held],
            "bands": [next(bands) if len(x[1]) else None for x in held],
        }
    )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    wa, wb = a[1][at[same]].astype(np.float64), b[1][same].astype(np.float64)
    least = np.minimum(wa, wb).sum()
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least))


def _verify(idf, threshold: float):
    def bag(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, tf = shingles(word_ids(text))
        return h, weights(h, tf, table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, last, left = idf.value, None, None
        for batch in batches:
            found = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, left = a, bag(ta, table)
                found.append(similarity(left, bag(tb, table)) >= threshold)
            yield batch.loc[np.array(found, bool), ["a", "b"]]

    return run


def links(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are similar enough. ``texts``: id, text.

    The pairs of one centre ``a`` are dealt to parts of about STAR pairs, each with a copy of its text, so a large star
    is verified by many tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts")).select("a", "b", "part")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(sizes, "a")
    left = left.select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    joined = dealt.join(right.hint("merge"), "b").join(left.hint("merge"), ["a", "part"]).select("a", "b", "ta", "tb")
    return joined.mapInPandas(_verify(idf, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of exact and near copies. One row per row of ``docs`` (doc_id, text).

    Returns ``doc_id, class_id, group_id, n_links, kept``: class_id is the least doc_id
    with the same words, group_id the least doc_id of the group, n_links the number of verified links of the
    class to others (of a group at least those that connect it), kept is true
    for the rows that carry the group's id. Null and empty texts have no words
    and form one class. Rows that repeat a doc_id count as one document, so
    their groups are joined. A null doc_id stands for a document of its own
    text, never kept over a numbered copy. Other columns are ignored; an empty table
    gives an empty result.
    """
    return _grouped(docs, threshold).select(
        F.when(F.col("real"), F.col("id")).alias("doc_id"),
        F.col("rep").alias("class_id"),
        F.col("label").alias("group_id"),
        "n_links",
        (F.col("id") == F.col("label")).alias("kept"),
    )


def own_id() -> F.Column:
    """doc_id, or without one an id of the text, past all doc_ids."""
    own = F.xxhash64("text").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    return F.coalesce(F.col("doc_id"), own)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least doc_id.

    Of rows that repeat this doc_id the least (by all columns) stays.
    """
    chosen = keep(
        _grouped(docs, threshold).where("id = label").groupBy("id").agg(F.count("*").alias("n")), "chosen"
    )
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("row"), own_id().alias("id"))
    once = rows.join(chosen.where("n = 1"), "id", "left_semi").select("row")
    if chosen.where("n > 1").isEmpty():
        return once.select("row.*")
    again = rows.join(chosen.where("n > 1"), "id", "left_semi").groupBy("id").agg(F.min("row").alias("row"))
    return once.unionByName(again.select("row")).select("row.*")


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """Each row's ``id, real, rep, label, n_links``: own id, class, group and links of the class.

    Joins of tables that grow with the corpus are merge joins at every size, so a small run shows what a large one does.
    """
    spark = docs.sparkSession
    base = docs.select(own_id().alias("id"), "text", F.col("doc_id").isNotNull().alias("real"))
    idf = spark.sparkContext.broadcast(shingle_idf(base))
    signed = keep(
        base.mapInPandas(
            _signatures(idf), "id long, real boolean, hi long, lo long, w double, bands array<long>"
        ),
        "signed",
    )
    classes = signed.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    chosen = (
        signed.join(classes.select("hi", "lo", F.col("rep").alias("id")).hint("merge"), ["hi", "lo", "id"], "left_semi")
        .dropDuplicates(["hi", "lo", "id"])
    )
    members = keep(
        chosen.where("bands is not null").select("id", "w", F.posexplode("bands").alias("band", "key")), "bands"
    )
    buckets = members.groupBy("band", "key").agg(
        F.min(F.struct("id", "w")).alias("least"), F.max("id").alias("most")
    ).where("least.id <> most")
    shared = keep(
        members.join(buckets.hint("merge"), ["band", "key"]).select("band", "key", "id", "w", F.col("least.id").alias("a"), F.col("least.w").alias("wa")),
        "shared",
    )
    wanted = shared.select("id").distinct()
    texts = base.select("id", "text").join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"])
    texts = keep(texts, "texts")
    close = F.least("w", "wa") >= F.lit(threshold * 0.999) * F.greatest("w", "wa")
    stars = keep(shared.where((F.col("id") != F.col("a")) & close).select("a", F.col("id").alias("b")).distinct(), "stars")
    found = keep(links(stars, texts, idf, threshold), "links")
    labels = components(found)
    # The least member has met all others of its bucket: what is left of two is done.
    mixed = keep(_mixed(shared.where(F.col("id") != F.col("a")), labels), "mixed")
    if not mixed.isEmpty():
        support = keep(_support(texts.join(mixed.select("id").distinct(), "id", "left_semi"), idf), "support")
        done = stars
        for outside in (False, True):
            again = keep(_central_pairs(mixed.join(support, "id"), threshold, outside).join(done, ["a", "b"], "left_anti"), "stars")
            done = done.unionByName(again)
            found = keep(found.unionByName(links(again, texts, idf, threshold)), "links")
            labels = components(found)
            mixed = keep(_mixed(mixed.select("band", "key", "id", "w"), labels), "mixed")
        rest = keep(_cross_pairs(mixed.join(support, "id"), threshold).join(done, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            found = keep(found.unionByName(links(rest, texts, idf, threshold)), "links")
            labels = components(found)
    same_id = _same_id(signed)
    if not same_id.isEmpty():
        labels = components(keep(found.unionByName(same_id), "links"))
    ends = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    grouped = (
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
        .select("hi", "lo", "rep", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    return signed.join(grouped.hint("merge"), ["hi", "lo"]).select("id", "real", "rep", "label", "n_links")


def _same_id(signed: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id that has several texts."""
    classes = signed.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    several = signed.groupBy("id").agg(
        F.min(F.struct("hi", "lo")).alias("x"), F.max(F.struct("hi", "lo")).alias("y")
    ).where("x <> y").select("id")
    spread = signed.join(several, "id", "left_semi").join(classes, ["hi", "lo"])
    return spread.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: ``band, key, id, w, label, top``."""
    named = shared.select("band", "key", "id", "w").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("label", F.coalesce("label", "id"))
    sizes = named.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "key").agg(
        F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("parts")
    ).where("parts > 1").select("band", "key", F.col("most.label").alias("top"))
    return named.join(mixed, ["band", "key"])


def _support(texts: DataFrame, idf) -> DataFrame:
    """``id, s, hist``: the weight of each text's shingles that another of ``texts`` has too, in all and by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = idf.value
        for batch in batches:
            held, size = [], 0
            for i, (doc, text) in enumerate(zip(batch["id"], batch["text"], strict=True)):
                h, tf = shingles(word_ids(text))
                held.append((np.full(len(h), doc), h.view(np.int64), weights(h, tf, table).astype(np.float64)))
                size += len(h)
                if size >= CHUNK or i + 1 == len(batch):
                    yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("id", "h", "w"), zip(*held, strict=True), strict=True)})
                    held, size = [], 0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hist = [np.bincount(p, w, HIST) for p, w in zip(batch["parts"], batch["ws"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "s": [x.sum() for x in hist], "hist": hist})

    rows = keep(texts.mapInPandas(run, "id long, h long, w double"), "shingles")
    several = rows.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("h")
    part = F.col("h").bitwiseAND(F.lit(HIST - 1)).cast("int")
    held = rows.join(several, "h").groupBy("id").agg(F.collect_list(F.struct(part.alias("p"), "w")).alias("x"))
    return held.select("id", F.col("x.p").alias("parts"), F.col("x.w").alias("ws")).mapInPandas(
        sums, "id long, s double, hist array<double>"
    )


def _bound(w1: str, s1: str, w2: str, s2: str, threshold: float) -> F.Column:
    """Whether the shared weights allow two texts to be similar enough."""
    most = F.least(s1, s2, w1, w2)
    return most >= F.lit(threshold * 0.999) * (F.col(w1) + F.col(w2) - most)


def _overlap(w1: str, hist1: str, w2: str, hist2: str, threshold: float) -> F.Column:
    """The same with the weights shared in each part of the shingles."""
    most = F.aggregate(F.zip_with(hist1, hist2, lambda x, y: F.least(x, y)), F.lit(0.0), lambda total, x: total + x)
    share = F.lit(threshold * 0.999)
    return most * (F.lit(1.0) + share) >= share * (F.col(w1) + F.col(w2))


def _central_pairs(mixed: DataFrame, threshold: float, outside: bool) -> DataFrame:
    """Each bucket's member of the largest shared share, with the members of other components.

    With ``outside`` the member is one outside the bucket's largest component.
    """
    order = F.struct((F.col("s") / F.col("w")).alias("share"), (-F.col("id")).alias("nid"))
    able = mixed.where("label <> top") if outside else mixed
    centre = able.groupBy("band", "key").agg(F.max_by(F.struct("id", "w", "s", "label"), order).alias("c"))
    centre = centre.select("band", "key", F.col("c.id").alias("c"), F.col("c.w").alias("wc"), F.col("c.s").alias("sc"), F.col("c.label").alias("lc"))
    return (
        mixed.drop("hist").join(centre, ["band", "key"])
        .where((F.col("lc") != F.col("label")) & _bound("w", "s", "wc", "sc", threshold))
        .select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()
    )


def _cross_pairs(mixed: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may still join two components of one bucket."""
    able = mixed.where(F.col("s") >= F.lit(threshold * 0.999) * F.col("w"))
    outside = able.where("label <> top").select(
        "band", "key", F.col("id").alias("u"), F.col("w").alias("wu"), F.col("s").alias("su"),
        F.col("label").alias("lu"), F.col("hist").alias("hu"),
    )
    return (
        outside.join(able.drop("top"), ["band", "key"])
        .where((F.col("lu") != F.col("label")) & _bound("w", "s", "wu", "su", threshold) & _overlap("w", "hist", "wu", "hu", threshold))
        .select(F.least("u", "id").alias("a"), F.greatest("u", "id").alias("b")).distinct()
    )
