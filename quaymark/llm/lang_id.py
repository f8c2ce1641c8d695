"""Language identification by rank-order n-gram profiles.

A text is lower-cased, every character that is no letter counts as a space,
and words are padded by one space. Its n-grams of 1 to 3 characters (without
an inner space) are ranked by frequency, ties by code. A language's profile
holds the ``PROFILE`` most frequent n-grams of all its training texts. The
out-of-place distance of a document adds, for each of its ``TOP`` most
frequent n-grams, the difference of the two ranks, or ``PROFILE`` where the
profile lacks the n-gram. The language of the least distance wins, ties by
name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
TOP = 300
UNKNOWN = "und"
SPACE = 32
FLUSH = 500_000


@cache
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes (21 bits a character), sorted, and their counts."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate(([SPACE], _letters()[raw], [SPACE])).astype(np.uint64)
    space = chars == SPACE
    chars = chars[~(space & np.concatenate(([False], space[:-1])))]
    space = chars == SPACE
    one = chars[~space]
    if not len(one):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    shift = np.uint64(21)
    two = (chars[:-1] << shift) | chars[1:]
    three = ((two[:-1] << shift) | chars[2:])[~space[1:-1]]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def top_ngrams(text: str | None, top: int = TOP) -> np.ndarray:
    codes, counts = ngrams(text)
    if len(codes) > top:  # those at least as frequent as the last that can be in
        in_reach = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[in_reach], counts[in_reach]
    return codes[np.lexsort((codes, -counts))][:top]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts: flushed whenever they reach a bounded size."""
    held: dict[str, list] = {}

    def flush(lang: str) -> pd.DataFrame:
        codes, at = np.unique(np.concatenate([x[0] for x in held[lang]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x[1] for x in held[lang]]), len(codes)).astype(np.int64)
        del held[lang]
        return pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found = ngrams(text)
            held.setdefault(lang, []).append(found)
            size += len(found[0])
            if size > FLUSH:
                for name in list(held):
                    yield flush(name)
                size = 0
    for name in list(held):
        yield flush(name)


def learn_profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, from all rows of ``train`` (text, lang).

    Rows without lang or text teach nothing. The result holds ``size`` numbers
    for each distinct lang value; those are few by nature.
    """
    counts = (
        train.select("lang", "text").where("lang is not null and text is not null")
        .mapInPandas(_count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).toPandas()
    return {
        lang: rows.sort_values("rank")["code"].to_numpy().view(np.uint64)
        for lang, rows in ranked.groupby("lang", sort=True)
    }


class Ranker:
    """Out-of-place distances to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.langs = sorted(profiles)
        self.top = top
        self.size = max([len(p) for p in profiles.values()], default=1)
        self.codes = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        # One row a language: the rank of each code, or -1; the last column is any other n-gram.
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest possible distance."""
        best = top_ngrams(text, self.top)
        if not len(best) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, best)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == best, at, len(self.codes)) if len(self.codes) else np.zeros(len(best), int)
        ranks = self.ranks[:, at]
        out = np.where(ranks >= 0, np.abs(ranks - np.arange(len(best))), self.size)
        far = np.minimum(out, self.size).sum(axis=1)
        i = int(np.argmin(far))
        return self.langs[i], float(1 - far[i] / (self.size * len(best)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``, from ``text`` alone.

    A null text and one without a letter get ``und`` and 0. All columns of
    ``docs`` stay; of those, lang_pred and score are replaced if present.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(shared.value, top)
        for texts in batches:
            yield pd.DataFrame([ranker.predict(x) for x in texts], columns=["lang_pred", "score"])

    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    return docs.select(row, predict("text").alias("found")).select("row.*", "found.lang_pred", "found.score")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Learn from documents that aren't held out and predict every document.

    Returns ``doc_id, held_out, lang_pred, score`` for each row, repeated rows
    and null ids (never held out) included; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    profiles = learn_profiles(base.where("not held_out"))
    found = identify(base.select("doc_id", "held_out", "text"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")
