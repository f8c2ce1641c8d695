"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, modulo
a prime, so all anagrams share it. Two words that differ by one inserted or
deleted letter have keys that differ by that letter's power; two that differ by
one replaced letter have the same key after each gives up one letter. So each
word is sent under its own key and under its key less each of its letters, and
equal keys meet in a join.

Letter order decides: an edit at one place leaves the half of the word on the
other side of it untouched. The half goes with the key, so anagrams of a key meet
only if half of their letters stand at the same places; what is left is verified
letter by letter. All of it is Spark expressions.

Joins are merges by hint: Spark takes the size of the stored words for that of
the rows exploded from them (some thirteen a word, each with its letters), and
would broadcast those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs of a document, by hash, loses a letter.
SLIPS = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
TIMES = 5
PRIME = (1 << 61) - 1


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: occurrences of the words of all texts, after the slips.

    A run of letters loses one where ``SLIPS`` divides its hash with the doc_id. Words of fewer
    than ``LEAST_LETTERS`` letters or ``LEAST_COUNT`` occurrences are left out.
    Runs are counted by document first, as the hash is the same for all repeats in it.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        # A shorter run can't give a word that is long enough.
        F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"),
    )
    plain = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(h % SLIPS == 0, slipped).otherwise(F.col("run"))
    counted = plain.select(word.alias("word")).where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")  # of Latin-1 letters: the code point
    return code * code * code * code * code


def _key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: (s + _power(x)) % PRIME)


def _one_replaced(a: Column, b: Column) -> Column:
    """Words of one length differ at exactly one place."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) == 1


def _one_missing(long: Column, short: Column) -> Column:
    """``short`` is ``long`` without one letter: the letters before the first difference agree, and so do those after it."""
    n = F.size(short)
    differs = F.array_position(F.zip_with(F.slice(long, F.lit(1), n), short, lambda x, y: x != y), True)
    at = F.when(differs == 0, n + 1).otherwise(differs).cast("int")
    return F.slice(long, at + 1, n - at + 1) == F.slice(short, at, n - at + 1)


def _halves(rows: DataFrame, word: Column, size: Column) -> DataFrame:
    """Each row twice: with the first ``size // 2`` letters, and with the last ``size - size // 2``.

    ``size`` is the length of the longer word of a pair. An edit at or after the middle leaves the first half, one before it the second.
    """
    half = F.floor(size / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), half).alias("half")),
        F.struct(F.lit(1).alias("side"), F.right(word, size - half).alias("half")),
    )
    return rows.withColumn("size", size).select("*", F.explode(sides).alias("s")).select("*", "s.side", "s.half").drop("s")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, m``: every ordered pair of words one letter apart, with their counts."""
    letters = F.split("word", "")
    length = F.char_length("word")
    held = words.select("word", "n", letters.alias("letters"), _key(letters).alias("key"), length.alias("length"))
    less = held.select("*", F.explode(F.array_distinct("letters")).alias("letter"))
    less = _halves(less.withColumn("key", (F.col("key") + PRIME - _power(F.col("letter"))) % PRIME), F.col("word"), F.col("length"))
    whole = _halves(held, F.col("word"), F.col("length") + 1)
    same = ["key", "size", "side", "half"]
    columns = [F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("m")]
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "size", "side", "half")]
    # Each pair of unlike letters once; the differing place lies in one half, so the other half brings the pair once.
    unlike = (F.col("a.letter") != F.col("b.letter")) & (F.col("a.word") < F.col("b.word"))
    replaced = less.alias("a").join(less.alias("b").hint("merge"), [*meet, unlike]).where(_one_replaced(F.col("a.letters"), F.col("b.letters")))
    missing = less.alias("a").join(whole.alias("b").hint("merge"), meet).where(_one_missing(F.col("a.letters"), F.col("b.letters")))
    # A letter missing from a run of equal ones may show on both sides.
    once = replaced.select(*columns).unionByName(missing.select(*columns).distinct())
    both = F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    return once.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow each word.

    A form is ``TIMES`` times as frequent as its word, so chains are short, and
    each round doubles the steps taken.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = keep(roots.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame) -> DataFrame:
    """Each frequent word with its form, root and number of near words.

    Returns ``word, form, root, n, n_near, form_n``. Near words differ by exactly one
    inserted, deleted or replaced letter; the form is the most frequent of them (ties:
    the smallest in code-point order), if ``TIMES`` as frequent as the word. Null and empty texts have
    no words; a null doc_id hashes as an empty one; each row of ``docs`` (``doc_id, text``) counts, repeats too; an
    empty table gives an empty one.
    """
    words = keep(count_words(docs), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = F.col("best.m") * -1 >= F.col("n") * TIMES
    found = keep(near.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "near")
    roots = _roots(found.where("form IS NOT NULL"))
    return (
        words.join(found.hint("merge"), "word", "left")
        .join(roots.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
