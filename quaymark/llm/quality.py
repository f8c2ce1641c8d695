"""Quality rules: a base rule and robust multivariate outliers.

Each text gives five transformed statistics: log of the mean word length and
the square roots of the shares of symbols, repeated lines, repeated words and
capitals. The minimum-covariance-determinant (MCD) estimate of their centre
and scatter is found for each language and source, for each language and for
the corpus, over all rows that pass the base rule. Four deterministic starts
(quartile ranges alone, and with the correlations of tanh scores, of spatial
signs and of Cauchy-weighted scores) take ``STEPS`` concentration steps each:
keep the ``SHARE`` of rows nearest by Mahalanobis distance, take their mean
and covariance, and again. The start that ends with the least determinant
gives the estimate. ``FLOORS`` squared is added to the variances, as most
texts share the same value (0) in several statistics.

Every language and source has an estimate of its own, drawn towards that of
its language, and this towards the corpus, with the weight of ``PRIOR`` rows:
a source of few rows leans on its language, one of many hardly, and nothing
switches at a size. The scatter is scaled so that the median squared distance
is at most that of the chi-square distribution; rows beyond its ``CUTOFF``
quantile are rejected.

All of it is grouped aggregation with partial sums, so a source may hold any
share of the rows: estimates come to the rows by broadcast while they are at
most ``BROADCAST_ROWS``, else by a salted join, and the nearest rows are found
from a histogram of the log distance, whose bins are 1/64 of an octave wide.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("x_length", "x_symbols", "x_lines", "x_repeats", "x_capitals")
FLOORS = (0.08, 0.15, 0.15, 0.15, 0.08)
LEAST_WORDS = 50
SHARE = 0.75
STEPS = 4
CUTOFF = 0.999
BINS = 64
#: The weight, in rows, of the estimate above a group's own: ten for each statistic.
PRIOR = 50
#: What the identity adds to a start's correlations, so that they can be inverted.
RIDGE = 0.05
BROADCAST_ROWS = 20_000
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """The five counts of a text and its five transformed statistics."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    duplicates = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        number: defaultdict = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[at] > 1)
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[twice + i] = True
        repeated = int(covered.sum())
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    stats = [
        math.log(max(chars, 1) / max(n, 1)),
        math.sqrt(symbols / max(n, 1)),
        math.sqrt(duplicates / max(len(lines), 1)),
        math.sqrt(repeated / max(n, 1)),
        math.sqrt(capitals / max(chars, 1)),
    ]
    return n, chars, symbols, duplicates, repeated, stats


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [text_statistics(t) for t in batch["text"]]
        found = pd.DataFrame([(*r[:5], *r[5]) for r in rows], columns=[*COUNTS, *STATS])
        yield pd.concat([batch[["doc_id", "lang", "source"]].reset_index(drop=True), found], axis=1)


def chi2_quantile(q: float, p: int) -> float:
    """Quantile of the chi-square distribution, by bisection of its series."""

    def below(x: float) -> float:
        a, x = p / 2, x / 2
        term = total = 1 / a
        for i in range(1, 500):
            term *= x / (a + i)
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 1e-9, 20.0 * p + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < q else (low, mid)
    return (low + high) / 2


def _products(values: list[F.Column]) -> list[F.Column]:
    return [values[i] * values[j] for i in range(len(values)) for j in range(i, len(values))]


def _square(upper: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle, row by row."""
    p = len(STATS)
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


SCATTER = "struct<cov: array<double>, prec: array<double>, logdet: double>"


def _scatter(cov: np.ndarray) -> tuple:
    return cov.ravel(), np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])


def _start_scatter(scale: pd.Series, moments: pd.Series) -> pd.DataFrame:
    """The scatter of given deviations and of the correlations that some moments have."""
    out = []
    for s, m in zip(scale, moments, strict=True):
        corr = _square(m)
        d = np.sqrt(np.diag(corr))
        corr = np.where((d > 0)[:, None] & (d > 0), corr / np.where(d > 0, d, 1)[:, None] / np.where(d > 0, d, 1), 0.0)
        np.fill_diagonal(corr, 1.0)
        out.append(_scatter((RIDGE * np.eye(len(d)) + (1 - RIDGE) * corr) * np.outer(s, s)))
    return pd.DataFrame(out, columns=["cov", "prec", "logdet"])


def _step_scatter(n: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The floored covariance from sums of centred values and of their products."""
    floors = np.diag(np.square(FLOORS))
    out = [_scatter((_square(ss) - np.outer(s, s) / k) / max(k - 1, 1) + floors) for k, s, ss in zip(n, first, second, strict=True)]
    return pd.DataFrame(out, columns=["cov", "prec", "logdet"])


def _beside(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the rows of ``table``, one or few for each ``key``: broadcast, or joined with salt."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def _distance() -> F.Column:
    p = len(STATS)
    diff = [F.col(x) - F.col("mu")[i] for i, x in enumerate(STATS)]
    terms = [
        (1 if i == j else 2) * F.col("prec")[i * p + j] * diff[i] * diff[j] for i in range(p) for j in range(i, p)
    ]
    return sum(terms[1:], terms[0])


def _bin(d2: F.Column) -> F.Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-12))) * BINS).cast("int")


def _at_share(scored: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per group, the lowest bin that at least ``share`` of its rows are not above."""
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = scored.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return (
        bins.withColumn("upto", F.sum("n").over(order))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .where(F.col("upto") >= F.ceil(F.col("total") * share))
        .groupBy(*keys).agg(F.min("bin").alias("limit"))
    )


def _starts(rows: DataFrame) -> DataFrame:
    """``fit, start, mu, prec`` of the four starts of each group."""
    p = len(STATS)
    quart = rows.groupBy("fit").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 5000).alias(x) for x in STATS])
    spread = [F.sqrt(F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) + FLOORS[i] ** 2) for i, x in enumerate(STATS)]
    middle = keep(quart.select("fit", F.array(*[F.col(x)[1] for x in STATS]).alias("mu"), F.array(*spread).alias("s")), "mcd-middle")
    z = [(F.col(x) - F.col("mu")[i]) / F.col("s")[i] for i, x in enumerate(STATS)]
    scored = _beside(rows, middle, "fit").select("fit", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(p)]
    norm = sum([c * c for c in z[1:]], z[0] * z[0])
    moments = {
        "tanh": _products([F.tanh(c) for c in z]),
        "sign": [F.when(norm > 0, c / norm).otherwise(0.0) for c in _products(z)],
        "cauchy": [c / (1 + norm) for c in _products(z)],
    }
    sums = scored.groupBy("fit").agg(*[F.array(*[F.sum(c) for c in v]).alias(k) for k, v in moments.items()])
    none = F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(p) for j in range(i, p)])
    each = middle.join(sums, "fit").select("fit", "mu", "s", F.posexplode(F.array(none, *moments)).alias("start", "m"))
    return keep(each.select("fit", "start", "mu", F.pandas_udf(_start_scatter, SCATTER)("s", "m").alias("x")).select("fit", "start", "mu", "x.prec"), "mcd")


def mcd(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """MCD estimates by group: ``fit, mu, cov, scale, n`` from ``rows`` (fit, statistics)."""
    p, keys = len(STATS), ["fit", "start"]
    found = _starts(rows)
    for _ in range(steps):
        scored = _beside(rows, found, "fit").withColumn("bin", _bin(_distance()))
        limits = keep(_at_share(scored, keys, share).join(found, keys), "mcd-limits")
        near = _beside(rows, limits, "fit").where(_bin(_distance()) <= F.col("limit"))
        diff = [F.col(x) - F.col("mu")[i] for i, x in enumerate(STATS)]
        sums = near.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.max("mu").alias("mu"),
            F.array(*[F.sum(d) for d in diff]).alias("s"),
            F.array(*[F.sum(c) for c in _products(diff)]).alias("ss"),
        )
        centre = F.zip_with("mu", "s", lambda m, s: m + s / F.col("n")).alias("mu")
        found = keep(sums.select(*keys, centre, F.pandas_udf(_step_scatter, SCATTER)("n", "s", "ss").alias("x")).select(*keys, "mu", "x.*"), "mcd")
    least = F.min(F.struct("logdet", "start")).over(Window.partitionBy("fit"))
    best = keep(found.withColumn("least", least).where("least.start = start").drop("least", "logdet", "start"), "mcd")
    scored = _beside(rows, best, "fit").withColumn("bin", _bin(_distance()))
    sizes = scored.groupBy("fit").agg(F.count("*").alias("n"))
    middle = _at_share(scored, ["fit"], 0.5).select(
        "fit", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("limit") + 0.5) / BINS) / chi2_quantile(0.5, p)).alias("scale")
    )
    return keep(best.join(middle, "fit").join(sizes, "fit").select("fit", "mu", "cov", "scale", "n"), "mcd")


def drawn(n: int, mu: np.ndarray, cov: np.ndarray, scale: float, above: tuple) -> tuple:
    """A group's centre, scatter and scale drawn towards those of the group above it, of the weight of PRIOR rows."""
    rho = PRIOR / (n + PRIOR)
    apart = mu - above[0]
    return (
        (1 - rho) * mu + rho * above[0],
        (1 - rho) * cov + rho * above[1] + rho * (1 - rho) * np.outer(apart, apart),
        (1 - rho) * scale + rho * above[2],
    )


DRAWN = "struct<mu: array<double>, prec: array<double>, scale: double>"


def _drawn_twice(own: pd.DataFrame, lang: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
    p, out = len(STATS), []
    for rows in zip(*(x.itertuples(index=False) for x in (corpus, lang, own)), strict=True):
        top, *below = [(r.n, np.asarray(r.mu), np.asarray(r.cov).reshape(p, p), r.scale) for r in rows]
        found = top[1:]
        for level in below:
            found = drawn(*level, found)
        out.append((found[0], np.linalg.inv(found[1]).ravel(), float(found[2])))
    return pd.DataFrame(out, columns=["mu", "prec", "scale"])


def _own() -> F.Column:
    return F.to_json(F.struct("lang", "source"))


def _language() -> F.Column:
    return F.to_json(F.struct("lang"))


def measure(docs: DataFrame) -> DataFrame:
    """Counts, statistics and base verdict of each row (doc_id, text, lang, source), written once."""
    numbers = [f"{c} long" for c in COUNTS] + [f"{x} double" for x in STATS]
    base = docs.select("doc_id", "lang", "source", "text").mapInPandas(
        _measure, ", ".join(["doc_id long, lang string, source string", *numbers])
    )
    return keep(base.withColumn("base_failed", _failed()), "stats")


def _failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(measured: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Estimates for each language and source: ``own, mu, prec, scale, n``."""
    passed = measured.where("not base_failed").withColumns({"own": _own(), "language": _language()})
    found = mcd(passed.select(F.explode(F.array(F.lit(""), "language", "own")).alias("fit"), *STATS), share, steps)
    groups = keep(passed.select("own", "language").distinct(), "groups")

    def level(name: str, key: F.Column) -> DataFrame:
        return found.select(key.alias("key"), F.struct("n", "mu", "cov", "scale").alias(name))

    rows = (
        groups.join(level("a", F.col("fit")), F.col("own") == F.col("key")).drop("key")
        .join(level("b", F.col("fit")), F.col("language") == F.col("key")).drop("key")
        .join(F.broadcast(level("c", F.col("fit")).where("key = ''").drop("key")))
    )
    return keep(rows.select("own", "a.n", F.pandas_udf(_drawn_twice, DRAWN)("a", "b", "c").alias("x")).select("own", "n", "x.*"), "fitted")


def _kept(cutoff: float) -> F.Column:
    near = _distance() / F.col("scale") <= chi2_quantile(cutoff, len(STATS))
    return ~F.col("base_failed") & F.coalesce(near, F.lit(False))


def judge(docs: DataFrame, share: float = SHARE, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept``. base_failed: fewer than 50
    words, or more than half of them in repeated three-word windows. distance
    is the squared robust distance, null where base_failed. A null or empty
    text has no words and fails. Null lang or source is a value of its own;
    repeated rows count and return each; an empty table gives no rows.
    """
    measured = measure(docs)
    judged = _beside(measured.withColumn("own", _own()), fit(measured, share, steps), "own", "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return judged.select("doc_id", *COUNTS, "base_failed", distance.alias("distance"), _kept(cutoff).alias("kept"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Whole rows are never shuffled while the estimates, one row for each language and source, can
    be broadcast: the texts are measured again beside them.
    """
    fitted = fit(measure(docs))
    numbers = ", ".join([f"{c}: long" for c in COUNTS] + [f"{x}: double" for x in STATS])

    @F.pandas_udf(f"struct<{numbers}>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [text_statistics(t) for t in texts]
        return pd.DataFrame([(*r[:5], *r[5]) for r in rows], columns=[*COUNTS, *STATS])

    row = F.struct(*[F.col(c) for c in docs.columns])
    found = docs.select(row.alias("row"), measured("text").alias("m"), _own().alias("own"))
    found = found.select("row", "own", "m.*").withColumn("base_failed", _failed())
    return _beside(found, fitted, "own").where(_kept(cutoff)).select("row.*")
