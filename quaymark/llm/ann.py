"""Approximate nearest neighbours by score-aware quantisation and exact reranking.

A vector is cut into pieces of ``PIECE`` numbers; each piece is coded by one
of 16 centres (four bits, two codes to a byte). Codes and centres minimise the anisotropic loss of
maximum-inner-product search: the part of the residual parallel to the vector
weighs eta = (d - 1) T^2 / (1 - T^2) times the rest, for the score threshold
T. The centres are fitted on a bounded sample of ``TRAIN`` vectors; every
vector is coded, as its offset from its leaf's centre in units of the leaf's
spread, so that neither a common offset nor dense clusters use up the codes.
A query scans 8-bit tables of its products with the centres; with the norms of
the coded vector and of its residual they give an estimate of each distance and
the most it can err by.

Vectors are assigned to leaves of about ``LEAF`` (at most ``LEAVES``), by centres fitted on the
same sample, and a query first scans the fewest leaves, nearest first, that held
``REACH`` of the true neighbours within the sample: few where vectors form
clusters, nearly all where they do not. A second scan takes each other leaf
whose border or radius is not beyond the distances then known. Tasks hold one
part of a leaf, at most about ``BLOCK``, and a block of queries. There the best
``SHORTLIST`` by estimate, and some spread over the part, are measured exactly;
they show how far the estimates err in this part, and every vector whose
estimate leaves it within reach of the nearest found is measured too. Equal vectors are searched as
one, with their least ids; vectors of each length are searched apart, as no
distance joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

K = 10
PIECE = 2
CENTRES = 16
TRAIN = 20_000
ROUNDS = 5
THRESHOLD = 0.2
SHORTLIST = 192
LEAF = 8_192
LEAVES = 1_024
REACH = 0.99
PROBE_QUERIES = 200
BLOCK = 16_384
SCAN = 128
SPACED = 64
MARGIN = 1.25
QUERY_BLOCK = 2_048


class Codebook:
    """Centres of all pieces: ``centres[m, k]`` of ``PIECE`` numbers."""

    def __init__(self, centres: np.ndarray, eta: float) -> None:
        self.centres, self.eta = centres, eta

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = ROUNDS, threshold: float = THRESHOLD, seed: int = 5) -> Codebook:
        n, d = sample.shape
        pieces = -(-d // PIECE)
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        x = _pieces(sample, pieces)
        first = rng.choice(n, CENTRES, replace=n < CENTRES)
        book = cls(np.ascontiguousarray(x[first].transpose(1, 0, 2)), eta)
        for i in range(rounds):
            codes = book.encode(sample, passes=1 if i else 0)
            book._update(sample, codes)
        return book

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by nearest centre, then ``passes`` rounds over the pieces under the anisotropic loss."""
        pieces = len(self.centres)
        x, u = _pieces(vectors, pieces), _pieces(_directions(vectors), pieces)
        codes = np.empty((len(x), pieces), np.uint8)
        parallel = np.zeros((len(x), pieces))
        for m in range(pieces):
            r = x[:, m, None, :] - self.centres[m]
            codes[:, m] = np.argmin(np.square(r).sum(-1), axis=1)
            parallel[:, m] = (_chosen(r, codes[:, m]) * u[:, m]).sum(-1)
        total = parallel.sum(axis=1)
        for _ in range(passes):
            for m in range(pieces):
                r = x[:, m, None, :] - self.centres[m]
                along = (r * u[:, m, None, :]).sum(-1)
                loss = np.square(r).sum(-1) + (self.eta - 1) * np.square((total - parallel[:, m])[:, None] + along)
                codes[:, m] = np.argmin(loss, axis=1)
                new = along[np.arange(len(x)), codes[:, m]]
                total += new - parallel[:, m]
                parallel[:, m] = new
        return codes

    def _update(self, vectors: np.ndarray, codes: np.ndarray) -> None:
        """Each centre becomes the least anisotropic loss of its pieces, others held."""
        pieces = len(self.centres)
        x, u = _pieces(vectors, pieces), _pieces(_directions(vectors), pieces)
        parallel = np.stack([((x[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(-1) for m in range(pieces)], axis=1)
        total = parallel.sum(axis=1)
        for m in range(pieces):
            rest = total - parallel[:, m]
            pull = rest + (x[:, m] * u[:, m]).sum(-1)
            for k in range(CENTRES):
                at = codes[:, m] == k
                if at.any():
                    um = u[at, m]
                    a = at.sum() * np.eye(PIECE) + (self.eta - 1) * um.T @ um
                    b = x[at, m].sum(axis=0) + (self.eta - 1) * (um * pull[at, None]).sum(axis=0)
                    self.centres[m, k] = np.linalg.solve(a, b)
            new = ((x[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(-1)
            total += new - parallel[:, m]
            parallel[:, m] = new

    def decode(self, codes: np.ndarray, d: int) -> np.ndarray:
        return np.concatenate([self.centres[m][codes[:, m]] for m in range(len(self.centres))], axis=1)[:, :d]

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """8-bit product tables (query, piece, centre), each query's step, and the product that zeros stand for."""
        q = _pieces(queries, len(self.centres))
        exact = np.einsum("qmi,mki->qmk", q, self.centres)
        low = exact.min(axis=2, keepdims=True)
        step = np.maximum((exact.max(axis=2) - low[:, :, 0]).max(axis=1) / 255, 1e-30)
        return np.round((exact - low) / step[:, None, None]).astype(np.uint8), step, low.sum(axis=(1, 2))


def _pieces(vectors: np.ndarray, pieces: int) -> np.ndarray:
    padded = np.zeros((len(vectors), pieces * PIECE))
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), pieces, PIECE)


def _directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _chosen(r: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return r[np.arange(len(r)), codes]


def packed(codes: np.ndarray) -> list[bytes]:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return [row.tobytes() for row in codes[:, ::2] | codes[:, 1::2] << 4]


def unpacked(rows: pd.Series, pieces: int) -> np.ndarray:
    """One row of codes for each piece."""
    both = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).T
    codes = np.empty((2 * len(both), len(rows)), np.uint8)
    codes[::2], codes[1::2] = both & 15, both >> 4
    return codes[:pieces]


class Part:
    """The vectors of one part of a leaf: their codes by piece, estimates' terms, originals and least ids."""

    def __init__(self, book: Codebook, rows: pd.DataFrame, centre: np.ndarray, spread: float) -> None:
        self.book, self.centre, self.spread = book, centre, spread
        self.columns = unpacked(rows["code"], len(book.centres))
        self.half, self.miss, self.first = (rows[c].to_numpy() for c in ("half", "miss", "first"))
        self.vectors = np.stack(rows["embedding"].to_numpy())

    def scan(self, queries: np.ndarray, limits: np.ndarray, k: int, shortlist: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and distances of its ``k`` nearest here, of those not beyond its limit."""
        n = len(self.half)
        spaced = np.arange(0, n, max(1, n // SPACED))
        found = []
        for begin in range(0, len(queries), SCAN):
            some = queries[begin : begin + SCAN]
            moved = (some - self.centre) / self.spread
            tables, step, base = self.book.tables(moved)
            scores = np.zeros((len(some), n), np.uint16 if len(self.columns) <= 256 else np.uint32)
            for m, column in enumerate(self.columns):
                scores += tables[:, m].take(column, axis=1)
            own = np.square(moved).sum(axis=1)
            measured, errs = [], 0.0
            for i, q in enumerate(some):
                guess, most = self._estimate(scores[i], step[i], base[i], own[i])
                short = np.argpartition(guess, shortlist - 1)[:shortlist] if shortlist < n else np.arange(n)
                short = np.union1d(short, spaced)
                exact = self._distance(short, q)
                errs = np.fmax(errs, np.nanmax(np.abs(guess[short] - np.square(exact / self.spread)) / most[short]))
                measured.append((short, exact))
            share = min(1.0, MARGIN * errs + 0.01)
            for i, (q, (at, exact)) in enumerate(zip(some, measured, strict=True)):
                guess, most = self._estimate(scores[i], step[i], base[i], own[i])
                reach = min(limits[begin + i], np.partition(exact, k - 1)[k - 1] if k <= len(exact) else np.inf)
                rest = ~(guess - share * most > np.square(reach / self.spread))  # what can't be compared stays in
                rest[at] = False
                more = np.flatnonzero(rest)
                at, exact = np.concatenate([at, more]), np.concatenate([exact, self._distance(more, q)])
                best = np.lexsort((self.first[at], exact))[:k]
                best = best[exact[best] <= limits[begin + i]]
                found.append((at[best], exact[best]))
        return found

    def _estimate(self, scores: np.ndarray, step: float, base: float, own: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances as the codes give them, and the most by which each can err: by its residual and the tables' steps."""
        coarse = len(self.columns) * step + 1e-9 * (own + 2 * self.half)
        guess = own + 2 * (self.half - (scores * step + base))
        return guess, 2 * self.miss * np.sqrt(np.maximum(guess - np.square(self.miss) + coarse, 0)) + coarse + 1e-300

    def _distance(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.vectors[at].astype(np.float64) - query).sum(axis=1))


class Leaves:
    """Centres of the coarse partition, the spread of each leaf and the number of leaves a query scans first."""

    def __init__(self, centres: np.ndarray, probes: int) -> None:
        self.centres, self.probes = centres, probes
        self.spreads = np.ones(len(centres))

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, rounds: int = 6, seed: int = 11) -> Leaves:
        k = min(LEAVES, max(1, -(-n // LEAF)), len(sample))
        rng = np.random.default_rng(seed)
        centres = sample[rng.choice(len(sample), k, replace=False)].copy()
        found = cls(centres, 1)
        for _ in range(rounds if k > 1 else 0):
            at = found.nearest(sample, 1)[:, 0]
            counts = np.bincount(at, minlength=k)
            sums = np.stack([np.bincount(at, sample[:, j], k) for j in range(sample.shape[1])], axis=1)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        if k > 1:
            found.probes = found._probes(sample)
        home = found.nearest(sample, 1)[:, 0]
        spread = np.sqrt(np.bincount(home, np.square(sample - centres[home]).sum(axis=1), k) / np.maximum(np.bincount(home, minlength=k), 1))
        found.spreads = np.where(spread > 0, spread, 1.0)
        return found

    def offsets(self, vectors: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Each vector seen from its leaf's centre, in units of the leaf's spread."""
        return (vectors - self.centres[leaf]) / self.spreads[leaf, None]

    def nearest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The nearest leaves of each vector, nearest first."""
        return np.argsort(self._far(vectors), axis=1, kind="stable")[:, :probes]

    def _far(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, less the vector's own norm; seen from the middle, for small rounding."""
        middle = self.centres.mean(axis=0)
        centres = self.centres - middle
        return np.square(centres).sum(axis=1) - 2 * (vectors - middle) @ centres.T

    def others(self, vectors: np.ndarray, limits: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """The leaves after the ``probes`` nearest that may hold a vector within each query's limit.

        A leaf holds nothing nearer than its border with the query's nearest
        leaf, nor than its centre less its radius; ``radii`` is -1 without vectors.
        """
        middle = self.centres.mean(axis=0)
        size = np.linalg.norm(self.centres - middle, axis=1).max()
        found = []
        for q, limit, far, order in zip(vectors, limits, self._far(vectors), self.nearest(vectors, len(self.centres)), strict=True):
            first, rest = order[0], order[self.probes :]
            apart = np.linalg.norm(self.centres[rest] - self.centres[first], axis=1)
            slack = 1e-11 * (np.linalg.norm(q - middle) + size + limit) ** 2
            border = (far[rest] - far[first] - slack) / np.maximum(2 * apart, 1e-300)
            within = np.linalg.norm(self.centres[rest] - q, axis=1) - radii[rest]
            beyond = (border > limit) | (within * (1 + 1e-9) > limit * (1 + 2e-9) + 1e-9 * radii[rest])
            found.append(rest[(radii[rest] >= 0) & ~beyond])
        return found

    def _probes(self, sample: np.ndarray) -> int:
        """The fewest leaves that hold REACH of the ten nearest of some sample vectors."""
        some = sample[:PROBE_QUERIES]
        home = self.nearest(sample, 1)[:, 0]
        place = np.argsort(self.nearest(some, len(self.centres)), axis=1)  # of each leaf in a query's order
        need = []
        for i, q in enumerate(some):
            d = np.square(sample - q).sum(axis=1)
            d[i] = np.inf
            need += place[i, home[np.argsort(d, kind="stable")[:K]]].tolist()
        return int(np.sort(need)[int(np.ceil(REACH * len(need))) - 1]) + 1


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part.

    Those without an id, a vector, or with null, NaN or infinite numbers or
    only zeros take none.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(ok & some, F.lit(False)))


def _stacked(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def nearest(rows: DataFrame, every: int = 100, k: int = K, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``k`` nearest other vectors of each vector whose vec_id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``; score is the Euclidean distance
    in double precision, ties go to the smaller vec_id. With fewer other
    vectors, all are returned; a table without valid vectors gives no rows. A
    repeated vec_id of the same vector is one candidate; of different vectors,
    each is one. Vectors of another length are no candidates.
    """
    valid = valid_vectors(rows).distinct()
    lengths = sorted(r["d"] for r in valid.select(F.size("embedding").alias("d")).distinct().collect())
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        found = found.unionByName(_nearest(valid.where(F.size("embedding") == d), every, k, shortlist))
    return found


def _nearest(valid: DataFrame, every: int, k: int, shortlist: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = valid.sparkSession
    order = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = valid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    grouped = firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    grouped = keep(grouped.withColumn("rep", F.monotonically_increasing_id()), "ann-vectors")  # a key of the vector, written once
    sample = grouped.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(TRAIN).select("embedding").toPandas()
    train = _stacked(sample["embedding"])
    leaves = Leaves.fit(train, grouped.count())
    book = Codebook.fit(leaves.offsets(train, leaves.nearest(train, 1)[:, 0]))
    shared = spark.sparkContext.broadcast((book, leaves))
    number = dict(valid.dtypes)["embedding"]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, leaves = shared.value
        for batch in batches:
            if len(batch):
                x = _stacked(batch["embedding"])
                leaf = leaves.nearest(x, 1)[:, 0]
                offsets = leaves.offsets(x, leaf)
                codes = book.encode(offsets)
                made = book.decode(codes, x.shape[1])
                left = np.square(offsets - made).sum(axis=1)
                yield pd.DataFrame({
                    "rep": batch["rep"], "embedding": batch["embedding"], "ids": batch["ids"], "code": packed(codes),
                    "half": (np.square(made).sum(axis=1) + left) / 2, "miss": np.sqrt(left), "leaf": leaf,
                    "radius": np.linalg.norm(x - leaves.centres[leaf], axis=1),
                })

    columns = f"rep long, embedding {number}, ids array<long>, code binary, half double, miss double, leaf int, radius double"
    index = keep(grouped.mapInPandas(coded, columns), "ann-index")
    queries = keep(
        valid.where(F.col("vec_id") % every == 0).join(index.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"),
        "ann-queries",
    )
    asked = keep(index.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("embedding").alias("asked")), "ann-asked")

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = shared.value[1]
        for batch in batches:
            if len(batch):
                yield batch.assign(limit=np.inf, leaves=list(leaves.nearest(_stacked(batch["asked"]), leaves.probes)))

    radii = np.full(len(leaves.centres), -1.0)
    for r in index.groupBy("leaf").agg(F.max("radius").alias("radius")).collect():  # one row a leaf
        radii[r["leaf"]] = r["radius"]

    def widened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = shared.value[1]
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=leaves.others(_stacked(batch["asked"]), batch["limit"].to_numpy(), radii))

    def wanted(some: DataFrame, choose: Callable, name: str) -> DataFrame:
        made = some.mapInPandas(choose, f"rep long, asked {number}, limit double, leaves array<int>")
        return keep(made.select("rep", "asked", "limit", F.explode("leaves").alias("leaf")), name)

    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "first"))
    near = _scanned(index, wanted(asked, probed, "ann-wanted"), shared, k + 1, shortlist)
    if leaves.probes < len(leaves.centres):
        near = keep(near.withColumn("n", place).where(F.col("n") <= k + 1).drop("n"), "ann-near")
        known = near.groupBy("query").agg(F.when(F.count("*") > k, F.max("score")).alias("limit"))
        limited = asked.join(known, F.col("query") == F.col("rep"), "left").select("rep", "asked", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        near = near.unionByName(_scanned(index, wanted(limited, widened, "ann-widened"), shared, k + 1, shortlist))
    short = near.withColumn("n", place).where(F.col("n") <= k + 1).select("query", "rep", "score")
    top = short.join(index.select("rep", F.explode("ids").alias("vec_id")), "rep").select("query", "score", "vec_id")
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    own = top.join(queries, F.col("query") == F.col("rep")).where("vec_id <> query_id")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return own.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(index: DataFrame, wanted: DataFrame, shared: Broadcast, k: int, shortlist: int) -> DataFrame:
    """``query, rep, first, score``: the ``k`` nearest of each query in each part of the leaves it wants."""
    # Parts of leaves and blocks of queries, by their counts: one row a leaf.
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = wanted.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    dealt = F.broadcast(sizes.join(blocks, "leaf"))
    left = index.join(dealt, "leaf").select(
        "rep", F.col("ids")[0].alias("first"), "embedding", "code", "half", "miss", "leaf", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    right = wanted.join(dealt, "leaf").select(
        F.col("rep").alias("query"), "asked", "limit", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"),
    )

    def meet(key: tuple, vectors: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or some.empty:
            return pd.DataFrame({"query": [], "rep": [], "first": [], "score": []})
        book, leaves = shared.value
        part = Part(book, vectors, leaves.centres[key[0]], leaves.spreads[key[0]])
        found = part.scan(_stacked(some["asked"]), some["limit"].to_numpy(), k, shortlist)
        at = np.concatenate([positions for positions, _ in found])
        return pd.DataFrame({
            "query": np.repeat(some["query"].to_numpy(), [len(positions) for positions, _ in found]), "rep": vectors["rep"].to_numpy()[at],
            "first": part.first[at], "score": np.concatenate([distances for _, distances in found]),
        })

    keys = ["leaf", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query long, rep long, first long, score double")
