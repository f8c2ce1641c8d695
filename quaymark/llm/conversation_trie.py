"""Prefix trie of conversations: succinct level-order tries by shard, heavy upper levels merged apart.

Conversations are rebuilt as rows of turns, each with two 64-bit hashes of its
prefix (the exclusive or of the hashes of depth, role and text of all turns so far),
so a node is a pair of hashes and no prefix is copied.

A node with more than ``HEAVY`` members is heavy; so are all above it. A
conversation leaves the heavy part at its first node that isn't; what hangs on
that node is a light subtree of at most ``HEAVY`` members. Light subtrees are dealt to shards by
hash, about ``SHARD_TURNS`` turns each. A shard is one trie in level order
(``Trie``): numpy sorts its nodes by level and parent, writes the LOUDS
bitvector (a one for each child, then a zero) and the arrays of labels, and
sums from the last level to the first with ``add.at``.

The heavy part is merged in Spark: light subtrees are summed by the heavy node above
them, and each heavy node's sums go to all nodes above it. Digests
of conversations that end at heavy nodes read their ids in order from a range
partitioning, so a node where a third of all conversations end is
joined into texts of ``CHUNK`` ids in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Members of a node from which it is merged apart, and turns of a shard.
HEAVY = 1000
SHARD_TURNS = 50_000
CHUNK = 1000
#: Conversations of so many ids share the first turns of the one that begins them.
FAMILY = 20
SHARED = 4
EMPTY = hashlib.sha256(b"").hexdigest()


class Trie:
    """A forest in level order as a LOUDS bitvector: a one for each child, then a zero, for the shard's root and then each node.

    ``above`` has the node above each node (-1: the shard's root), ``level`` its distance from the
    shard's root; ``order`` lists the nodes as the trie has them.
    """

    def __init__(self, above: np.ndarray, level: np.ndarray) -> None:
        n = len(above)
        self.order = np.argsort(level, kind="stable")
        self.starts = np.searchsorted(level[self.order], np.arange(1, int(level.max(initial=0)) + 2))
        place = np.full(n + 1, -1)  # the last stands for the shard's root
        for low, high in zip(self.starts[:-1], self.starts[1:], strict=True):
            nodes = self.order[low:high]
            nodes = nodes[np.argsort(place[above[nodes]], kind="stable")]
            self.order[low:high] = nodes
            place[nodes] = np.arange(low, high)
        many = np.bincount(place[above[self.order]] + 1, minlength=n + 1)
        self.louds = np.ones(2 * n + 1, bool)
        self.louds[np.cumsum(many + 1) - 1] = False

    def children(self) -> np.ndarray:
        """Number of children of each node: the ones between its zero and the zero before."""
        return np.diff(np.flatnonzero(~self.louds)) - 1

    def parents(self) -> np.ndarray:
        """Place of the node above each node: the zeros before its one, less the root's."""
        ones = np.flatnonzero(self.louds)
        return ones - np.arange(len(ones)) - 1

    def rollup(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, level by level from the last."""
        total, parents = own.copy(), self.parents()
        for low, high in zip(self.starts[-2:0:-1], self.starts[:1:-1], strict=True):
            np.add.at(total, parents[low:high], total[low:high])
        return total


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, words, one, two, last``: turns of the rebuilt conversations with their prefix hashes.

    ``last`` marks a conversation's last turn. A conversation without turns has no row.
    """
    empty = F.lit("")
    text = F.coalesce("text", empty)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), text.alias("text"), words.cast("long").alias("words")
    )
    inside = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    label = F.xxhash64(F.lit("turn"), "role", "text"), F.xxhash64(F.lit("label"), "text", "role")
    placed = turns.select("conv_id", F.row_number().over(inside).alias("at"), label[0].alias("l1"), label[1].alias("l2"), "words")
    begins = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family")
    shared = placed.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("at") < SHARED)).groupBy(F.col("conv_id").alias("family"))
    first = shared.agg(F.array_sort(F.collect_list(F.struct("at", "l1", "l2", "words"))).alias("given"))
    ids = turns.select("conv_id").distinct().select("conv_id", begins, h.alias("h")).join(first, "family", "left")
    given = F.slice(F.coalesce("given", F.array().cast("array<struct<at:int,l1:bigint,l2:bigint,words:bigint>>")), F.lit(1), F.col("h"))
    held = ids.select("conv_id", "h", given.alias("given"))
    from_first = held.select("conv_id", F.explode("given").alias("g")).select("conv_id", F.col("g.at").alias("depth"), "g.l1", "g.l2", "g.words")
    own = placed.join(held.select("conv_id", "h", F.size("given").alias("had")), "conv_id").where("at > h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("had")).alias("depth"), "l1", "l2", "words")
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    one, two = (F.bit_xor(F.xxhash64(F.lit(salt), "depth", "l1", "l2")).over(so_far) for salt in ("one", "two"))
    return from_first.unionByName(own).select("conv_id", "depth", "words", one.alias("one"), two.alias("two"), (F.col("depth") == F.max("depth").over(whole)).alias("last"))


LIGHT = (
    "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, top boolean, p1 long, p2 long"
)


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shard_rows(turns: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard: ``turns`` are those of its conversations below the heavy part."""
    turns = turns.sort_values(["one", "two", "conv_id"], ignore_index=True)
    one, two, convs = (turns[c].to_numpy() for c in ("one", "two", "conv_id"))
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    at = np.flatnonzero(new)
    n = len(at)
    named = {key: i for i, key in enumerate(zip(one[at].tolist(), two[at].tolist(), strict=True))}
    head = turns.iloc[at]
    level = (head["depth"] - head["heavy"]).to_numpy()
    above = np.array([named[k] if far > 1 else -1 for k, far in zip(zip(head["p1"].tolist(), head["p2"].tolist(), strict=True), level, strict=True)])
    members = np.diff(np.append(at, len(turns)))
    trie = Trie(above, level)
    children, parents = trie.children(), trie.parents()
    label = head.iloc[trie.order]
    members, least = members[trie.order], label["conv_id"].to_numpy()
    ends = np.full(n, EMPTY, object)
    last = np.flatnonzero(turns["last"].to_numpy())
    node = (np.cumsum(new) - 1)[last]
    cuts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else [], len(node)).astype(int)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        ends[node[low]] = digest(convs[last[low:high]])
    top = parents < 0
    return pd.DataFrame(
        {
            "conv_id": least, "depth": label["depth"].to_numpy(),
            "parent_conv_id": np.where(top, label["heavy_conv"].to_numpy(), least[np.maximum(parents, 0)]),
            "n_convs": members, "n_children": children, "n_leaves": trie.rollup((children == 0).astype(np.int64)),
            "saved_tokens": trie.rollup((members - 1) * label["words"].to_numpy()), "ends_sha256": ends[trie.order],
            "top": top, "p1": label["p1"].to_numpy(), "p2": label["p2"].to_numpy(),
        }
    )


def _join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of at most ``CHUNK`` ids of a node, in their order."""
    for rows in batches:
        keys = rows[["one", "two"]].to_numpy()
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        run = np.arange(len(rows)) - at[np.cumsum(new) - 1] if len(rows) else at
        at = np.flatnonzero(run % CHUNK == 0)
        ids = rows["conv_id"].to_numpy()
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, np.append(at[1:], len(rows)), strict=True)]
        yield pd.DataFrame({"one": keys[at, 0], "two": keys[at, 1], "begin": ids[at], "ids": texts})


def _digest_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest of all texts of each node; a partition has all of them, in order."""
    held, sha = None, None
    for rows in batches:
        done = []
        for one, two, ids in zip(rows["one"].tolist(), rows["two"].tolist(), rows["ids"], strict=True):
            if (one, two) != held:
                if held is not None:
                    done.append((*held, sha.hexdigest()))
                held, sha = (one, two), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pd.DataFrame(done, columns=["one", "two", "ends_sha256"]).astype({"one": "int64", "two": "int64"})
    if held is not None:
        yield pd.DataFrame([(*held, sha.hexdigest())], columns=["one", "two", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """``one, two, ends_sha256`` of rows ``one, two, conv_id``, whatever the number of a node's ids."""
    sorted_ids = ends.repartitionByRange("one", "two", "conv_id").sortWithinPartitions("one", "two", "conv_id")
    chunks = sorted_ids.mapInPandas(_join_ids, "one long, two long, begin long, ids string")
    dealt = chunks.repartition("one", "two").sortWithinPartitions("one", "two", "begin")
    return dealt.mapInPandas(_digest_chunks, "one long, two long, ends_sha256 string")


def _heavy_sums(nodes: DataFrame) -> DataFrame:
    """``one, two, n_leaves, saved_tokens`` summed over the subtrees of ``nodes`` (``one, two, p1, p2`` and the own sums).

    Each round doubles the height of what is summed: a node takes the sums of those that
    are 2 ^ round below it, so there are as many rounds as the depth has binary digits.
    """
    now = nodes.select("one", "two", F.col("p1").alias("u1"), F.col("p2").alias("u2"), "n_leaves", "saved_tokens")
    while True:
        below = now.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("one"), F.col("u2").alias("two"))
        below = below.agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("save"))
        up = now.select(F.col("one").alias("u1"), F.col("two").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        now = keep(
            now.join(below, ["one", "two"], "left").join(up, ["u1", "u2"], "left").select(
                "one", "two", F.col("v1").alias("u1"), F.col("v2").alias("u2"),
                (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("save", F.lit(0))).alias("saved_tokens"),
            ),
            "heavy",
        )
        if now.where("u1 IS NOT NULL").isEmpty():
            return now.drop("u1", "u2")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_nodes(conversations: DataFrame, heavy_members: int = HEAVY, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` (long but for the last) from ``conv_id, turn, role,
    text``. Turns of one number follow role, then text; rows that are there twice are two
    turns; null role and text are empty, a null turn comes first, rows without a
    conv_id take no part. A conversation without turns is a member of the root
    alone. An empty table gives an empty one. A conversation's own turns are taken to fit
    one task; the members of a node are not.
    """
    spark = conversations.sparkSession
    turns = keep(rebuilt_turns(conversations), "turns")
    ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    total, least = ids.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return spark.createDataFrame([], LIGHT).select(*COLUMNS).withColumn("depth", F.col("depth").cast("long"))
    in_turn = Window.partitionBy("conv_id").orderBy("depth")
    whole = Window.partitionBy("conv_id")
    up = {"p1": F.lag("one", 1, 0).over(in_turn), "p2": F.lag("two", 1, 0).over(in_turn)}
    stepped = turns.withColumns(up)
    counted = stepped.groupBy("one", "two", "depth", "p1", "p2", "words").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"))
    heavy = keep(counted.where(F.col("n_convs") > heavy_members), "heavy-nodes")
    known = stepped.join(heavy.select("one", "two", F.col("least").alias("heavy_least")), ["one", "two"], "left")
    cut = F.coalesce(F.max(F.when(F.col("heavy_least").isNotNull(), F.col("depth"))).over(whole), F.lit(0))
    rows = keep(known.withColumn("heavy", cut), "cut")
    first = F.col("depth") == F.col("heavy") + 1
    light = rows.withColumns(
        {
            "heavy_conv": F.coalesce(F.max(F.when(F.col("depth") == F.col("heavy"), F.col("heavy_least"))).over(whole), F.lit(least)),
            "r1": F.max(F.when(first, F.col("one"))).over(whole),
            "r2": F.max(F.when(first, F.col("two"))).over(whole),
        }
    ).where("depth > heavy")
    shards = max(1, rows.where("depth > heavy").count() // shard_turns)
    dealt = light.withColumn("shard", F.pmod(F.xxhash64("r1", "r2"), F.lit(shards)))
    fields = ["conv_id", "depth", "words", "one", "two", "last", "p1", "p2", "heavy", "heavy_conv"]
    below = keep(dealt.select("shard", *fields).groupBy("shard").applyInPandas(shard_rows, LIGHT), "light")
    # The heavy part: the root is 0, 0.
    tops = below.where("top").groupBy(F.col("p1").alias("one"), F.col("p2").alias("two")).agg(
        F.count("*").alias("light_kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    kids = heavy.groupBy(F.col("p1").alias("one"), F.col("p2").alias("two")).agg(F.count("*").alias("kids"))
    none = F.lit(None).cast("long")
    root = spark.range(1).select(
        F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).alias("depth"), none.alias("p1"), none.alias("p2"),
        F.lit(0).cast("long").alias("words"), F.lit(total).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("least"),
    )
    upper = heavy.unionByName(root).join(tops, ["one", "two"], "left").join(kids, ["one", "two"], "left").fillna(0, ["light_kids", "kids", "leaves", "saved"])
    upper = keep(
        upper.withColumn("n_children", F.col("light_kids") + F.col("kids")).select(
            "one", "two", "depth", "p1", "p2", "n_convs", "least", "n_children",
            (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "upper",
    )
    turnless = ids.join(turns.where("last").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), "conv_id")
    ends = ends_of(rows.where("last AND depth = heavy").select("one", "two", "conv_id").unionByName(turnless))
    above = upper.select(F.col("one").alias("p1"), F.col("two").alias("p2"), F.col("least").alias("parent_conv_id"))
    merged = (
        upper.drop("n_leaves", "saved_tokens").join(_heavy_sums(upper), ["one", "two"]).join(above, ["p1", "p2"], "left").join(ends, ["one", "two"], "left")
        .withColumns({"conv_id": F.col("least"), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))})
    )
    return below.select(*COLUMNS).unionByName(merged.select(*COLUMNS)).withColumn("depth", F.col("depth").cast("long"))
