"""Correlation, clusters and selection of instruments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.functions.lineage import cut_lineage


def returns(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("r", F.col("close") / F.lag("close").over(w.by_code()) - 1)
    return rows.where(F.col("r").isNotNull()).select("code", "d", "r")


def pair_correlation(rets: DataFrame, least: int = 120, fallback: float = 0.05) -> DataFrame:
    """``code_a, code_b, n_overlap, corr`` of all pairs of codes, joined day by day.

    Fewer than ``least`` common days, or none of them varied, give the fallback.
    """
    a = rets.select("d", F.col("code").alias("code_a"), F.col("r").alias("ra"))
    b = rets.select("d", F.col("code").alias("code_b"), F.col("r").alias("rb"))
    both = a.join(b, "d").where("code_a < code_b").groupBy("code_a", "code_b").agg(
        F.count("*").alias("n_overlap"), F.corr("ra", "rb").alias("c")
    )
    value = F.when((F.col("n_overlap") >= least) & F.col("c").isNotNull() & ~F.isnan("c"), F.greatest(F.least(F.col("c"), F.lit(1.0)), F.lit(-1.0)))
    return both.select("code_a", "code_b", "n_overlap", F.coalesce(value, F.lit(fallback)).alias("corr"))


def _merged(dist: DataFrame, ends: DataFrame, other: DataFrame) -> DataFrame:
    """Distances (a, b, d) after the clusters on the left have merged by the Lance-Williams rule of Ward.

    ends: a, root, n, h of each cluster, h the height of its merge or NULL; other: b, nb, the sizes on the right.
    """
    met = dist.join(ends, "a").join(other, "b")
    sums = met.groupBy("root", "b").agg(
        F.max("h").alias("h"), F.sum((F.col("n") + F.col("nb")) * F.col("d") * F.col("d")).alias("s"), F.sum("n").alias("n"), F.max("nb").alias("nb"), F.max("d").alias("d")
    )
    square = (F.col("s") - F.col("nb") * F.col("h") * F.col("h")) / (F.col("n") + F.col("nb"))
    return sums.select(F.col("root").alias("a"), "b", F.when(F.col("h").isNull(), F.col("d")).otherwise(F.sqrt(F.greatest(square, F.lit(0.0)))).alias("d"))


def _ward(pairs: DataFrame, height: float) -> tuple[DataFrame, list[DataFrame]]:
    """``code, c`` with the least code of each cluster at ``height``; and for each round the pairs of codes it joined, with the height of the merge.

    In each round all pairs of clusters that are nearest to each other merge, as far as the height allows:
    Ward's distance to other clusters never falls by a merge, so this gives the
    clusters of one merge at a time. The distances stay a table of pairs, and a round is joins and aggregations of it. Pairs
    without a correlation count as 0.
    """
    both = pairs.select(F.col("code_a").alias("a"), F.col("code_b").alias("b"), (1 - F.col("corr")).alias("d"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    codes = both.select(F.col("a").alias("code")).distinct()
    grid = codes.select(F.col("code").alias("a")).join(codes.select(F.col("code").alias("b")), F.col("a") != F.col("b"))
    dist = cut_lineage(grid.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("d", F.lit(1.0)).alias("d")))
    members = cut_lineage(codes.select("code", F.col("code").alias("c")))
    joined = []
    while True:
        # Rounded, so that (a, b) and (b, a), summed apart, order alike.
        near = dist.groupBy("a").agg(F.min(F.struct(F.round("d", 12).alias("r"), "b", "d")).alias("m")).select("a", "m.b", "m.d")
        back = near.select(F.col("a").alias("b"), F.col("b").alias("a2"))
        merges = near.join(back, "b").where((F.col("a") == F.col("a2")) & (F.col("a") < F.col("b")) & (F.col("d") <= height))
        merges = cut_lineage(merges.select(F.col("a").alias("root"), F.col("b").alias("gone"), F.col("d").alias("h")))
        if merges.isEmpty():
            break
        ends = merges.select(F.col("root").alias("a"), "root", "h").unionByName(merges.select(F.col("gone").alias("a"), "root", "h"))
        sizes = members.groupBy(F.col("c").alias("a")).agg(F.count("*").cast("double").alias("n"))
        now = sizes.join(ends, "a", "left").select("a", F.coalesce("root", "a").alias("root"), "n", "h")
        grown = now.groupBy("root").agg(F.sum("n").alias("nb"))
        roots = now.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        outer = dist.join(now.select("a", F.col("root").alias("ra")), "a").join(roots, "b").where("ra <> rb").select("a", "b", "d")
        left = _merged(outer, now, now.select(F.col("a").alias("b"), F.col("n").alias("nb")))
        turned = left.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
        dist = cut_lineage(_merged(turned, now, grown.select(F.col("root").alias("b"), "nb")))
        held, gone = (members.select(F.col("c").alias(c), F.col("code").alias(f"code_{x}")) for c, x in (("root", "x"), ("gone", "y")))
        joined.append(merges.join(held, "root").join(gone, "gone").select("code_x", "code_y", "h"))
        members = cut_lineage(members.join(now.select(F.col("a").alias("c"), "root"), "c").select("code", F.col("root").alias("c")))
    return members, joined


def ward_clusters(pairs: DataFrame, height: float = 0.8) -> DataFrame:
    """``code, cluster`` by Ward linkage on 1 - corr, cut at ``height``; clusters count from 1 by their least code."""
    members, _ = _ward(pairs, height)
    number = members.select("c").distinct().select("c", F.row_number().over(Window.orderBy("c")).alias("cluster"))  # one row a cluster
    return members.join(number, "c").select("code", "cluster")


def merge_heights(pairs: DataFrame) -> DataFrame:
    """``code_a, code_b, height`` of all pairs: the height at which Ward linkage on 1 - corr brings them together (their cophenetic distance)."""
    _, joined = _ward(pairs, float("inf"))
    low, high = F.least("code_x", "code_y").alias("code_a"), F.greatest("code_x", "code_y").alias("code_b")
    rounds = [x.select(low, high, F.col("h").alias("height")) for x in joined]
    if not rounds:
        return pairs.select("code_a", "code_b", F.lit(None).cast("double").alias("height")).limit(0)
    return reduce(DataFrame.unionByName, rounds)


def related_clusters(heights: DataFrame, members: DataFrame, picked: DataFrame, top: int = 3) -> DataFrame:
    """``cluster, place, related, height, codes``: for each cluster without a picked code, the ``top`` clusters with one that are nearest to it.

    The height between clusters is the least between their codes; ties go to the better return of a
    picked code, then the lesser cluster. ``members``: code, cluster; ``picked``: code, ret.
    """
    chosen = members.join(picked, "code").groupBy(F.col("cluster").alias("related")).agg(F.array_sort(F.collect_list("code")).alias("codes"), F.max("ret").alias("ret"))
    missed = members.join(chosen.select(F.col("related").alias("cluster")), "cluster", "left_anti")
    both = heights.unionByName(heights.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "height"))
    from_, to = missed.select(F.col("code").alias("code_a"), "cluster"), members.select(F.col("code").alias("code_b"), F.col("cluster").alias("related"))
    near = both.join(from_, "code_a").join(to, "code_b").groupBy("cluster", "related").agg(F.min("height").alias("height")).join(chosen, "related")
    order = Window.partitionBy("cluster").orderBy(F.round("height", 9), F.desc_nulls_last("ret"), "related")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("cluster", "place", "related", "height", "codes")


def return_score(bars: DataFrame, days: int = 252) -> DataFrame:
    """Per code: Sharpe ratio, 12-1 momentum and their mean percentile rank, equal values at their mean rank."""
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    rows = bars.withColumn("r", F.col("close") / F.lag("close").over(w.by_code()) - 1).withColumn("back", back).where(F.col("back") <= days)
    facts = rows.groupBy("code").agg(
        (F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        (F.max(F.when(F.col("back") == 22, F.col("close"))) / F.max(F.when(F.col("back") == days, F.col("close"))) - 1).alias("momentum"),
    )
    ranked = facts.withColumn("pool", F.lit(1))  # one row a code
    score = 0.5 * w.average_rank(["pool"], "sharpe") + 0.5 * w.average_rank(["pool"], "momentum")
    return ranked.withColumn("score", score).drop("pool")


def domain(name: Column) -> Column:
    """A broad domain from an instrument's name."""
    text = F.lower(name)
    return (
        F.when(text.rlike("bond|treasury|credit"), "bond").when(text.rlike("gold|oil|commodit"), "commodity")
        .when(text.rlike("cash|money"), "cash").otherwise("equity")
    )


def medoids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``cluster, medoid, mean_corr``: the member of the largest mean correlation, ties to the lesser code."""
    both = pairs.select("code_a", "code_b", "corr").unionByName(
        pairs.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "corr")
    )
    a = members.select(F.col("code").alias("code_a"), F.col("cluster").alias("ca"))
    b = members.select(F.col("code").alias("code_b"), F.col("cluster").alias("cb"))
    means = both.join(a, "code_a").join(b, "code_b").where("ca = cb").groupBy("ca", "code_a").agg(F.round(F.avg("corr"), 9).alias("m"))
    alone = members.join(means, members["code"] == means["code_a"], "left_anti").select(F.col("cluster").alias("ca"), F.col("code").alias("code_a"), F.lit(1.0).alias("m"))
    n = F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("m"), "code_a"))
    return means.select("ca", "code_a", "m").unionByName(alone).withColumn("n", n).where("n = 1").select(
        F.col("ca").alias("cluster"), F.col("code_a").alias("medoid"), F.col("m").alias("mean_corr")
    )


def trim_clones(pairs: DataFrame, scores: DataFrame, limit: float = 0.70) -> DataFrame:
    """``code, rank`` of the codes kept when each near clone of a better-scored kept code is dropped, best first.

    In each round the codes without a better one among their remaining clones stay, and their clones go, which is what
    one code after another would give.
    """
    order = Window.orderBy(F.desc("score"), "code")  # one row a code
    ranked = cut_lineage(scores.select("code", F.row_number().over(order).alias("rank")))
    a, b = (ranked.select(F.col("code").alias(f"code_{x}"), F.col("rank").alias(f"rank_{x}")) for x in "ab")
    near = pairs.where(F.col("corr") > limit).select("code_a", "code_b").join(a, "code_a").join(b, "code_b")
    ahead = F.col("rank_a") < F.col("rank_b")
    edges = cut_lineage(near.select(F.when(ahead, F.col("code_a")).otherwise(F.col("code_b")).alias("better"), F.when(ahead, F.col("code_b")).otherwise(F.col("code_a")).alias("code")).distinct())
    live, kept = ranked, ranked.limit(0)
    while not live.isEmpty():
        blocked = edges.join(live.select(F.col("code").alias("better")), "better", "left_semi").select("code").distinct()
        now = cut_lineage(live.join(blocked, "code", "left_anti"))
        gone = edges.join(now.select(F.col("code").alias("better")), "better", "left_semi").select("code").distinct()
        kept = kept.unionByName(now)
        live = cut_lineage(live.join(now, "code", "left_anti").join(gone, "code", "left_anti"))
    return kept.select("code", F.row_number().over(Window.orderBy("rank")).alias("rank"))


def compare_pools(old: DataFrame, new: DataFrame) -> DataFrame:
    """``code, change``: added, removed or kept."""
    both = old.select("code", F.lit(1).alias("o")).join(new.select("code", F.lit(1).alias("n")), "code", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return both.select("code", change.alias("change"))
