"""Choice of a pool from clusters: quotas, several representatives a cluster, near clones trimmed, uncovered clusters rescued.

Each step that takes one code after another is done in rounds of joins: a round settles all codes whose
turn does not depend on one that is still open, with the result of going one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.lineage import cut_lineage

CROSS, INTRA = 0.70, 0.60


def candidates(members: DataFrame) -> DataFrame:
    """``code, cluster, score, rank`` of the members with enough history, of all where a cluster has none; best score first, then code."""
    some = F.max(F.col("enough").cast("int")).over(Window.partitionBy("cluster")) == 1
    kept = members.withColumn("_some", some).where(F.col("enough") | ~F.col("_some"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "code")
    return kept.select("code", "cluster", "score", F.row_number().over(order).alias("rank"))


def quotas(found: DataFrame, target: int) -> DataFrame:
    """``cluster, n, raw, cap``: seats in proportion to a cluster's candidates, rounded up, one at least.

    A reserve of 15 % (five at least) is then dealt to clusters in the order of the fraction cut off, size, best score and number, each to its fill.
    """
    one = Window.partitionBy(F.lit(1))  # one row a cluster
    size = found.groupBy("cluster").agg(F.count("*").alias("n"), F.max("score").alias("best")).withColumn("all", F.sum("n").over(one))
    size = size.withColumn("raw", F.col("n") / F.col("all") * target)
    size = size.withColumn("base", F.greatest(F.least(F.ceil("raw"), F.col("n")), F.lit(1)))
    reserve = target + F.least(F.greatest(F.lit(5), F.ceil(F.lit(target * 0.15))), F.greatest(F.lit(0), F.col("all") - target))
    order = one.orderBy(F.desc(F.col("raw") - F.floor("raw")), F.desc("n"), F.desc("best"), "cluster")
    before = F.coalesce(F.sum(F.col("n") - F.col("base")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = reserve - F.sum("base").over(one)
    extra = F.greatest(F.lit(0), F.least(F.col("n") - F.col("base"), need - before))
    return size.select("cluster", "n", "raw", (F.col("base") + extra).alias("cap"))


def _clones(pairs: DataFrame, members: DataFrame, cross: float, intra: float) -> DataFrame:
    """``code, other`` of near clones, both ways: correlations beyond ``intra`` within a cluster, ``cross`` between them."""
    both = pairs.select("code_a", "code_b", "corr").unionByName(pairs.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "corr"))
    a, b = (members.select(F.col("code").alias(f"code_{x}"), F.col("cluster").alias(f"cluster_{x}")) for x in "ab")
    limit = F.when(F.col("cluster_a") == F.col("cluster_b"), intra).otherwise(cross)
    return both.join(a, "code_a").join(b, "code_b").where(F.abs("corr") > limit).select(F.col("code_a").alias("code"), F.col("code_b").alias("other"))


def _trimmed(seated: DataFrame, clones: DataFrame) -> DataFrame:
    """The seated codes (code, seat, forced) less those that are near clones of a better-seated kept one; forced ones always stay."""
    a, b = seated.select("code", "seat", "forced"), seated.select(F.col("code").alias("other"), F.col("seat").alias("before"))
    edges = cut_lineage(clones.join(a, "code").join(b, "other").where("before < seat AND NOT forced").select("code", "other"))
    live, kept = cut_lineage(seated.select("code")), seated.select("code").limit(0)
    while not live.isEmpty():
        blocked = edges.join(live.select(F.col("code").alias("other")), "other", "left_semi").select("code").distinct()
        now = cut_lineage(live.join(blocked, "code", "left_anti"))
        gone = edges.join(now.select(F.col("code").alias("other")), "other", "left_semi").select("code").distinct()
        kept, live = kept.unionByName(now), cut_lineage(live.join(now, "code", "left_anti").join(gone, "code", "left_anti"))
    return cut_lineage(kept)


def _rescued(kept: DataFrame, spare: DataFrame, clones: DataFrame) -> DataFrame:
    """``code, cluster``: for each cluster of ``spare`` (code, cluster, rank), in order, its first code that is no near clone of a kept or rescued one.

    A round takes the first free code of each open cluster, and accepts them in order up to the first that is a clone of one before it.
    """
    held, out, open_ = kept, spare.select("code", "cluster").limit(0), cut_lineage(spare)
    while not open_.isEmpty():
        near = clones.join(held.select(F.col("code").alias("other")), "other", "left_semi").select("code").distinct()
        free = cut_lineage(open_.join(near, "code", "left_anti"))
        first = free.groupBy("cluster").agg(F.min(F.struct("rank", "code")).alias("f")).select("cluster", "f.code")
        clash = clones.join(first, "code").join(first.select(F.col("code").alias("other"), F.col("cluster").alias("earlier")), "other").where("earlier < cluster")
        stop = clash.agg(F.min("cluster").alias("stop"))
        now = cut_lineage(first.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("cluster") < F.col("stop"))).select("code", "cluster"))  # stop is one row
        out, held = out.unionByName(now), cut_lineage(held.select("code").unionByName(now.select("code")))
        open_ = cut_lineage(free.join(now.select("cluster"), "cluster", "left_anti"))
    return cut_lineage(out)


def select_pool(members: DataFrame, pairs: DataFrame, target: int, forced: DataFrame, cross: float = CROSS, intra: float = INTRA) -> DataFrame:
    """``code, cluster, seat, how`` of a pool of about ``target`` codes.

    ``members``: code, cluster, score, enough (history); ``pairs``: code_a, code_b, corr; ``forced``: codes that stay. Forced codes come first and
    stand for their clusters. Then each other cluster's best by score, then the further ones within the quotas, up to ``target``; near clones of better ones go, and
    clusters left without a code get their next best that is no near clone (``rescue``).
    """
    found = cut_lineage(candidates(members))
    marked = found.join(forced.select("code", F.lit(True).alias("forced")).distinct(), "code", "left").fillna(False, ["forced"])
    marked = marked.withColumn("taken", F.max(F.col("forced").cast("int")).over(Window.partitionBy("cluster")) == 1)
    ranked = marked.join(quotas(found, target).select("cluster", "raw", "cap"), "cluster").where((~F.col("taken") & (F.col("rank") <= F.col("cap"))))
    others = ranked.select("code", "cluster", "score", "rank", "raw", F.lit(False).alias("forced"))
    ours = members.join(forced.select("code").distinct(), "code", "left_semi").select("code", "cluster", "score", F.lit(0).alias("rank"), F.lit(0.0).alias("raw"), F.lit(True).alias("forced"))
    group: Column = F.when(F.col("forced"), 0).when(F.col("rank") == 1, 1).otherwise(2)
    by_score = F.when(~F.col("forced"), -F.col("score"))
    order = Window.orderBy(group, by_score, F.desc("raw"), "cluster", "rank", "code")  # one row a code
    seated = cut_lineage(ours.unionByName(others).withColumn("seat", F.row_number().over(order)).where((F.col("seat") <= target)))
    clones = cut_lineage(_clones(pairs, members, cross, intra))
    kept = _trimmed(seated, clones)
    stays = seated.join(kept, "code", "left_semi")
    spare = found.join(stays.select("cluster"), "cluster", "left_anti").join(seated.select("code"), "code", "left_anti")
    more = _rescued(kept, spare.select("code", "cluster", "rank"), clones)
    how = F.when(F.col("forced"), "forced").when(F.col("rank") == 1, "best").otherwise("further")
    end = F.row_number().over(Window.orderBy("cluster"))
    return stays.select("code", "cluster", F.col("seat").cast("long").alias("seat"), how.alias("how")).unionByName(more.select("code", "cluster", (end + target).cast("long").alias("seat"), F.lit("rescue").alias("how")))
