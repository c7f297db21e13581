"""Connected components and joins that stay even when one key holds most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mendframe.session import Scratch


#: Cells that keys are counted in first: four times as many as there can be hot ones, so few cells hold them.
CELLS = 1 << 12


def hot_keys(big: DataFrame, key: str, share: float = 0.001, least: int = 1000) -> list:
    """The keys of ``big`` with more than ``share`` of its rows and more than ``least``: at most ``1 / share`` of them.

    Rows are counted by a hash of the key in ``CELLS`` cells, which is all that is shuffled; keys themselves are only
    counted within cells that are that full. Null is no key.
    """
    at = F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("_cell")
    counts = big.where(F.col(key).isNotNull()).select(at).groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).collect()  # at most CELLS rows
    floor = max(least, int(sum(r["_n"] for r in counts) * share))
    full = [r["_cell"] for r in counts if r["_n"] > floor]
    if not full:
        return []
    exact = big.where(F.col(key).isNotNull() & at.isin(full)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in exact.where(F.col("_n") > floor).select(key).collect()]


def join_with_hot_keys(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: float = 0.001, hot: list | None = None) -> DataFrame:
    """Join ``big`` to ``small``, whose ``key`` is unique, with no skewed shuffle.

    A key with more than ``share`` of the rows of ``big`` is hot. There are at most
    ``1 / share`` hot keys, so their rows of ``small`` have a fixed bound and are broadcast;
    the rows of ``big`` that carry them never move. All other keys are joined by shuffle.
    Null keys match nothing and, in a left join, stay with nulls. ``big`` is read for the counts and for the join, so it
    should be a table; ``hot`` gives its hot keys where they are known.
    """
    hot = hot_keys(big, key, share) if hot is None else hot
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    parts = [
        big.where(is_hot).join(F.broadcast(small.where(F.col(key).isin(hot))), key, how),
        big.where(~is_hot).join(small, key, how),
    ]
    return reduce(DataFrame.unionByName, parts)


def balanced_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, chunk: int = 2048) -> DataFrame:
    """All rows of ``left`` with all of ``right`` of the same non-null key, no task with more than ``chunk`` rows of either.

    Rows of a key are cut into chunks by a hash of their id, and each pair of chunks is a group of its own, so a key
    with a third of all rows is spread as evenly as any. Columns other than ``key`` have different names. Both sides
    are read several times, so they should be tables, not long plans.
    """
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).alias(name))
    sizes = count(left, "_kl").join(count(right, "_kr"), key)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    a = join_with_hot_keys(left, sizes, key).withColumn("_i", own(left_id, "_kl")).withColumn("_j", each("_kr")).drop("_kl", "_kr")
    b = join_with_hot_keys(right, sizes, key).withColumn("_j", own(right_id, "_kr")).withColumn("_i", each("_kl")).drop("_kl", "_kr")
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")


def min_label_components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its least node.

    Iterative minimum-label propagation with contraction: in each round every node takes the
    least label next to it, edges are rewritten to labels, loops and repeats drop out. The
    edges left shrink by at least the larger end of each, so the rounds grow as the logarithm
    of the longest path. Each round's tables are written to the shared folder.
    Rows with a null end are ignored; an empty input gives an empty result.
    """
    dtype = edges.schema[a].dataType.simpleString()
    live = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct()
    )
    live = scratch.write(live, f"{name}-e0")
    labels = scratch.write(
        live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component")),
        f"{name}-l0",
    )
    live = live.where("u <> v")
    for i in range(1, max_rounds + 1):
        if live.isEmpty():
            return labels
        both = live.select("u", "v").unionAll(live.select("v", "u")).toDF("x", "y")
        step = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        step = scratch.write(step, f"{name}-s{i}")
        # One pointer jump halves the chains that a round of minima leaves behind.
        up = step.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        jump = scratch.write(join_with_hot_keys(step, up, "m", "left").select("x", F.coalesce("mm", "m").alias("m")), f"{name}-j{i}")
        at_u = join_with_hot_keys(live, jump.toDF("u", "mu"), "u")
        at_v = join_with_hot_keys(at_u, jump.toDF("v", "mv"), "v")
        live_next = scratch.write(
            at_v.where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), f"{name}-e{i}"
        )
        moved = join_with_hot_keys(labels, jump.toDF("component", "_to"), "component", "left")
        labels_next = scratch.write(moved.select("node", F.coalesce("_to", "component").cast(dtype).alias("component")), f"{name}-l{i}")
        for old in (f"e{i - 1}", f"l{i - 1}", f"s{i}", f"j{i}"):
            scratch.drop(f"{name}-{old}")
        live, labels = live_next, labels_next
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
