"""Sequence kernels over relations of lists: one row per element, (list_id, pos, x).

``pos`` counts from 0 without a gap in each list. A list without elements has no row, so results for
every list are driven by a table of groups where one is given. Results are DataFrames of
``list_id`` and the kernel's output. Lists of any length are handled by partial aggregates and by prefix
sums in blocks, so that one long list is never sorted in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Elements of a list whose running values are computed together; longer lists chain their blocks.
BLOCK = 1 << 16


def _for_all(groups: DataFrame | None, out: DataFrame, column: str, default) -> DataFrame:
    if groups is None:
        return out
    value = F.col(column) if default is None else F.coalesce(column, F.lit(default))
    return groups.select("list_id").distinct().join(out, "list_id", "left").select("list_id", value.alias(column))


def floor_mod(x: Column, m: int) -> Column:
    """x modulo m, of the sign of m."""
    return F.pmod(x, F.lit(m))


# --- aggregates -------------------------------------------------------------------------------


def value_counts(rel: DataFrame) -> DataFrame:
    """(list_id, x, n, first_pos) of each distinct value."""
    return rel.groupBy("list_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def has_duplicate(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Whether a value repeats; false for an empty list."""
    out = value_counts(rel).groupBy("list_id").agg(F.max(F.col("n") > 1).alias("has_duplicate"))
    return _for_all(groups, out, "has_duplicate", False)


def distinct_cardinality(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Exact number of distinct values; 0 for an empty list."""
    out = value_counts(rel).groupBy("list_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    return _for_all(groups, out, "n_distinct", 0)


def mode_bucket(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The most frequent value, of equally frequent ones the smallest; null for an empty list."""
    out = value_counts(rel).groupBy("list_id").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("mode"))
    return _for_all(groups, out, "mode", None)


def extremes(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Least and greatest value; nulls for an empty list."""
    out = rel.groupBy("list_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return out if groups is None else groups.select("list_id").distinct().join(out, "list_id", "left")


def concatenation(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The strings of a list joined in order without a separator; '' for an empty list. Nulls add nothing."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "x")))
    out = rel.groupBy("list_id").agg(F.array_join(F.transform(parts, lambda s: s["x"]), "").alias("joined"))
    return _for_all(groups, out, "joined", "")


def histogram(df: DataFrame, key: str) -> DataFrame:
    """One row: a map from each key, in order, to its number of rows. Null keys are left out."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("count"))))).alias("histogram"))


def success_counts(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """(group, successful, total): two counters of each group; a null success counts as failure."""
    return df.groupBy(group).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("successful"), F.count(F.lit(1)).alias("total"))


def all_and_any(df: DataFrame, group: str, flag: Column, empty_all: bool = True) -> DataFrame:
    """(group, all_true, any_true); a null flag is ignored, and a group of nulls only has ``empty_all`` and false."""
    return df.groupBy(group).agg(
        F.coalesce(F.bool_and(flag), F.lit(empty_all)).alias("all_true"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_true")
    )


# --- running values and windows -----------------------------------------------------------------


def running(rel: DataFrame, value: str, out: str, how: str = "sum", block: int = BLOCK) -> DataFrame:
    """``rel`` with the running sum or maximum of ``value`` in the order of pos.

    Each block of ``block`` positions is summed on its own, then the blocks of a list are chained,
    so a list of n elements needs windows of at most ``block`` and n / ``block`` rows.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    blocked = rel.withColumn("_b", F.floor(F.col("pos") / block))
    inner = Window.partitionBy("list_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy("list_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy("list_id", "_b").agg(agg(value).alias("_s")).select("list_id", "_b", agg("_s").over(outer).alias("_o"))
    own = blocked.withColumn("_r", agg(value).over(inner)).join(before, ["list_id", "_b"])
    total = F.col("_r") + F.coalesce("_o", F.lit(0)) if how == "sum" else F.greatest("_r", "_o")
    return own.withColumn(out, total).drop("_b", "_r", "_o")


def prefix_sums(rel: DataFrame) -> DataFrame:
    """(list_id, pos, prefix): inclusive prefix sums."""
    return running(rel, "x", "prefix").select("list_id", "pos", "prefix")


def _prefix_table(rel: DataFrame, groups: DataFrame) -> DataFrame:
    """(list_id, i, p): sums of the first i elements, from i = 0."""
    p = prefix_sums(rel).select("list_id", (F.col("pos") + 1).alias("i"), F.col("prefix").alias("p"))
    return p.unionByName(groups.select("list_id").distinct().select("list_id", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("p")))


def max_window_sum(rel: DataFrame, k: DataFrame) -> DataFrame:
    """The greatest sum of k successive elements for each row (list_id, k) of ``k``; null where k < 1 or k exceeds the list.

    Prefix differences, so that the cost doesn't grow with k.
    """
    p = _prefix_table(rel, k).join(k.select("list_id", "k").distinct(), "list_id").where("k >= 1")
    start = p.select("list_id", "k", (F.col("i") + F.col("k")).alias("i"), F.col("p").alias("p0"))
    sums = p.join(start, ["list_id", "k", "i"]).groupBy("list_id", "k").agg(F.max(F.col("p") - F.col("p0")).alias("best"))
    return k.select("list_id", "k").distinct().join(sums, ["list_id", "k"], "left")


def range_sums(rel: DataFrame, queries: DataFrame) -> DataFrame:
    """(list_id, q_pos, total) of each query (list_id, q_pos, l, r): the sum of elements l up to but not with r."""
    p = _prefix_table(rel, queries)
    q = queries.select("list_id", "q_pos", "l", "r")
    hi = q.join(p.select("list_id", F.col("i").alias("r"), F.col("p").alias("ph")), ["list_id", "r"])
    both = hi.join(p.select("list_id", F.col("i").alias("l"), F.col("p").alias("pl")), ["list_id", "l"])
    return both.select("list_id", "q_pos", (F.col("ph") - F.col("pl")).alias("total"))


def frequency_index(rel: DataFrame) -> DataFrame:
    """(list_id, pos, freq): how often each element's value occurs in its list."""
    return rel.join(value_counts(rel).select("list_id", "x", "n"), ["list_id", "x"]).select("list_id", "pos", F.col("n").alias("freq"))


def stable_distinct(rel: DataFrame) -> DataFrame:
    """(list_id, pos, x) of the first occurrence of each value."""
    return value_counts(rel).select("list_id", F.col("first_pos").alias("pos"), "x")


def first_unique(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The first value that occurs once, else null."""
    out = value_counts(rel).where("n = 1").groupBy("list_id").agg(F.min_by("x", "first_pos").alias("first_unique"))
    return _for_all(groups, out, "first_unique", None)


def subarray_sum_count(rel: DataFrame, targets: DataFrame) -> DataFrame:
    """(list_id, n): the number of runs of elements that sum to the list's target; ``targets`` has list_id and target."""
    p = _prefix_table(rel, targets)
    starts = p.select("list_id", "p", "i", F.lit(1).cast("long").alias("is_start"))
    ends = p.join(targets.select("list_id", "target"), "list_id").select("list_id", (F.col("p") - F.col("target")).alias("p"), "i", F.lit(0).cast("long").alias("is_start"))
    # An end meets the starts of its value that come before it: a running count, no gathered lists.
    w = Window.partitionBy("list_id", "p").orderBy("i", "is_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = starts.unionByName(ends).withColumn("h", F.sum("is_start").over(w)).where("is_start = 0")
    out = hits.groupBy("list_id").agg(F.sum("h").alias("n"))
    return _for_all(targets, out, "n", 0)


def longest_unique_span(rel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Length of the longest run of elements without a repeat."""
    before = F.lag("pos").over(Window.partitionBy("list_id", "x").orderBy("pos"))
    left = running(rel.withColumn("_from", F.coalesce(before + 1, F.lit(0))), "_from", "_left", "max")
    out = left.groupBy("list_id").agg(F.max(F.col("pos") - F.col("_left") + 1).alias("longest"))
    return _for_all(groups, out, "longest", 0)


def round_robin(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first n rows of rounds that take one row of each stratum, strata in order, rows of a stratum by ``order``."""
    w = Window.partitionBy(stratum).orderBy(order)
    first = df.withColumn("_round", F.row_number().over(w)).where(F.col("_round") <= n)
    return first.orderBy("_round", stratum).limit(n).drop("_round")


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, ...): for each name its value at the 0-based index floor(share * n) of the sorted non-null values.

    Values are counted before they are ordered, so a window holds distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    upto = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum("_c").over(w))
    at = lambda s: F.least(F.floor(F.col("_n") * F.lit(float(s))), F.col("_n") - 1)
    return upto.groupBy(group).agg(*(F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(name) for name, s in shares.items()))


# --- lookups --------------------------------------------------------------------------------------


def first_match(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(k_pos, key, value): for each key the value of the first item of that key, else null.

    ``items`` has pos, key, value; ``keys`` has k_pos, key.
    """
    once = items.groupBy("key").agg(F.min_by("value", "pos").alias("value"))
    return keys.select("k_pos", "key").join(once, "key", "left").select("k_pos", "key", "value")


def last_match(items: DataFrame, keys: DataFrame) -> DataFrame:
    """As ``first_match`` with the last item of each key."""
    once = items.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    return keys.select("k_pos", "key").join(once, "key", "left").select("k_pos", "key", "value")


def position_index(rel: DataFrame, queries: DataFrame) -> DataFrame:
    """(list_id, q_pos, index): the first position of each query's value in its list, else -1."""
    v = value_counts(rel).select("list_id", F.col("x").alias("q"), F.col("first_pos").alias("_p"))
    return queries.join(v, ["list_id", "q"], "left").select("list_id", "q_pos", F.coalesce("_p", F.lit(-1)).alias("index"))


def count_index(rel: DataFrame, queries: DataFrame) -> DataFrame:
    """(list_id, q_pos, n): how often each query's value occurs in its list."""
    v = value_counts(rel).select("list_id", F.col("x").alias("q"), F.col("n").alias("_n"))
    return queries.join(v, ["list_id", "q"], "left").select("list_id", "q_pos", F.coalesce("_n", F.lit(0)).alias("n"))


def residue_count_index(rel: DataFrame, queries: DataFrame, base: int) -> DataFrame:
    """As ``count_index`` for equal residues modulo ``base``."""
    return count_index(rel.withColumn("x", floor_mod(F.col("x"), base)), queries.withColumn("q", floor_mod(F.col("q"), base)))


def membership_count(rel: DataFrame, other: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(list_id, n): elements, repeats counted, whose value is in the same list of ``other``."""
    out = rel.join(other.select("list_id", F.col("q").alias("x")), ["list_id", "x"], "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return _for_all(groups, out, "n", 0)


def pair_sum(rel: DataFrame, targets: DataFrame) -> DataFrame:
    """(list_id, found): whether two elements at different positions sum to the list's target."""
    v = value_counts(rel)
    want = v.join(targets.select("list_id", "target"), "list_id").withColumn("y", F.col("target") - F.col("x"))
    other = v.select("list_id", F.col("x").alias("y"))
    hit = want.join(other, ["list_id", "y"], "left_semi").where("x <> y or n > 1").select("list_id").distinct().withColumn("found", F.lit(True))
    return _for_all(targets, hit, "found", False)


def ordered_intersection(rel: DataFrame, other: DataFrame) -> DataFrame:
    """(list_id, pos, x): distinct values also in the same list of ``other``, by first occurrence."""
    return stable_distinct(rel).join(other.select("list_id", F.col("q").alias("x")), ["list_id", "x"], "left_semi").select("list_id", "pos", "x")
