"""Corpus engineering: content ids, deduplication, splits, weights, leakage audits, manifests."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

# --- ids and hashes ------------------------------------------------------------------------------


def content_id(text: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-1 of a text."""
    return F.substring(F.sha1(text), 1, length)


def ordinal_id(prefix: str, ordinal: Column, text: Column) -> Column:
    """``prefix-0007-<10 hex digits of the SHA-256>``; an ordinal above 9999 widens."""
    return F.concat(F.lit(prefix + "-"), F.format_string("%04d", ordinal), F.lit("-"), F.substring(F.sha2(text, 256), 1, 10))


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json_sha256(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text written canonically: sorted keys, no blanks; null for null or what is no strict JSON."""

    def one(t):
        try:
            return None if t is None else hashlib.sha256(_canonical(json.loads(t)).encode()).hexdigest()
        except ValueError:
            return None

    return text.map(one)


def set_hash(df: DataFrame, group: str, value: str, separator: str = "\n", algorithm: str = "sha256") -> DataFrame:
    """(group, n, digest): a hash over the sorted values of each group, whatever the order of rows.

    Values are sorted by Spark, which spills, and hashed as they stream by: a group of any size is
    never held in memory. Nulls in ``value`` are left out; a group of nulls only has no row.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, n, any_ = None, None, 0, False
        for b in batches:
            out = []
            for g, v in zip(b["g"], b["v"]):
                if not any_ or g != key:
                    if any_:
                        out.append((key, n, digest.hexdigest()))
                    key, digest, n, any_ = g, hashlib.new(algorithm), 0, True
                digest.update((separator if n else "").encode() + v.encode())
                n += 1
            yield pd.DataFrame(out, columns=["g", "n", "digest"])
        if any_:
            yield pd.DataFrame([(key, n, digest.hexdigest())], columns=["g", "n", "digest"])

    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("string").alias("v"))
    out = rows.repartition("g").sortWithinPartitions("g", "v").mapInPandas(run, f"g {kind}, n long, digest string")
    return out.withColumnRenamed("g", group)


# --- deduplication ---------------------------------------------------------------------------------


def _pick(df: DataFrame, keys: list[str], order: list[Column], first: bool) -> DataFrame:
    """One row per key: the first or last by ``order``; a hash aggregate with map-side combine, no window."""
    pick = (F.min_by if first else F.max_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key of a table whose repeated rows have the same content.

    Which row stays doesn't matter then, so each column is aggregated by itself and columns that
    nobody asks for are pruned down to the scan. Use ``keep_first`` or ``keep_last`` where rows differ.
    """
    return df.dropDuplicates(list(keys))


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """For each key the row that comes last by ``order``."""
    return _pick(df, keys, [F.col(c) for c in order], False)


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """For each key the row that comes first by ``order``."""
    return _pick(df, keys, [F.col(c) for c in order], True)


def unique_or_fail(df: DataFrame, column: str) -> DataFrame:
    """One row (rows, distinct_values, unique)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(column).alias("distinct_values")).withColumn("unique", F.col("rows") == F.col("distinct_values"))


# --- order, limits, shards ---------------------------------------------------------------------------


def hash_order(seed: str, column: Column) -> Column:
    """Hex SHA-256 of seed and value: a reproducible random order that any system can redo."""
    return F.sha2(F.concat(F.lit(seed), column), 256)


def twister_shuffle(df: DataFrame, label: str, order: str, seed: int) -> DataFrame:
    """``df`` with ``shuffled``: each row's place after Python's seeded shuffle of its label's rows.

    The generator of the reference results is sequential, so a label's keys are shuffled in one task;
    use ``hash_order`` where labels are large.
    """
    kind = df.schema[order].dataType.simpleString()
    label_kind = df.schema[label].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf[order])
        random.Random(f"{seed}:{pdf[label].iloc[0]}").shuffle(keys)
        return pd.DataFrame({label: pdf[label].iloc[0], order: keys, "shuffled": range(len(keys))})

    places = df.select(label, order).groupBy(label).applyInPandas(run, f"{label} {label_kind}, {order} {kind}, shuffled long")
    return df.join(places, [label, order])


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``; 0 means all."""
    return df.orderBy(*order).limit(n) if n else df


def shard(df: DataFrame, ordinal: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th row from ``index`` on, by an ordinal column."""
    if not 0 <= index < count:
        raise ValueError("a shard's index must lie below its count")
    return df.where(F.pmod(F.col(ordinal), F.lit(count)) == index)


# --- splits and weights ----------------------------------------------------------------------------------


def _cut_by_hash(rows: DataFrame, group: str, digest: str, key: str, fraction: float) -> DataFrame:
    """``rows`` with ``split``: of each group of n > 1 rows the first max(1, n * fraction rounded half to even) by digest are eval.

    Digests are counted by their first digits, so only rows near the cut are ordered: a group of
    any size is spread over 4,096 windows of which one sorts.
    """
    rows = rows.withColumn("_b", F.substring(digest, 1, 3))
    counts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    upto = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    want = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction))).cast("long"))).otherwise(0)
    cut = upto.withColumn("_want", want).select(group, "_b", (F.col("_want") - F.col("_before")).alias("_left"), "_c")
    placed = rows.join(cut, [group, "_b"])
    rank = F.row_number().over(Window.partitionBy(group, "_b").orderBy(digest, key))
    inside = placed.where("_left > 0 and _left < _c").withColumn("split", F.when(rank <= F.col("_left"), "eval").otherwise("train"))
    outside = placed.where("not (_left > 0 and _left < _c)").withColumn("split", F.when(F.col("_left") > 0, "eval").otherwise("train"))
    return inside.unionByName(outside).drop("_b", "_left", "_c")


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: str = "") -> DataFrame:
    """``df`` with ``split``: of each stratum of n > 1 rows max(1, n * fraction rounded half to even) are eval, in hash order.

    A stratum of one row is all train. ``key`` is unique. Nulls form a stratum of their own.
    """
    rows = df.withColumn("_h", hash_order(seed, F.col(key).cast("string"))).withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")))
    return _cut_by_hash(rows, "_s", "_h", key, fraction).drop("_h", "_s")


def ungrouped_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``held_out``: each row for itself, near ``fraction`` of all, by the SHA-256 of ``seed:key``.

    The same rows are held out however the table is partitioned; equal keys stay together, a null key is never held out.
    """
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8)
    return df.withColumn("held_out", F.coalesce(digest < F.lit(f"{min(round(fraction * 2**32), 2**32 - 1):08x}"), F.lit(False)))


def layered_split(problems: DataFrame, template: str, key: str, dev_templates: int = 38) -> DataFrame:
    """``problems`` with ``layer``: seen_eval and heldout_eval by hint, one dev row of each of the first templates, else train.

    ``hint`` holds the split hint in lower case. The dev row of a template is that of the least key among its
    training rows; templates are taken in order. Rows of other hints have a null layer.
    """
    train = problems.where(F.col("hint").startswith("train") & F.col(template).isNotNull())
    dev = train.groupBy(template).agg(F.min(key).alias(key)).orderBy(template).limit(dev_templates).select(key, F.lit(True).alias("_dev"))
    layer = (
        F.when(F.col("hint") == "seen_eval", "frozen_seen").when(F.col("hint") == "heldout_eval", "frozen_heldout")
        .when(F.col("_dev"), "dev").when(F.col("hint").startswith("train"), "train")
    )
    return problems.join(F.broadcast(dev), key, "left").withColumn("layer", layer).drop("_dev")  # at most dev_templates rows


def group_split(df: DataFrame, source: str, family: str, case: str, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``split``: cases never straddle, strata are (source, family) of a case's first row by ordinal.

    Within a stratum cases are ordered by the SHA-256 of ``seed:('source', 'family'):case``; the first
    max(1, round(n * fraction)) of n > 1 are eval. ``df`` has an ``ordinal`` column.
    """
    first = df.groupBy(case).agg(F.min_by(F.struct(source, family), "ordinal").alias("_f"))
    stratum = F.concat(F.lit("('"), F.coalesce(F.col(f"_f.{source}"), F.lit("unknown")), F.lit("', '"), F.coalesce(F.col(f"_f.{family}"), F.lit("unknown")), F.lit("')"))
    cases = first.withColumn("_s", stratum).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), "_s", F.lit(":"), case), 256))
    return df.join(_cut_by_hash(cases, "_s", "_h", case, fraction).select(case, "split"), case)


def replay_copies(current: int, legacy: int, ratio: float) -> tuple[int, int, int]:
    """(target rows of legacy, whole copies of each, rows with one more) so that legacy makes up ``ratio``."""
    if ratio <= 0 or not current or not legacy:
        return legacy, 1 if legacy else 0, 0
    exact = current * ratio / (1 - ratio)
    target = int(exact) + (exact > int(exact) + 1e-9)
    return target, target // legacy, target % legacy


def replay_weighting(current: DataFrame, legacy: DataFrame, key: str, ratio: float, seed: str = "") -> DataFrame:
    """All of ``current`` and legacy rows, repeated or thinned, with ``copy``, so that legacy makes up ``ratio``."""
    n, m = current.count(), legacy.count()
    _, whole, more = replay_copies(n, m, ratio)
    # A limit over a sort takes the first rows of each partition only, so no task sees all of them.
    extra = legacy.select(key, hash_order(seed, F.col(key).cast("string")).alias("_h")).orderBy("_h", key).limit(more).select(key, F.lit(1).alias("_more")) if more else legacy.select(key, F.lit(1).alias("_more")).limit(0)
    times = F.lit(whole) + F.coalesce("_more", F.lit(0))
    repeated = legacy.join(extra, key, "left").withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t", "_more")
    return current.withColumn("copy", F.lit(1)).withColumn("part", F.lit("current")).unionByName(repeated.withColumn("part", F.lit("legacy")))


def focus_weighting(df: DataFrame, focus: Column, weight: int) -> DataFrame:
    """``weight`` - 1 more copies of the rows in focus, numbered from 1 in ``focus_copy``; the row itself has 0."""
    base = df.withColumn("focus_copy", F.lit(0))
    if weight <= 1:
        return base
    return base.unionByName(df.where(focus).withColumn("focus_copy", F.explode(F.sequence(F.lit(1), F.lit(weight - 1)))))


def capped_by_category(df: DataFrame, category: str, key: str, order: str, cap: int, limit: int) -> DataFrame:
    """Greedy selection in order: at most ``cap`` rows a category, one a key, ``limit`` in all (0: no limit).

    A key rejected by its category's cap may still be taken under another category, which a window
    cannot say; candidates are first cut to the cap * (1 + categories) of each category that can
    matter, then walked in order in one task.
    """
    first = keep_first(df.where(F.col(key).isNotNull()), [category, key], order)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, rows = {}, set(), []
        for i, (c, k) in enumerate(zip(pdf[category], pdf[key])):
            if k in seen or used.get(c, 0) >= cap:
                continue
            seen.add(k)
            used[c] = used.get(c, 0) + 1
            rows.append(i)
            if limit and len(rows) >= limit:
                break
        return pdf.iloc[rows].drop(columns=["_one"])

    if cap <= 0:
        return df.limit(0)
    slim = first.withColumn("_one", F.lit(1)).select(category, key, order, "_one")
    # Of a category's candidates at most cap are taken and at most cap a category went to others before.
    kinds_of = slim.select(category).distinct().count()
    w = Window.partitionBy(category).orderBy(order, key)
    pool = slim.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap * (1 + kinds_of)).drop("_r")
    chosen = pool.groupBy("_one").applyInPandas(lambda p: run(p.sort_values([order, key], kind="stable")), f"{category} {kinds[category]}, {key} {kinds[key]}, {order} {kinds[order]}")
    chosen = chosen.select(F.col(category).alias("_c"), F.col(key).alias("_k"))
    return first.join(chosen, F.col(category).eqNullSafe(F.col("_c")) & (F.col(key) == F.col("_k")), "left_semi")  # null is a category too


# --- set operations and audits --------------------------------------------------------------------------


def overlap(a: DataFrame, b: DataFrame, key: str, show: int = 20) -> DataFrame:
    """One row (n, examples): distinct keys in both, and the first ``show`` of them in order."""
    both = a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key))
    n = both.agg(F.count(F.lit(1)).alias("n"))
    some = both.orderBy(key).limit(show).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return n.withColumn("_", F.lit(0)).join(some.withColumn("_", F.lit(0)), "_").drop("_")  # a row each


def superset_check(df: DataFrame, key: str, have: str, need: list[str]) -> DataFrame:
    """(key, complete): whether an array holds all of ``need``; a null array doesn't."""
    return df.select(key, F.coalesce(F.size(F.array_except(F.array(*map(F.lit, need)), have)) == 0, F.lit(False)).alias("complete"))


def same_multiset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (equal): whether both hold the same keys equally often."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    return left.join(right, left[key].eqNullSafe(right[key]), "full_outer").agg(F.coalesce(F.bool_and(F.coalesce(F.col("n") == F.col("m"), F.lit(False))), F.lit(True)).alias("equal"))


def leakage_audit(train: DataFrame, evals: DataFrame, keys: list[str]) -> DataFrame:
    """(eval_set, key, n): distinct non-null values of each key column that an evaluation set shares with ``train``.

    ``evals`` has eval_set and the key columns. Every set and key has a row, zero where clean. Exact keys
    only. Keys are stacked, so one semi-join serves all of them.
    """
    stack = lambda df, *more: df.select(*more, F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("s")).select(*more, "s.key", "s.value").where("value is not null").distinct()
    hit = stack(evals, "eval_set").join(stack(train), ["key", "value"], "left_semi").groupBy("eval_set", "key").agg(F.count(F.lit(1)).alias("n"))
    every = evals.select("eval_set").distinct().select("eval_set", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    return every.join(hit, ["eval_set", "key"], "left").select("eval_set", "key", F.coalesce("n", F.lit(0)).alias("n"))


def split_manifest(df: DataFrame, split: str, key: str, category: str) -> DataFrame:
    """(split, n, categories, ids_sha256) of each split: size, histogram by category in order, hash of the sorted keys."""
    by = df.groupBy(split, category).agg(F.count(F.lit(1)).alias("n"))
    rows = by.groupBy(split).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(category).isNotNull(), F.struct(F.col(category).alias("k"), F.col("n").alias("v")))))).alias("categories"))
    return rows.join(set_hash(df, split, key).select(split, F.col("digest").alias("ids_sha256")), split)


# --- anti-joins -------------------------------------------------------------------------------------------


def pending(cases: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Cases whose key is in none of ``done``; a null key is always pending."""
    out = cases
    for d in done:
        out = out.join(d.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def without_texts(df: DataFrame, other: DataFrame, text: str) -> DataFrame:
    """Rows of ``df`` whose text is in no row of ``other``; texts are compared by SHA-256, so they never move. Null equals nothing."""
    digest = F.sha2(text, 256)
    return df.withColumn("_d", digest).join(other.where(F.col(text).isNotNull()).select(digest.alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def carried_over(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``old`` whose key ``new`` lacks, one row (dropped) counting the others)."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    dropped = old.join(new.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("dropped"))
    return kept, dropped
