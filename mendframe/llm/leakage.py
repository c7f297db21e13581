"""Records of evaluation splits that stand, exactly or almost, in the training split too."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.llm.records import programs, table, tidy
from mendframe.llm.setjoin import Rule, _column, candidate_pairs, counters, marks, records, sets_of, with_both
from mendframe.llm.shingles import Shingles
from mendframe.operators.components import balanced_pairs
from mendframe.session import Scratch

#: Three words a shingle, the least of every four successive ones is a fingerprint.
WINNOW = Rule(k=3, threshold=0.6, window=4, across=True)


def chain(pa_: list[int], pb_: list[int]) -> list[tuple[int, int]]:
    """A longest set of seeds (x, y) that rises in both coordinates."""
    order = sorted(zip(pa_, pb_), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(order)
    for k, (_, y) in enumerate(order):
        at = bisect_left(tails, y)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(order[k])
        k = back[k]
    return out[::-1]


def seeds(sa: np.ndarray, xa: np.ndarray, sb: np.ndarray, xb: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions of equal fingerprints; the j-th of a hash in one text meets the j-th in the other."""
    where: dict[int, list[int]] = {}
    for p in xb.tolist():
        where.setdefault(int(sb[p]), []).append(p)
    left, right, used = [], [], {}
    for p in xa.tolist():
        h = int(sa[p])
        k = used.get(h, 0)
        if h in where and k < len(where[h]):
            left.append(p)
            right.append(where[h][k])
            used[h] = k + 1
    return left, right


def coverage(sa: np.ndarray, xa: np.ndarray, sb: np.ndarray, xb: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(chained seeds, masks of the shingles of a and of b that the chain, extended along its diagonals, covers)."""
    links = chain(*seeds(sa, xa, sb, xb))
    in_a, in_b = np.zeros(len(sa), bool), np.zeros(len(sb), bool)
    by: dict[int, list[int]] = {}
    for x, y in links:
        by.setdefault(y - x, []).append(x)
    for d, xs in by.items():
        lo, hi = max(0, -d), min(len(sa), len(sb) - d)
        same = sa[lo:hi] == sb[lo + d : hi + d]
        run = np.cumsum(~same)  # equal numbers and equal shingles: one stretch of the diagonal
        hit = same & np.isin(run, run[np.array(xs) - lo])
        in_a[lo:hi] |= hit
        in_b[lo + d : hi + d] |= hit
    return len(links), in_a, in_b


def aligned(sa: np.ndarray, xa: np.ndarray, na: int, sb: np.ndarray, xb: np.ndarray, nb: int, threshold: float) -> tuple[float, int, float, float, bool] | None:
    """(similarity, chained seeds, share of a covered, share of b covered, whether the chain alone decides), or None below the threshold.

    What an extended chain covers both texts have, so its distinct shingles bound the similarity from below. Where
    that reaches the threshold the pair stands; elsewhere, as where blocks of text changed places, the whole sets decide.
    """
    chained, in_a, in_b = coverage(sa, xa, sb, xb)
    covered = len(np.unique(sa[in_a]))
    whole = len(np.intersect1d(sa, sb))
    similarity = whole / (na + nb - whole)
    decides = covered / (na + nb - covered) >= threshold
    if not decides and similarity < threshold:
        return None
    return similarity, chained, float(in_a.mean()), float(in_b.mean()), decides


ALIGNED = "a long, b long, similarity double, chained int, cover_a double, cover_b double, by_chain boolean"


def overlapping_classes(rows: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The columns of ``ALIGNED`` of class pairs across sides at the threshold: joined by fingerprints, chained, extended, then confirmed."""
    counts = counters(rows)
    pairs = candidate_pairs(rows, rule, scratch, counts)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, na, nb = (_column(b, c).to_numpy() for c in ("a", "b", "na", "nb"))
            found = []
            for k, (ta, tb) in enumerate(zip(_column(b, "ta"), _column(b, "tb"))):
                seq = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (ta, tb)]
                at = [np.flatnonzero(marks(Shingles(1, np.zeros(len(x), np.int64), x), shared.value, rule)) for x in seq]
                row = aligned(seq[0], at[0], na[k], seq[1], at[1], nb[k], rule.threshold)
                if row:
                    found.append((a_[k], b_[k], *row))
            cols = list(zip(*found)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [c.split()[0] for c in ALIGNED.split(", ")])

    return with_both(pairs, sets_of(rows, pairs, scratch)).mapInArrow(run, ALIGNED)


def sides(recs: DataFrame, hints: DataFrame) -> DataFrame:
    """``recs`` with split_name and side (1 train, 2 validation or test) by the table of hints; records of no split drop out."""
    named = hints.select("record_kind", tidy("split_hint").alias("hint"), tidy("split_name").alias("split_name")).distinct()
    side = F.when(F.col("split_name") == "train", 1).when(F.col("split_name").isin("validation", "test"), 2)
    return recs.join(named, ["record_kind", "hint"]).withColumn("side", side).where("side is not null")


def cross_split_overlaps(recs: DataFrame, rule: Rule = WINNOW, name: str = "leakage") -> DataFrame:
    """record_kind, train_key, eval_key, similarity, coverage, by_chain, same_hash of every overlap.

    ``recs`` has record_kind, key, text, part, side (1 train, 2 evaluation) and ast. A pair
    overlaps when its own similarity reaches the threshold or its non-null ``ast`` are equal.

    Fingerprints, joined across the sides, are the minima of all windows of ``rule.window`` successive shingles and, so that no pair is missed whose
    shared runs are all shorter, the rarest shingles of each text. Shared ones are the seeds of collinear chains, which are extended; what they
    cover decides, and where it doesn't reach the threshold the whole sets do (``by_chain`` tells). Coverage is the share of the
    evaluation text's shingles inside the extended chain; it and similarity are null where only the hashes are equal. Texts without
    shingles overlap by hash only. Empty tables give an empty result.
    """
    scratch = Scratch(recs.sparkSession, name)
    recs = recs.select("record_kind", "key", "text", "part", "side", "ast")
    rows = records(recs, rule, scratch)
    members = scratch.write(rows.where("n > 0").select("record_kind", "key", "side", "cid").distinct(), "classes")
    alike = scratch.write(overlapping_classes(rows, rule, scratch), "alike")
    scratch.drop("records", "pairs", "sets")
    ways = alike.select(F.col("a").alias("ct"), F.col("b").alias("ce"), "similarity", F.col("cover_b").alias("coverage"), "by_chain").unionByName(
        alike.select(F.col("b").alias("ct"), F.col("a").alias("ce"), "similarity", F.col("cover_a").alias("coverage"), "by_chain")
    )
    train = members.where("side = 1").select("record_kind", F.col("key").alias("train_key"), F.col("cid").alias("ct"))
    eval_ = members.where("side = 2").select(F.col("key").alias("eval_key"), F.col("cid").alias("ce"))
    # Keys of similar classes: first the training keys of each pair of classes, then its evaluation keys.
    ways = ways.withColumn("_w", F.xxhash64("ct", "ce"))
    of_train = scratch.write(balanced_pairs(ways, train, "ct", "_w", "train_key").drop("ct", "_w").withColumn("_w", F.xxhash64("ce", "train_key")), "of_train")
    near = balanced_pairs(of_train, eval_, "ce", "_w", "eval_key").select("record_kind", "train_key", "eval_key", "similarity", "coverage", "by_chain")
    equal = balanced_pairs(train.withColumnRenamed("ct", "c"), eval_.withColumnRenamed("ce", "c"), "c", "train_key", "eval_key").select(
        "record_kind", "train_key", "eval_key", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"), F.lit(True).alias("by_chain")
    )
    hashed = scratch.write(recs.where("ast is not null").select("record_kind", "key", "side", F.concat_ws(":", "record_kind", "ast").alias("ast")).distinct(), "hashed")
    by_hash = balanced_pairs(
        hashed.where("side = 1").select("record_kind", "ast", F.col("key").alias("train_key")), hashed.where("side = 2").select("ast", F.col("key").alias("eval_key")), "ast", "train_key", "eval_key"
    ).select("record_kind", "train_key", "eval_key", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("boolean").alias("by_chain"))
    tagged = near.unionByName(equal).withColumn("h", F.lit(False)).unionByName(by_hash.withColumn("h", F.lit(True)))
    return (
        tagged.where("train_key <> eval_key").groupBy("record_kind", "train_key", "eval_key")
        .agg(F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"), F.max("by_chain").alias("by_chain"), F.max("h").alias("same_hash"))
    )


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    recs = programs(table(spark, folder, "cases"), table(spark, folder, "problems"))
    return sides(recs, table(spark, folder, "hint_splits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cross_split_overlaps(_inputs(spark, folder))
    return found.select("record_kind", F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind, evaluation split and source or family: records, overlapping ones, by likeness and by hash, mean coverage."""
    recs = _inputs(spark, folder)
    found = cross_split_overlaps(recs, name="leakage_report")
    best = found.groupBy("record_kind", F.col("eval_key").alias("key")).agg(
        F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"), F.max("same_hash").alias("same_hash"), F.count(F.lit(1)).alias("partners")
    )
    eval_ = recs.where("side = 2").groupBy("record_kind", "key").agg(F.min("split_name").alias("split_name"), F.min(tidy("family")).alias("source"))
    joined = eval_.join(best, ["record_kind", "key"], "left")
    return joined.groupBy("record_kind", "split_name", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("partners").alias("overlapping"), F.count("similarity").alias("alike"),
        F.count_if("same_hash").alias("same_hash"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 4).alias("mean_coverage"),
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES: dict[str, str] = {}
