"""Groups of records that differ by small edits, insertions or reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.llm.records import programs, table
from mendframe.llm.setjoin import Rule, candidate_pairs, counters, exact_links, records
from mendframe.operators.components import balanced_pairs, join_with_hot_keys, min_label_components
from mendframe.session import Scratch


def near_duplicate_classes(recs: DataFrame, rule: Rule = Rule(), name: str = "near_dup") -> tuple[DataFrame, DataFrame]:
    """(membership, links) of records that are alike.

    ``recs`` has record_kind, key, text, part and side; ``part`` parts kinds that are never compared.
    Membership is record_kind, key, cid, n, class_id, links: one row per record, where class_id is
    equal for all records joined by links, directly or not, and ``links`` counts the record's links
    to different texts. Links are (a, b, similarity) of class ids ``cid`` of equal sets.

    Two records are linked when the Jaccard similarity of their sets of ``rule.k``-word shingles is at
    least ``rule.threshold``; equal sets are one class. A null, empty or shorter text has no
    shingle, hence no similarity, and is alone, even beside an equal one. A key whose rows hold
    different texts has one row per text. An empty table gives empty results.
    """
    scratch = Scratch(recs.sparkSession, name)
    recs = recs.withColumn("side", F.lit(3)) if "side" not in recs.columns else recs
    rows = records(recs, rule, scratch)
    members = scratch.write(rows.select("record_kind", "key", "cid", "n").distinct(), "classes")
    pairs = candidate_pairs(rows, rule, scratch, counters(rows))
    links = scratch.write(exact_links(rows, pairs, rule, scratch), "links")
    scratch.drop("records", "pairs", "sets")
    labels = min_label_components(links, "a", "b", scratch)
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    named = labels.toDF("cid", "label").join(degree, "cid")
    alone = F.when(F.col("n") == 0, F.xxhash64("record_kind", "key")).otherwise(F.col("cid"))
    out = join_with_hot_keys(members, named, "cid", "left").select("record_kind", "key", "cid", "n", F.coalesce("label", alone).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out, links


def group_pairs(membership: DataFrame) -> DataFrame:
    """One row for each pair of different keys of one group, the lesser key first."""
    g = Scratch(membership.sparkSession, "group_pairs").write(membership.where("n > 0").select("record_kind", "class_id", "key").distinct(), "members")
    both = balanced_pairs(g.withColumnRenamed("key", "key_a"), g.select("class_id", F.col("record_kind").alias("kind_b"), F.col("key").alias("key_b")), "class_id", "key_a", "key_b")
    return both.where("key_a < key_b and record_kind = kind_b").select("record_kind", "key_a", "key_b").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    recs = programs(table(spark, folder, "cases"), table(spark, folder, "problems"))
    membership, _ = near_duplicate_classes(recs)
    return group_pairs(membership)


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    recs = programs(table(spark, folder, "cases"), table(spark, folder, "problems"))
    membership, _ = near_duplicate_classes(recs, name="near_dup_classes")
    return membership.select("record_kind", "key", "class_id", "links")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
ORACLES: dict[str, str] = {}
