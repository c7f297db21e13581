"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mendframe.llm.records import table, tidy
from mendframe.operators.components import join_with_hot_keys, min_label_components
from mendframe.session import Scratch

#: Small groups whose largest stratum is the same share this many units of assignment; a group above SHARE of all records is a unit of its own.
UNITS = 32
SHARE = 0.001
#: So many of the commonest strata are told apart; rarer ones count as one.
STRATA = 64


def family_form(c: str) -> Column:
    """A family as it is compared: trimmed, lower case, ``_`` read as ``-``; blank is null."""
    x = F.translate(tidy(c), "_", "-")
    return F.when(x != "", x)


def template_form(c: str) -> Column:
    x = tidy(c)
    return F.when(x != "", x)


def tied_groups(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """``recs`` with ``group_id``: equal for records that share an entity, directly or through others.

    ``recs`` has id, family and template in compared form. The bipartite graph of records and
    entities is contracted to distinct (family, template) pairs, then the least label spreads
    over it round by round. A group is named by its least entity, families before templates; a record
    of no entity is a group of its own.
    """
    f, t = F.concat(F.lit("f:"), "family"), F.concat(F.lit("t:"), "template")
    nodes = recs.withColumns({"_f": f, "_t": t}).withColumn("_node", F.coalesce("_f", "_t"))
    edges = nodes.where("_f is not null and _t is not null").select("_f", "_t").distinct()
    labels = min_label_components(edges, "_f", "_t", scratch, "ties").toDF("_node", "_label")
    out = join_with_hot_keys(nodes, labels, "_node", "left")
    group = F.coalesce("_label", "_node", F.concat(F.lit("r:"), "id"))
    return out.withColumn("group_id", group).drop("_f", "_t", "_node", "_label")


def problem_records(problems: DataFrame, hints: DataFrame) -> DataFrame:
    """id, family, template, stratum, split_name of each problem; rows without id drop out, repeated rows count once."""
    named = hints.where("record_kind = 'problem'").select(tidy("split_hint").alias("hint"), tidy("split_name").alias("split_name")).distinct()
    recs = problems.where("id is not null").select(
        "id", family_form("family_id").alias("family"), template_form("template_id").alias("template"),
        F.col("input_generator.kind").alias("stratum"), tidy("split_hint").alias("hint"),
    )
    return recs.distinct().join(named, "hint", "left").drop("hint")


def conflicts(groups: DataFrame) -> DataFrame:
    """Records of the groups whose hints name two or more splits, with group_family, the least family of the group or null."""
    by = groups.groupBy("group_id").agg(F.min("split_name").alias("_lo"), F.max("split_name").alias("_hi"))
    bad = by.where("_lo <> _hi").select("group_id", F.lit(1).alias("_bad"))
    family = F.when(F.col("group_id").startswith("f:"), F.substring("group_id", 3, 2**31 - 1))
    return join_with_hot_keys(groups, bad, "group_id", "inner").select(F.col("id").alias("problem_id"), family.alias("group_family")).distinct()


def assign_splits(groups: DataFrame, targets: DataFrame, name: str = "assignment") -> DataFrame:
    """``groups`` with assigned_split, near the target shares in all and in each stratum.

    Groups above ``SHARE`` of all records are placed one by one. All others share ``UNITS`` units for each stratum that is their largest, so
    a unit holds groups of like mix; the driver sees at most ``(UNITS * STRATA + 1/SHARE) * STRATA`` counts however many groups there are.
    Units are placed from the largest down, each where the squared deviation of split sizes and
    label distributions from their targets grows least; ties go to the first split by name.
    """
    scratch = Scratch(groups.sparkSession, name)
    rows = sorted((r["split_name"], float(r["target_share"] or 0)) for r in targets.where("split_name is not null").groupBy("split_name").agg(F.max("target_share").alias("target_share")).collect())
    scale = sum(s for _, s in rows) or 1.0
    once = groups.groupBy("id").agg(F.min("group_id").alias("group_id"), F.min(F.coalesce("stratum", F.lit(""))).alias("stratum"))
    strata = once.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stratum").limit(STRATA - 1).collect()
    named = [r["stratum"] for r in strata]
    stratum = F.when(F.col("stratum").isin(named), F.col("stratum")).otherwise("(rarer)") if named else F.col("stratum")
    sizes = scratch.write(once.groupBy("group_id", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    small = F.concat(F.lit("u:"), "_main", F.lit(":"), F.pmod(F.xxhash64("group_id"), F.lit(UNITS)))
    mains = sizes.groupBy("group_id").agg(F.max_by("stratum", F.struct("n", "stratum")).alias("_main"), F.sum("n").alias("_n"))
    units = scratch.write(mains.select("group_id", F.when(F.col("_n") > max(1, int(total * SHARE)), F.concat(F.lit("g:"), "group_id")).otherwise(small).alias("unit")), "units")
    table_: dict[str, dict[str, int]] = {}
    whole: dict[str, int] = {}
    for u, s, n in sizes.join(units, "group_id").groupBy("unit", "stratum").agg(F.sum("n").alias("n")).collect():
        table_.setdefault(u, {})[s] = n
        whole[s] = whole.get(s, 0) + n
    held = [[dict.fromkeys(whole, 0), 0] for _ in rows]
    place: dict[str, str] = {}
    for u in sorted(table_, key=lambda u: (-sum(table_[u].values()), u)):
        n = sum(table_[u].values())

        def cost(k: int) -> float:
            share = rows[k][1] / scale
            got, size = held[k]
            grow = lambda now, more, goal: ((now + more - goal) ** 2 - (now - goal) ** 2) / max(goal, 1.0)
            return grow(size, n, share * total) + sum(grow(got[s], m, share * whole[s]) for s, m in table_[u].items()) / len(whole)

        best = min(range(len(rows)), key=lambda k: (rows[k][1] <= 0, cost(k), k))
        place[u] = rows[best][0]
        held[best][1] += n
        for s, m in table_[u].items():
            held[best][0][s] += m
    if not place:
        return groups.withColumn("assigned_split", F.lit(None).cast("string"))
    placed = groups.sparkSession.createDataFrame(list(place.items()), "unit string, assigned_split string")
    named = units.join(F.broadcast(placed), "unit").select("group_id", "assigned_split")  # at most UNITS * STRATA + 1/SHARE rows are broadcast
    return join_with_hot_keys(groups, named, "group_id", "left")


def _groups(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scratch = Scratch(spark, name)
    recs = scratch.write(problem_records(table(spark, folder, "problems"), table(spark, folder, "hint_splits")), "records")
    return scratch.write(tied_groups(recs, scratch), "groups")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return conflicts(_groups(spark, folder, "ties"))


def p4_assign(spark: SparkSession, folder: str) -> DataFrame:
    out = assign_splits(_groups(spark, folder, "assign"), table(spark, folder, "split_targets"))
    return out.select(F.col("id").alias("problem_id"), "group_id", "assigned_split").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each split in all records and in each stratum."""
    out = assign_splits(_groups(spark, folder, "assign_report"), table(spark, folder, "split_targets"))
    once = out.groupBy("id").agg(F.min("assigned_split").alias("split_name"), F.min("stratum").alias("stratum"))
    cells = once.groupBy("stratum", "split_name").agg(F.count(F.lit(1)).alias("records"))
    whole = cells.groupBy("stratum").agg(F.sum("records").alias("_all"))
    targets = table(spark, folder, "split_targets")
    return (
        cells.join(whole, cells["stratum"].eqNullSafe(whole["stratum"])).drop(whole["stratum"]).join(targets, "split_name", "left")
        .select("stratum", "split_name", "target_share", "records", F.round(F.col("records") / F.col("_all"), 4).alias("actual_share"))
    )


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The records of each group of the assignment and in how many splits they lie."""
    return p4_assign(spark, folder).groupBy("group_id").agg(F.countDistinct("problem_id").alias("records"), F.countDistinct("assigned_split").alias("splits"))


QUERIES = {"p4_found": p4_found, "p4_assign": p4_assign, "p4_report": p4_report, "p4_kept": p4_kept}
_GROUPS = """
WITH RECURSIVE r AS (
  SELECT DISTINCT id, nullif(replace(lower(trim(family_id)), '_', '-'), '') AS f, nullif(lower(trim(template_id)), '') AS t, lower(trim(split_hint)) AS hint
  FROM problems WHERE id IS NOT NULL),
n AS (SELECT DISTINCT 'f:' || f AS a, 't:' || t AS b FROM r WHERE f IS NOT NULL AND t IS NOT NULL),
e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a),
lab AS (SELECT node, min(seen) AS label FROM reach GROUP BY node),
g AS (
  SELECT r.id, coalesce(lab.label, 'f:' || r.f, 't:' || r.t, 'r:' || r.id) AS grp, h.split_name
  FROM r LEFT JOIN lab ON lab.node = coalesce('f:' || r.f, 't:' || r.t)
  LEFT JOIN hint_splits h ON h.record_kind = 'problem' AND h.split_hint = r.hint),
"""
ORACLES = {
    "p4_kept": _GROUPS.rstrip().rstrip(",") + " SELECT grp AS group_id, count(DISTINCT id) AS records, 1::BIGINT AS splits FROM g GROUP BY grp",
    "p4_found": _GROUPS + """bad AS (SELECT grp FROM g GROUP BY grp HAVING count(DISTINCT split_name) >= 2)
SELECT DISTINCT g.id AS problem_id, CASE WHEN grp LIKE 'f:%' THEN substr(grp, 3) END AS group_family FROM g JOIN bad USING (grp)
""",
}
