"""Queries of the corpus operators over cases, problems, documents and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.operators import corpus as C
from mendframe.plans.kernel_queries import read


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Repair cases, each once."""
    return C.once(read(spark, folder, "cases"), "case_id")


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """Problem records, each once, with the split hint in compared form as ``hint``."""
    rows = C.once(read(spark, folder, "problems"), "id")
    return rows.withColumn("hint", F.lower(F.trim("split_hint")))


def _train_and_evals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    keys = ["id", "template_id", "normalized_ast_sha256", "family_id"]
    p = problems(spark, folder)
    train = p.where(F.col("hint").startswith("train")).select(*keys)
    evals = p.where(F.col("hint").isin("seen_eval", "heldout_eval", "dev_behavioral")).select(F.col("hint").alias("eval_set"), *keys)
    return train, evals


def _orders_split(spark, folder):
    return C.stratified_split(read(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.35, "7:")


def _sft_rows(spark, folder):
    c = cases(spark, folder)
    return c.select(F.col("case_id"), F.coalesce("source", F.lit("unknown")).alias("src"), F.coalesce("category", F.lit("unknown")).alias("fam"), F.xxhash64("case_id").alias("ordinal"))


def _replay(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return C.replay_weighting(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), "o_orderkey", 0.4, "7:").select("part", "o_orderkey", F.col("copy").cast("int").alias("copy"))


_CASES = "WITH c AS (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ingested_at) = 1)\n"
_PROBLEMS = "WITH p AS (SELECT *, lower(trim(split_hint)) AS hint FROM problems QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)\n"
_AUDIT = _PROBLEMS.rstrip() + """, t AS (SELECT * FROM p WHERE hint LIKE 'train%'), e AS (SELECT hint AS eval_set, * FROM p WHERE hint IN ('seen_eval', 'heldout_eval', 'dev_behavioral')),
k AS (SELECT eval_set, 'id' AS key, id AS v FROM e UNION ALL SELECT eval_set, 'template_id', template_id FROM e UNION ALL SELECT eval_set, 'normalized_ast_sha256', normalized_ast_sha256 FROM e UNION ALL SELECT eval_set, 'family_id', family_id FROM e),
h AS (SELECT 'id' AS key, id AS v FROM t UNION SELECT 'template_id', template_id FROM t UNION SELECT 'normalized_ast_sha256', normalized_ast_sha256 FROM t UNION SELECT 'family_id', family_id FROM t),
a AS (SELECT eval_set, key, CAST(count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.key = k.key AND h.v = k.v) THEN v END) AS BIGINT) AS n FROM k GROUP BY 1, 2)
"""
_TEMPLATES = ("seen_eval", "heldout_eval")

QUERIES = {
    "SET2": lambda s, d: C.overlap(*(problems(s, d).where(F.col("hint") == h) for h in _TEMPLATES), "family_id").select("n", F.concat_ws("|", "examples").alias("examples")),
    "SET3": lambda s, d: C.overlap(problems(s, d).where("hint = 'train_v2'"), problems(s, d).where("hint = 'train_v6'"), "id").select((F.col("n") == 0).alias("disjoint")),
    "SET4": lambda s, d: cases(s, d).select(F.col("case_id").alias("key"), F.lit("case").alias("part"), "seed_index").unionByName(problems(s, d).select(F.col("id").alias("key"), F.lit("problem").alias("part"), "family_id"), allowMissingColumns=True),
    "SET5": lambda s, d: C.superset_check(problems(s, d), "id", "benchmark_variant_ids", ["b0", "b1", "b2"]),
    "SET6": lambda s, d: C.same_multiset(read(s, d, "orders").select(F.col("o_custkey").alias("k")), read(s, d, "customer").select(F.col("c_custkey").alias("k")), "k"),
    "SRT1": lambda s, d: read(s, d, "supplier").select("s_suppkey", "s_name").orderBy("s_name"),
    "SRT2": lambda s, d: cases(s, d).select("case_id", C.hash_order("7:", F.col("case_id")).alias("digest")).orderBy("digest").limit(50),
    "SRT2_all": lambda s, d: cases(s, d).select("case_id", C.hash_order("7:", F.col("case_id")).alias("digest")).orderBy("digest"),
    "SRT4": lambda s, d: C.first_rows(read(s, d, "orders").select("o_orderkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey"),
    "SRT5": lambda s, d: C.shard(read(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 3, 8),
    "COR1": lambda s, d: read(s, d, "documents").select("doc_id", C.content_id(F.col("text")).alias("content_id")),
    "COR2": lambda s, d: cases(s, d).select("case_id", F.concat(F.lit("struct_"), "category", F.lit("_"), "case_id").alias("struct_id")),
    "COR3": lambda s, d: problems(s, d).select("id", C.ordinal_id("cs-v1", F.col("semantic_variant"), F.col("reference_source")).alias("formatted")),
    "COR4": lambda s, d: C.keep_last(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey"),
    "COR5": lambda s, d: C.keep_first(cases(s, d).select(F.sha1(F.concat(F.coalesce("category", F.lit("")), "broken")).alias("digest"), "case_id", "created_at"), ["digest"], "created_at", "case_id").select("digest", "case_id"),
    "COR7": lambda s, d: C.unique_or_fail(read(s, d, "cases").select("case_id"), "case_id"),
    "COR8": _orders_split,
    "COR9": lambda s, d: C.layered_split(problems(s, d).select("id", "template_id", "hint"), "template_id", "id").select("id", "layer"),
    "COR10": lambda s, d: problems(s, d).agg(
        (F.count("id") == F.countDistinct("id")).alias("unique_ids"), F.countDistinct(F.when(F.col("hint") == "seen_eval", F.col("template_id"))).alias("seen_templates"),
        F.countDistinct(F.when(F.col("hint") == "heldout_eval", F.col("family_id"))).alias("heldout_families"),
    ),
    "COR11": lambda s, d: C.group_split(_sft_rows(s, d), "src", "fam", "case_id", 0.2, 7).select("case_id", "split"),
    "COR12": _replay,
    "COR13": lambda s, d: C.focus_weighting(problems(s, d).select("id", "family_id"), F.col("family_id") == "adjacent-gap-scan", 3).select("id", F.col("focus_copy").cast("int").alias("focus_copy")),
    "COR14": lambda s, d: C.leakage_audit(*_train_and_evals(s, d), ["id", "template_id", "normalized_ast_sha256", "family_id"]),
    "COR15": lambda s, d: C.split_manifest(cases(s, d).withColumn("split", F.lower(F.trim("split_hint"))).where("split is not null"), "split", "case_id", "category").select("split", "n", "ids_sha256"),
    "COR15_manifest": lambda s, d: C.split_manifest(cases(s, d).withColumn("split", F.lower(F.trim("split_hint"))).where("split is not null"), "split", "case_id", "category").select("split", "n", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("categories"), "ids_sha256"),
    "COR17": lambda s, d: cases(s, d).groupBy("source", "intended_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verified")).alias("verified")),
    "COR24": lambda s, d: read(s, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey"),
    "COR25": lambda s, d: cases(s, d).agg(F.count(F.lit(1)).alias("requested"), F.count_if("verified").alias("kept"), F.countDistinct("intended_code").alias("codes"), F.sum(F.size("observed_codes")).cast("long").alias("observed")),
    "AGG10": lambda s, d: C.set_hash(cases(s, d), "intended_code", "case_id"),
    "JN7": lambda s, d: C.pending(cases(s, d), [read(s, d, "trajectories").where("outcome = 'success'")], "case_id").select("case_id"),
    "JN8": lambda s, d: C.without_texts(cases(s, d).where("lower(trim(split_hint)) = 'train'"), cases(s, d).where("lower(trim(split_hint)) <> 'train'"), "broken").select("case_id"),
    "JN9": lambda s, d: C.carried_over(read(s, d, "customer").select(F.col("c_custkey").alias("k")), read(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")[1],
    "JN9_kept": lambda s, d: C.carried_over(read(s, d, "customer").select(F.col("c_custkey").alias("k")), read(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")[0],
    "JN10": lambda s, d: read(s, d, "trajectories").dropDuplicates(["id"]).select(F.col("id").alias("traj_id"), F.col("case_id").alias("id")).join(problems(s, d).select("id", "family_id"), "id").select("traj_id", "family_id"),
    "HSH1": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1")),
}
ORACLES = {
    "SET2": _PROBLEMS.rstrip() + ", o AS (SELECT family_id FROM p WHERE hint = 'seen_eval' AND family_id IS NOT NULL INTERSECT SELECT family_id FROM p WHERE hint = 'heldout_eval') SELECT count(*) AS n, coalesce(array_to_string(list_slice(list_sort(list(family_id)), 1, 20), '|'), '') AS examples FROM o",
    "SET3": _PROBLEMS + "SELECT count(*) = 0 AS disjoint FROM (SELECT id FROM p WHERE hint = 'train_v2' INTERSECT SELECT id FROM p WHERE hint = 'train_v6')",
    "SET4": "SELECT case_id AS key, 'case' AS part, seed_index, NULL AS family_id FROM (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ingested_at) = 1) UNION ALL SELECT id, 'problem', NULL, family_id FROM (SELECT * FROM problems QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)",
    "SET5": _PROBLEMS + "SELECT id, list_has_all(benchmark_variant_ids, ['b0', 'b1', 'b2']) AS complete FROM p",
    "SET6": "SELECT (SELECT count(*) FROM (SELECT o_custkey AS k, count(*) FROM orders GROUP BY 1 EXCEPT SELECT c_custkey, count(*) FROM customer GROUP BY 1)) + (SELECT count(*) FROM (SELECT c_custkey AS k, count(*) FROM customer GROUP BY 1 EXCEPT SELECT o_custkey, count(*) FROM orders GROUP BY 1)) = 0 AS equal",
    "SRT1": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name",
    "SRT2": "SELECT DISTINCT case_id, sha256('7:' || case_id) AS digest FROM cases ORDER BY digest LIMIT 50",
    "SRT2_all": "SELECT DISTINCT case_id, sha256('7:' || case_id) AS digest FROM cases ORDER BY digest",
    "SRT4": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "SRT5": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 8 = 3",
    "COR1": "SELECT doc_id, substr(sha1(text), 1, 12) AS content_id FROM documents",
    "COR2": _CASES + "SELECT case_id, 'struct_' || category || '_' || case_id AS struct_id FROM c",
    "COR3": _PROBLEMS + "SELECT id, 'cs-v1-' || printf('%04d', semantic_variant) || '-' || substr(sha256(reference_source), 1, 10) AS formatted FROM p",
    "COR4": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "COR5": _CASES + "SELECT sha1(coalesce(category, '') || broken) AS digest, case_id FROM c QUALIFY row_number() OVER (PARTITION BY sha1(coalesce(category, '') || broken) ORDER BY created_at, case_id) = 1",
    "COR7": "SELECT count(*) AS rows, count(DISTINCT case_id) AS distinct_values, count(*) = count(DISTINCT case_id) AS unique FROM cases",
    "COR8": """SELECT o_orderkey, o_orderpriority, CASE WHEN n > 1 AND r <= greatest(1, round_even(n * 0.35::DOUBLE, 0)) THEN 'eval' ELSE 'train' END AS split
FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
    "COR9": _PROBLEMS.rstrip() + """, d AS (SELECT template_id, min(id) AS id FROM p WHERE hint LIKE 'train%' AND template_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 38)
SELECT id, CASE WHEN hint = 'seen_eval' THEN 'frozen_seen' WHEN hint = 'heldout_eval' THEN 'frozen_heldout' WHEN id IN (SELECT id FROM d) THEN 'dev' WHEN hint LIKE 'train%' THEN 'train' END AS layer FROM p""",
    "COR10": _PROBLEMS + "SELECT count(id) = count(DISTINCT id) AS unique_ids, count(DISTINCT CASE WHEN hint = 'seen_eval' THEN template_id END) AS seen_templates, count(DISTINCT CASE WHEN hint = 'heldout_eval' THEN family_id END) AS heldout_families FROM p",
    "COR11": _CASES.rstrip() + """, g AS (SELECT case_id, coalesce(source, 'unknown') AS s, coalesce(category, 'unknown') AS f FROM c),
r AS (SELECT case_id, row_number() OVER (PARTITION BY s, f ORDER BY sha256('7:(''' || s || ''', ''' || f || '''):' || case_id), case_id) AS r, count(*) OVER (PARTITION BY s, f) AS n FROM g)
SELECT case_id, CASE WHEN n > 1 AND r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'eval' ELSE 'train' END AS split FROM r""",
    "COR12": """WITH n AS (SELECT count(*) FILTER (o_orderstatus <> 'P') AS cur, count(*) FILTER (o_orderstatus = 'P') AS leg FROM orders), t AS (SELECT leg, CAST(ceil(cur * 0.4::DOUBLE / (1 - 0.4::DOUBLE) - 1e-9) AS BIGINT) AS t FROM n),
l AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1 AS r FROM orders WHERE o_orderstatus = 'P')
SELECT 'current' AS part, o_orderkey, 1 AS copy FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'legacy', o_orderkey, CAST(u AS INT) FROM (SELECT o_orderkey, unnest(generate_series(1, t // leg + CASE WHEN r < t % leg THEN 1 ELSE 0 END)) AS u FROM l, t)""",
    "COR13": _PROBLEMS + "SELECT id, unnest(CASE WHEN family_id = 'adjacent-gap-scan' THEN [0, 1, 2] ELSE [0] END)::INT AS focus_copy FROM p",
    "COR14": _AUDIT + "SELECT * FROM a",
    "COR15": _CASES + "SELECT lower(trim(split_hint)) AS split, count(*) AS n, sha256(string_agg(case_id, chr(10) ORDER BY case_id)) AS ids_sha256 FROM c WHERE split_hint IS NOT NULL GROUP BY 1",
    "COR15_manifest": _CASES.rstrip() + """, s AS (SELECT lower(trim(split_hint)) AS split, category, case_id FROM c WHERE split_hint IS NOT NULL),
k AS (SELECT split, category, count(*) AS n FROM s WHERE category IS NOT NULL GROUP BY 1, 2), h AS (SELECT split, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM k GROUP BY 1)
SELECT split, count(*) AS n, coalesce(any_value(categories), '') AS categories, sha256(string_agg(case_id, chr(10) ORDER BY case_id)) AS ids_sha256 FROM s LEFT JOIN h USING (split) GROUP BY 1""",
    "COR17": _CASES + "SELECT source, intended_code, count(*) AS n, count(*) FILTER (verified) AS verified FROM c GROUP BY 1, 2",
    "COR24": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77",
    "COR25": _CASES + "SELECT count(*) AS requested, count(*) FILTER (verified) AS kept, count(DISTINCT intended_code) AS codes, CAST(sum(len(observed_codes)) AS BIGINT) AS observed FROM c",
    "AGG10": _CASES + "SELECT intended_code, count(*) AS n, sha256(string_agg(case_id, chr(10) ORDER BY case_id)) AS digest FROM c GROUP BY 1",
    "JN7": _CASES + "SELECT case_id FROM c WHERE case_id NOT IN (SELECT case_id FROM trajectories WHERE outcome = 'success' AND case_id IS NOT NULL)",
    "JN8": _CASES + "SELECT case_id FROM c WHERE lower(trim(split_hint)) = 'train' AND broken NOT IN (SELECT broken FROM c WHERE lower(trim(split_hint)) <> 'train' AND broken IS NOT NULL)",
    "JN9": "SELECT count(*) AS dropped FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "JN9_kept": "SELECT c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "JN10": _PROBLEMS + "SELECT t.id AS traj_id, p.family_id FROM (SELECT DISTINCT id, case_id FROM trajectories) t JOIN p ON p.id = t.case_id",
    "HSH1": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents",
}
