"""Queries of the sequence kernels over the event lists of users, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mendframe.operators import kernels as K


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A list per user, in the order of events, of the number k of each event."""
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    x = F.get_json_object("props", "$.k").cast("long")
    return read(spark, folder, "events").select(F.col("user_id").alias("list_id"), pos.alias("pos"), x.alias("x"), "event_type")


def _lists(spark, folder):
    return event_lists(spark, folder).select("list_id", "pos", "x")


def _groups(spark, folder):
    return read(spark, folder, "events").select(F.col("user_id").alias("list_id")).distinct()


def _queries(spark, folder):
    return event_lists(spark, folder).select("list_id", F.col("pos").alias("q_pos"), F.pmod(F.col("x") * 7 + 3, F.lit(120)).alias("q"))


def _targets(spark, folder, c: int):
    return _groups(spark, folder).withColumn("target", F.pmod(F.col("list_id") * 13, F.lit(c)))


def _ranges(spark, folder):
    e = event_lists(spark, folder)
    n = e.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.pmod(F.col("pos") * 5 + 1, F.col("n") + 1), F.pmod(F.col("pos") * 3 + F.col("x"), F.col("n") + 1)
    return e.join(n, "list_id").select("list_id", F.col("pos").alias("q_pos"), F.least(a, b).alias("l"), F.greatest(a, b).alias("r"))


_R = """WITH r AS (SELECT user_id AS list_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(props->>'k' AS BIGINT) AS x, event_type FROM events),
g AS (SELECT DISTINCT user_id AS list_id FROM events),
q AS (SELECT list_id, pos AS q_pos, (x * 7 + 3) % 120 AS q FROM r)
"""

QUERIES = {
    "AGG1": lambda s, d: K.has_duplicate(_lists(s, d), _groups(s, d)),
    "AGG2": lambda s, d: K.distinct_cardinality(_lists(s, d), _groups(s, d)),
    "AGG3": lambda s, d: K.mode_bucket(_lists(s, d).withColumn("x", K.floor_mod(F.col("x") - 50, 17)), _groups(s, d)),
    "AGG4": lambda s, d: K.extremes(_lists(s, d), _groups(s, d)),
    "AGG5": lambda s, d: K.concatenation(event_lists(s, d).select("list_id", "pos", F.col("event_type").alias("x")), _groups(s, d)),
    "AGG6": lambda s, d: K.histogram(read(s, d, "cases").dropDuplicates(["case_id"]), "intended_code").select(F.explode("histogram").alias("code", "n")),
    "AGG7": lambda s, d: K.success_counts(read(s, d, "trajectories").dropDuplicates(["id"]), "model", F.col("outcome") == "success"),
    "AGG8": lambda s, d: K.all_and_any(read(s, d, "cases").dropDuplicates(["case_id"]), "intended_code", F.col("verified")),
    "AGG9": lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").cast("long").alias("lo"), F.max("l_quantity").cast("long").alias("hi")),
    "WIN1": lambda s, d: K.prefix_sums(_lists(s, d)),
    "WIN2": lambda s, d: K.max_window_sum(_lists(s, d), _groups(s, d).withColumn("k", F.pmod("list_id", F.lit(90)) - 1)),
    "WIN3": lambda s, d: K.range_sums(_lists(s, d), _ranges(s, d)),
    "WIN4": lambda s, d: K.frequency_index(_lists(s, d)),
    "WIN5": lambda s, d: K.stable_distinct(_lists(s, d)),
    "WIN6": lambda s, d: K.first_unique(_lists(s, d), _groups(s, d)),
    "WIN7": lambda s, d: K.subarray_sum_count(_lists(s, d), _targets(s, d, 200)),
    "WIN8": lambda s, d: K.longest_unique_span(_lists(s, d), _groups(s, d)),
    "WIN9": lambda s, d: K.round_robin(read(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 40),
    "WIN11": lambda s, d: K.nearest_rank(read(s, d, "trajectories").dropDuplicates(["id"]), "model", "total_latency_ms", {"median": 0.5, "p95": 0.95}),
    "JN1": lambda s, d: K.first_match(
        read(s, d, "orders").select(F.struct("o_orderdate", "o_orderkey").alias("pos"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")),
        read(s, d, "customer").select(F.col("c_custkey").alias("k_pos"), F.col("c_custkey").alias("key")),
    ),
    "JN2": lambda s, d: K.position_index(_lists(s, d), _queries(s, d)),
    "JN3": lambda s, d: K.count_index(_lists(s, d), _queries(s, d)),
    "JN4": lambda s, d: K.residue_count_index(_lists(s, d), _queries(s, d), 7),
    "JN5": lambda s, d: K.membership_count(_lists(s, d), _queries(s, d), _groups(s, d)),
    "JN6": lambda s, d: K.pair_sum(_lists(s, d), _targets(s, d, 260)),
    "SET1": lambda s, d: K.ordered_intersection(_lists(s, d), _queries(s, d)),
}
ORACLES = {
    "AGG1": _R + "SELECT list_id, count(DISTINCT x) <> count(x) AS has_duplicate FROM r GROUP BY list_id",
    "AGG2": _R + "SELECT list_id, count(DISTINCT x) AS n_distinct FROM r GROUP BY list_id",
    "AGG3": _R + "SELECT list_id, arg_min(m, (-c) * 1000 + m) AS mode FROM (SELECT list_id, ((x - 50) % 17 + 17) % 17 AS m, count(*) AS c FROM r GROUP BY ALL) GROUP BY list_id",
    "AGG4": _R + "SELECT list_id, min(x) AS lo, max(x) AS hi FROM r GROUP BY list_id",
    "AGG5": _R + "SELECT list_id, string_agg(event_type, '' ORDER BY pos) AS joined FROM r GROUP BY list_id",
    "AGG6": "SELECT intended_code AS code, count(DISTINCT case_id) AS n FROM cases WHERE intended_code IS NOT NULL GROUP BY 1",
    "AGG7": "SELECT model, count(*) FILTER (outcome = 'success') AS successful, count(*) AS total FROM (SELECT DISTINCT id, model, outcome FROM trajectories) GROUP BY 1",
    "AGG8": "SELECT intended_code, bool_and(verified) AS all_true, bool_or(verified) AS any_true FROM cases GROUP BY 1",
    "AGG9": "SELECT l_returnflag, CAST(min(l_quantity) AS BIGINT) AS lo, CAST(max(l_quantity) AS BIGINT) AS hi FROM lineitem GROUP BY 1",
    "WIN1": _R + "SELECT list_id, pos, CAST(sum(x) OVER (PARTITION BY list_id ORDER BY pos) AS BIGINT) AS prefix FROM r",
    "WIN2": _R + """, k AS (SELECT list_id, list_id % 90 - 1 AS k FROM g), p AS (SELECT list_id, pos + 1 AS i, sum(x) OVER (PARTITION BY list_id ORDER BY pos) AS p FROM r UNION ALL SELECT list_id, 0, 0 FROM g)
SELECT k.list_id, k.k, CAST(max(b.p - a.p) AS BIGINT) AS best FROM k LEFT JOIN p a ON a.list_id = k.list_id AND k.k >= 1 LEFT JOIN p b ON b.list_id = k.list_id AND b.i = a.i + k.k GROUP BY 1, 2""",
    "WIN3": _R + """, n AS (SELECT list_id, count(*) AS n FROM r GROUP BY 1), z AS (SELECT list_id, pos AS q_pos, least((pos * 5 + 1) % (n + 1), (pos * 3 + x) % (n + 1)) AS l, greatest((pos * 5 + 1) % (n + 1), (pos * 3 + x) % (n + 1)) AS h FROM r JOIN n USING (list_id))
SELECT z.list_id, q_pos, CAST(coalesce(sum(r.x), 0) AS BIGINT) AS total FROM z LEFT JOIN r ON r.list_id = z.list_id AND r.pos >= z.l AND r.pos < z.h GROUP BY 1, 2""",
    "WIN4": _R + "SELECT list_id, pos, count(*) OVER (PARTITION BY list_id, x) AS freq FROM r",
    "WIN5": _R + "SELECT list_id, min(pos) AS pos, x FROM r GROUP BY list_id, x",
    "WIN6": _R + ", u AS (SELECT list_id, x, min(pos) AS p FROM r GROUP BY 1, 2 HAVING count(*) = 1) SELECT g.list_id, arg_min(u.x, u.p) AS first_unique FROM g LEFT JOIN u USING (list_id) GROUP BY 1",
    "WIN7": _R + """, p AS (SELECT list_id, pos + 1 AS i, sum(x) OVER (PARTITION BY list_id ORDER BY pos) AS p FROM r UNION ALL SELECT list_id, 0, 0 FROM g)
SELECT g.list_id, (SELECT count(*) FROM p a JOIN p b ON a.list_id = b.list_id AND a.i < b.i AND b.p - a.p = g.list_id * 13 % 200 WHERE a.list_id = g.list_id) AS n FROM g""",
    "WIN8": _R + """, l AS (SELECT list_id, pos, coalesce(lag(pos) OVER (PARTITION BY list_id, x ORDER BY pos) + 1, 0) AS f FROM r), m AS (SELECT list_id, pos, max(f) OVER (PARTITION BY list_id ORDER BY pos) AS f FROM l)
SELECT list_id, max(pos - f + 1) AS longest FROM m GROUP BY 1""",
    "WIN9": "SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) ORDER BY n, o_orderpriority LIMIT 40",
    "WIN11": """WITH t AS (SELECT DISTINCT id, model, total_latency_ms AS v FROM trajectories), s AS (SELECT model, list_sort(list(v)) AS l FROM t WHERE v IS NOT NULL GROUP BY 1)
SELECT model, l[CAST(floor(len(l) * 0.5) AS INT) + 1] AS median, l[CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1] AS p95 FROM s""",
    "JN1": "SELECT c_custkey AS k_pos, c_custkey AS key, (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS value FROM customer",
    "JN2": _R + "SELECT q.list_id, q_pos, coalesce(min(r.pos), -1) AS index FROM q LEFT JOIN r ON r.list_id = q.list_id AND r.x = q.q GROUP BY 1, 2",
    "JN3": _R + "SELECT q.list_id, q_pos, count(r.pos) AS n FROM q LEFT JOIN r ON r.list_id = q.list_id AND r.x = q.q GROUP BY 1, 2",
    "JN4": _R + "SELECT q.list_id, q_pos, count(r.pos) AS n FROM q LEFT JOIN r ON r.list_id = q.list_id AND r.x % 7 = q.q % 7 GROUP BY 1, 2",
    "JN5": _R + "SELECT list_id, count(*) FILTER (EXISTS (SELECT 1 FROM q WHERE q.list_id = r.list_id AND q.q = r.x)) AS n FROM r GROUP BY 1",
    "JN6": _R + "SELECT g.list_id, EXISTS (SELECT 1 FROM r a JOIN r b ON a.list_id = b.list_id AND a.pos < b.pos AND a.x + b.x = g.list_id * 13 % 260 WHERE a.list_id = g.list_id) AS found FROM g",
    "SET1": _R + "SELECT list_id, min(pos) AS pos, x FROM r WHERE EXISTS (SELECT 1 FROM q WHERE q.list_id = r.list_id AND q.q = r.x) GROUP BY list_id, x",
}
