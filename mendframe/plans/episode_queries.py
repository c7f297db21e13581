"""Queries over repair episodes and their chats: gates, examples, evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.operators import corpus as C, evaluate as E, trajectory as J
from mendframe.plans.corpus_queries import cases, problems
from mendframe.plans.kernel_queries import read
from mendframe.sources import jsonl

SYSTEM = "Return one proposal."


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories, each once."""
    return C.once(read(spark, folder, "trajectories"), "id")


def eval_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes as evaluation rows: the arm is the model, the code that of the case."""
    c = cases(spark, folder).select("case_id", "intended_code", "category")
    t = episodes(spark, folder).select("case_id", F.col("model").alias("arm"), "id", (F.col("outcome") == "success").alias("success"), "attempts", F.col("total_latency_ms").alias("latency_ms"), "escalated")
    return t.join(c, "case_id", "left")


def event_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Events as evaluation rows: the arm is their type, a value above 30 a success."""
    return read(spark, folder, "events").select(
        F.col("event_type").alias("arm"), (F.col("value") > 30).alias("success"), F.get_json_object("props", "$.k").cast("long").alias("attempts"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"), (F.col("value") > 90).alias("escalated"),
    )


def _runs(spark, folder):
    """Two models' runs of the same cases: of each case the first episode."""
    r = C.keep_first(eval_rows(spark, folder).where("case_id is not null"), ["arm", "case_id"], "id")
    one = lambda a: r.where(F.col("arm") == a).select("case_id", "success", "attempts", "latency_ms")
    return one("nano-0.5b-r1"), one("nano-0.5b-r2")


def _chats(spark, folder):
    """Messages of each trajectory in order of attempt and arrival, as arrays; repeated ids count once."""
    m = C.once(read(spark, folder, "messages"), "message_id").where("traj_id is not null")
    role = F.lower(F.trim("role"))
    s = F.struct(F.coalesce("attempt", F.lit(-1)).alias("a"), F.col("created_at"), F.col("message_id"), role.alias("role"), F.col("content"))
    g = m.groupBy("traj_id").agg(F.array_sort(F.collect_list(s)).alias("m"))
    return g.select("traj_id", F.col("m.role").alias("roles"), F.col("m.content").alias("contents"))


def _one_verified(spark, folder):
    """The last verified problem, looked up by its id."""
    gate = problems(spark, folder).where("verification.status = 'verified'")
    wanted = gate.agg(F.max("id")).collect()[0][0]
    return jsonl.one_or_fail(gate, "id", wanted).select("id", "function_name")


def _last_steps(spark, folder):
    t = episodes(spark, folder).where("outcome <> 'success' and size(steps) > 0").withColumn("_s", J.in_order())
    s = F.get("_s", F.size("_s") - 1)
    return t.select("id", s["proposal"]["action"].alias("action"), s["proposal"]["reason"].alias("reason"), s["patch_applied"].alias("applied"), F.when(s["error_count_after"] == 0, "no_speedup").when(s["error_count_after"] > 0, "mismatch").alias("status"))


_T = "WITH t AS (SELECT * FROM trajectories QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1), c AS (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ingested_at) = 1)"
_S = _T + ", x AS (SELECT id, case_id, model, outcome, attempts, escalated, unnest(steps) AS s, generate_subscripts(steps, 1) AS i FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s.attempt, i) AS n FROM x)"
_OK = "lower(trim(s.proposal.action)) = 'patch' AND s.patch_applied AND NOT coalesce(s.reverted, false)"
_E = _T + ", e AS (SELECT t.id, t.case_id, t.model AS arm, outcome = 'success' AS success, attempts, total_latency_ms AS latency_ms, escalated, c.intended_code, c.category FROM t LEFT JOIN c USING (case_id))"
_RUNS = _E + ", f AS (SELECT * FROM e WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm, case_id ORDER BY id) = 1), a AS (SELECT * FROM f WHERE arm = 'nano-0.5b-r1'), b AS (SELECT * FROM f WHERE arm = 'nano-0.5b-r2')"
_CHATS = """WITH m AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ingested_at) = 1),
g AS (SELECT traj_id, list(lower(trim(role)) ORDER BY coalesce(attempt, -1), created_at, message_id) AS r, list(content ORDER BY coalesce(attempt, -1), created_at, message_id) AS k FROM m WHERE traj_id IS NOT NULL GROUP BY 1)
"""
_ARMS = """WITH e AS (SELECT event_type AS arm, value > 30 AS ok, CAST(props->>'k' AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS ms, value > 90 AS up FROM events),
g AS (SELECT arm, count(*) AS n, count(*) FILTER (ok) AS solved, avg(k) AS k, count(*) FILTER (up) AS escalated, list_sort(list(ms)) AS l FROM e GROUP BY 1)
SELECT arm, n, solved, round_even(solved / n, 3) AS repair_rate, round_even(k, 2) AS avg_attempts, escalated, l[CAST(floor(n * 0.5) AS INT) + 1] AS median_ms, l[CAST(floor(n * 0.95::DOUBLE) AS INT) + 1] AS p95_ms FROM g"""

QUERIES = {
    "FLT1": lambda s, d: J.verified_success(episodes(s, d), cases(s, d)).select("id"),
    "FLT2": lambda s, d: J.accepted_steps(episodes(s, d)).select("id", F.col("step.attempt").alias("attempt")),
    "FLT3": lambda s, d: J.project_allowed(problems(s, d), ["id", "family_id", "function_name", "reference_source"]),
    "FLT4": lambda s, d: J.refuse_fields(problems(s, d).select("id", "family_id"), ["private_seed_policy", "fast_source"]),
    "FLT5": lambda s, d: J.require_exact_fields(problems(s, d).select("id", "family_id"), ["id", "family_id"]),
    "FLT6": lambda s, d: J.safe_failures(episodes(s, d)).select("id", "outcome", F.size("steps").alias("n"), F.to_json(F.col("steps.primary_code")).alias("codes")),
    "FLT7": lambda s, d: eval_rows(s, d).select("id", J.positive_reward(F.col("success"), F.col("intended_code").isNotNull(), F.col("latency_ms").cast("double") - 1000).alias("positive")),
    "FLT8": lambda s, d: problems(s, d).select("id", J.known_status(F.coalesce(F.lower("hint"), F.lit("passed"))).alias("status")),
    "FLT9": lambda s, d: _last_steps(s, d).select("id", J.severity(F.col("status"), F.col("applied")).alias("severity")),
    "FLT10": lambda s, d: read(s, d, "documents").select("doc_id", J.relative_path(F.concat_ws("/", F.lit("src"), "source", "crate_name")).alias("ok")),
    "FLT11": lambda s, d: cases(s, d).select("case_id", J.mutation_valid(F.col("broken"), F.col("original")).alias("valid")),
    "FLT12": lambda s, d: cases(s, d).where(J.verify_or_discard(F.col("observed_codes"), F.col("intended_code"))).select("case_id"),
    "FLT13": lambda s, d: cases(s, d).agg(F.count_if(F.coalesce(F.size("observed_codes") > 0, F.lit(False)) & F.col("verified")).alias("kept"), F.count_if(~(F.coalesce(F.size("observed_codes") > 0, F.lit(False)) & F.col("verified"))).alias("dropped")),
    "FLT14": lambda s, d: _chats(s, d).select("traj_id", J.chat_shape(F.col("roles")).alias("ok")),
    "FLT15": lambda s, d: _chats(s, d).select("traj_id", J.chat_ends(F.col("roles"), F.col("contents")).alias("ok")),
    "FLT18": lambda s, d: episodes(s, d).select("id", E.repeatable(F.col("steps.error_count")).alias("repeatable")),
    "SRC3": lambda s, d: problems(s, d).where("verification.status = 'verified'").select("id", "function_name"),
    "SRC3_one": _one_verified,
    "SRC4": lambda s, d: J.last_in_log(episodes(s, d).where("case_id is not null").select("case_id", "id", F.struct("created_at", "id").alias("at")), "case_id", "at").select("case_id", "id"),
    "SRC5": lambda s, d: J.checked_source(problems(s, d).where(F.col("hint").startswith("train")), "train_corpus", "id", "hint", ["train_dev", "train_v2", "train_v6"]),
    "TRJ1": lambda s, d: episodes(s, d).select("id", "case_id", F.posexplode("steps").alias("place", "s")).select("id", "case_id", "place", F.col("s.attempt").alias("attempt"), F.col("s.primary_code").alias("primary_code")),
    "TRJ2": lambda s, d: J.single_turns(episodes(s, d), SYSTEM).select("id", "meta.case_id", "meta.attempt", F.size("messages").alias("n"), F.sha1(F.col("messages")[1]["content"]).alias("user_sha1")),
    "TRJ3": lambda s, d: J.repair_traces(episodes(s, d), SYSTEM).select("id", "n_steps", F.size("messages").alias("n_messages")),
    "TRJ4": lambda s, d: J.accepted_steps(episodes(s, d)).select("id", "place", F.get_json_object(J.proposal_json(F.col("step.proposal")), "$.reason").alias("reason")),
    "TRJ5": lambda s, d: J.accepted_steps(episodes(s, d)).select("id", "place", J.canonical_suffix(F.concat("step.context", F.lit(J.LEGACY_SUFFIX))).endswith(J.SUFFIX).alias("current")),
    "TRJ6": lambda s, d: J.accepted_steps(episodes(s, d)).select("id", "place", J.after_marker(F.col("step.context"), "--- slow reference ---\n").alias("source")),
    "TRJ8": lambda s, d: episodes(s, d).select(F.explode("steps").alias("s")).groupBy(J.patch_format(F.coalesce("s.proposal.patch", F.lit(""))).alias("format")).agg(F.count(F.lit(1)).alias("n")),
    "TRJ9": lambda s, d: J.solve_report(episodes(s, d)),
    "TRJ10": lambda s, d: J.outcome_tally(episodes(s, d)),
    "EVL1": lambda s, d: E.arm_summary(event_arms(s, d)),
    "EVL2": lambda s, d: E.envelope(eval_rows(s, d)),
    "EVL3": lambda s, d: E.envelope_pivot(eval_rows(s, d), ["nano-0.5b-r1", "nano-0.5b-r2", "nano-1b-r1", "frontier-x"]),
    "EVL4": lambda s, d: E.family_summary(eval_rows(s, d).withColumn("family_id", F.col("category"))),
    "EVL5": lambda s, d: _last_steps(s, d).select("id", E.failure_category(F.lower(F.trim("action")), F.col("reason"), F.col("applied"), F.col("status")).alias("category")),
    "EVL6": lambda s, d: E.category_histogram(cases(s, d), "category"),
    "EVL7": lambda s, d: E.ood_summary(eval_rows(s, d).withColumnRenamed("arm", "model")),
    "EVL8": lambda s, d: E.escalation_composite(*_runs(s, d)),
    "EVL9": lambda s, d: E.spike_gate(eval_rows(s, d).select(F.col("case_id").alias("problem_id"), F.col("success").alias("stable"), F.lit(0.5).alias("log_speedup"), F.col("escalated").alias("is_attack"), F.col("success").alias("rejected")), 12),
    "EVL10": lambda s, d: E.compare_runs(*_runs(s, d)).where("change in ('gained', 'lost')"),
    "JN12": lambda s, d: E.compare_runs(*_runs(s, d)),
    "LOOP4": lambda s, d: J.episode_defects(episodes(s, d)),
    "MTH1": lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.max(E.log_speedup(F.col("l_extendedprice"), F.col("l_quantity"))), 6).alias("best")),
    "MTH2": lambda s, d: _last_steps(s, d).select("id", E.reward(F.coalesce("status", F.lit("bridge_error")), F.col("applied"), F.lit(0.25)).alias("reward")),
    "MTH3": lambda s, d: read(s, d, "orders").groupBy("o_orderstatus").agg(F.bround(F.count_if(F.col("o_orderkey") > 1000) / F.count(F.lit(1)), 3).alias("rate")),
}
_LAST = _S + ", z AS (SELECT id, s.proposal.action AS action, s.proposal.reason AS reason, s.patch_applied AS applied, CASE WHEN s.error_count_after = 0 THEN 'no_speedup' WHEN s.error_count_after > 0 THEN 'mismatch' END AS status FROM o WHERE outcome <> 'success' QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)\n"
_P = "SELECT * FROM problems QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1"
ORACLES = {
    "FLT1": _T + " SELECT t.id FROM t JOIN c USING (case_id) WHERE outcome = 'success' AND verified",
    "FLT2": _S + f" SELECT id, s.attempt AS attempt FROM o WHERE {_OK}",
    "FLT3": f"SELECT id, family_id, function_name, reference_source FROM ({_P})",
    "FLT4": f"SELECT id, family_id FROM ({_P})",
    "FLT5": f"SELECT id, family_id FROM ({_P})",
    "FLT6": _T + " SELECT id, outcome, CAST(len(steps) AS INT) AS n, CAST(to_json(list_transform(steps, lambda x: x.primary_code)) AS VARCHAR) AS codes FROM t WHERE outcome <> 'success'",
    "FLT7": _E + " SELECT id, coalesce(success AND intended_code IS NOT NULL AND latency_ms - 1000 > 0, false) AS positive FROM e",
    "FLT8": f"SELECT id, CASE WHEN split_hint IS NULL THEN 'passed' ELSE 'bridge_error' END AS status FROM ({_P})",
    "FLT9": _LAST + "SELECT id, CASE WHEN status = 'no_speedup' AND applied THEN 1 WHEN status = 'mismatch' THEN 2 ELSE 3 END AS severity FROM z",
    "FLT10": "SELECT doc_id, NOT regexp_matches(concat_ws('/', 'src', source, crate_name), '(^|/)\\.\\.(/|$)') AS ok FROM documents",
    "FLT11": _T + " SELECT case_id, coalesce(broken <> original AND trim(broken) <> '', false) AS valid FROM c",
    "FLT12": _T + " SELECT case_id FROM c WHERE list_contains(observed_codes, intended_code)",
    "FLT13": _T + " SELECT count(*) FILTER (coalesce(len(observed_codes) > 0, false) AND verified) AS kept, count(*) FILTER (NOT (coalesce(len(observed_codes) > 0, false) AND verified)) AS dropped FROM c",
    "FLT14": _CHATS + "SELECT traj_id, coalesce(len(r) >= 3 AND regexp_full_match(array_to_string(list_transform(r, lambda x: coalesce(x, '?')), ' '), 'system( user assistant)+'), false) AS ok FROM g",
    "FLT15": _CHATS + "SELECT traj_id, coalesce(r[1] = 'system' AND r[-1] = 'assistant' AND len(list_filter(k, lambda x: x IS NULL OR x = '')) = 0, false) AS ok FROM g",
    "FLT18": _T + " SELECT id, coalesce(len(steps) >= 2 AND len(list_distinct(list_transform(steps, lambda x: coalesce(x.error_count, -1)))) = 1, false) AS repeatable FROM t",
    "SRC3": f"SELECT id, function_name FROM ({_P}) WHERE verification.status = 'verified'",
    "SRC3_one": f"SELECT id, function_name FROM ({_P}) WHERE verification.status = 'verified' AND id = (SELECT max(id) FROM problems WHERE verification.status = 'verified')",
    "SRC4": _T + " SELECT case_id, id FROM t WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, id DESC) = 1",
    "SRC5": f"SELECT count(*) AS rows, count(DISTINCT id) AS distinct_ids, bool_and(lower(trim(split_hint)) IN ('train_dev', 'train_v2', 'train_v6')) AS hints_allowed, bool_and(reference_source IS NOT NULL) AS sources_present FROM ({_P}) WHERE lower(trim(split_hint)) LIKE 'train%'",
    "TRJ1": _S + " SELECT id, case_id, CAST(i - 1 AS INT) AS place, s.attempt AS attempt, s.primary_code AS primary_code FROM o",
    "TRJ2": _S + f" SELECT id, case_id, s.attempt AS attempt, 3 AS n, sha1(s.context) AS user_sha1 FROM o WHERE {_OK}",
    "TRJ3": _S + f" SELECT id, CAST(count(*) AS INT) AS n_steps, CAST(1 + 2 * count(*) AS INT) AS n_messages FROM o GROUP BY id HAVING bool_or(s.reverted) AND arg_max(s.attempt, n) FILTER ({_OK}) >= 1",
    "TRJ4": _S + f" SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS place, coalesce(s.proposal.reason, '') AS reason FROM o WHERE {_OK}",
    "TRJ5": _S + f" SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS place, true AS current FROM o WHERE {_OK}",
    "TRJ6": _S + f" SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS place, CASE WHEN position('--- slow reference ---' || chr(10) IN s.context) > 0 THEN substr(s.context, position('--- slow reference ---' || chr(10) IN s.context) + 23) END AS source FROM o WHERE {_OK}",
    "TRJ8": _S + " SELECT CASE WHEN contains(coalesce(s.proposal.patch, ''), '<<<<<<< SEARCH') THEN 'search_replace' WHEN contains(coalesce(s.proposal.patch, ''), '@@') THEN 'unified_diff' ELSE 'other' END AS format, count(*) AS n FROM o GROUP BY 1",
    "TRJ9": _T + " SELECT attempts, count(*) AS episodes, count(*) FILTER (outcome = 'success') AS solved, count(*) FILTER (outcome = 'success' AND len(steps) > 1) AS recovered FROM t GROUP BY 1",
    "TRJ10": _T + " SELECT CASE WHEN outcome IN ('success', 'escalate', 'no_fix', 'budget_exhausted', 'error') THEN outcome ELSE 'other' END AS outcome, count(*) AS n FROM t GROUP BY 1",
    "EVL1": _ARMS,
    "EVL2": _E + " SELECT arm, coalesce(intended_code, '?') AS code, count(*) FILTER (success) AS solved, count(*) AS n, round_even(count(*) FILTER (success) / count(*), 3) AS rate FROM e GROUP BY 1, 2",
    "EVL3": _E + ", v AS (SELECT arm, coalesce(intended_code, '?') AS code, count(*) FILTER (success) || '/' || count(*) AS cell FROM e GROUP BY 1, 2) SELECT code, coalesce(max(cell) FILTER (arm = 'nano-0.5b-r1'), '-') AS \"nano-0.5b-r1\", coalesce(max(cell) FILTER (arm = 'nano-0.5b-r2'), '-') AS \"nano-0.5b-r2\", coalesce(max(cell) FILTER (arm = 'nano-1b-r1'), '-') AS \"nano-1b-r1\", coalesce(max(cell) FILTER (arm = 'frontier-x'), '-') AS \"frontier-x\" FROM v GROUP BY 1",
    "EVL4": _E + " SELECT coalesce(category, '?') AS family_id, count(*) FILTER (success) AS solved, count(*) AS n, round_even(count(*) FILTER (success) / count(*), 4) AS rate FROM e GROUP BY 1 UNION ALL SELECT '*', count(*) FILTER (success), count(*), round_even(count(*) FILTER (success) / count(*), 4) FROM e",
    "EVL5": _LAST + """SELECT id, CASE WHEN reason LIKE 'model_error%' THEN 'formatting' WHEN lower(trim(action)) IN ('no_fix', 'escalate') THEN 'missed_optimization' WHEN NOT coalesce(applied, false) THEN 'invalid_patch'
WHEN status IN ('passed', 'no_speedup') THEN 'correct_but_not_faster' WHEN status IN ('mismatch', 'candidate_error') THEN 'semantic_failure' ELSE 'missed_optimization' END AS category FROM z""",
    "EVL6": _T + " SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY 1",
    "EVL7": _E + " SELECT arm AS model, count(*) FILTER (success) AS solved, count(*) AS n, round_even(count(*) FILTER (success) / count(*), 4) AS rate FROM e GROUP BY 1",
    "EVL8": _RUNS + """ SELECT a.case_id, CASE WHEN NOT a.success AND b.attempts IS NOT NULL THEN b.success ELSE a.success END AS success, a.attempts + CASE WHEN NOT a.success AND b.attempts IS NOT NULL THEN b.attempts ELSE 0 END AS attempts,
CASE WHEN NOT a.success AND b.attempts IS NOT NULL THEN b.latency_ms ELSE a.latency_ms END AS latency_ms, a.latency_ms + CASE WHEN NOT a.success AND b.attempts IS NOT NULL THEN b.latency_ms ELSE 0 END AS total_latency_ms, NOT a.success AND b.attempts IS NOT NULL AS escalated FROM a LEFT JOIN b USING (case_id)""",
    "EVL9": _E + ", q AS (SELECT count(DISTINCT CASE WHEN NOT escalated THEN case_id END) = 12 AS complete, coalesce(bool_and(success) FILTER (NOT escalated), false) AS all_positive, coalesce(bool_and(success) FILTER (escalated), false) AS attacks_rejected FROM e) SELECT *, complete AND all_positive AND attacks_rejected AS passed FROM q",
    "EVL10": _RUNS + " SELECT case_id, CASE WHEN b.success THEN 'gained' ELSE 'lost' END AS change FROM a JOIN b USING (case_id) WHERE a.success <> b.success",
    "JN12": _RUNS + " SELECT case_id, CASE WHEN a.success IS NULL THEN 'only_after' WHEN b.success IS NULL THEN 'only_before' WHEN NOT a.success AND b.success THEN 'gained' WHEN a.success AND NOT b.success THEN 'lost' WHEN a.success THEN 'both' ELSE 'neither' END AS change FROM a FULL JOIN b USING (case_id)",
    "LOOP4": _S + f""", l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1), k AS (SELECT t.id, t.outcome, t.attempts, t.escalated, len(t.steps) AS m, l.s, coalesce(list_contains(list_transform(t.steps, lambda y: y.actor), 'frontier'), false) AS f FROM t LEFT JOIN l ON l.id = t.id)
SELECT id, 'over_budget' AS defect FROM k WHERE m > attempts UNION ALL SELECT id, 'success_unverified' FROM k WHERE outcome = 'success' AND m > 0 AND NOT coalesce({_OK}, false)
UNION ALL SELECT id, 'no_fix_without' FROM k WHERE outcome = 'no_fix' AND NOT coalesce(lower(trim(s.proposal.action)) = 'no_fix', false) UNION ALL SELECT id, 'escalated_without' FROM k WHERE escalated AND NOT f""",
    "MTH1": "SELECT l_returnflag, round(max(ln(l_extendedprice / l_quantity)), 6) AS best FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY 1",
    "MTH2": _LAST + "SELECT id, CASE WHEN status IS NULL THEN NULL WHEN NOT coalesce(applied, false) THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS reward FROM z",
    "MTH3": "SELECT o_orderstatus, round_even(count(*) FILTER (o_orderkey > 1000) / count(*), 3) AS rate FROM orders GROUP BY 1",
}
