"""Queries of the text, patch, JSON and program functions, sources, replay and streams, with SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.functions import jsontext as JT, patches as PT, programs as PG, text as TX
from mendframe.operators import corpus as C, replay as R, trajectory as J
from mendframe.operators.components import join_with_hot_keys
from mendframe.plans.corpus_queries import cases, problems
from mendframe.plans.episode_queries import episodes
from mendframe.plans.kernel_queries import read
from mendframe.session import Scratch
from mendframe.sources import jsonl, seeds
from mendframe.streaming import logs

MARKER = "--- src/main.rs ---\n"


def _patches(spark: SparkSession, folder: str) -> DataFrame:
    """Every proposed patch with the program it was made for, where the context shows one."""
    s = episodes(spark, folder).select("id", F.posexplode("steps").alias("place", "s")).where("lower(trim(s.proposal.action)) = 'patch'")
    source = F.coalesce(J.after_marker(F.col("s.context"), MARKER), J.after_marker(F.col("s.context"), "--- slow reference ---\n"))
    file = F.when(F.col("s.context").contains(MARKER), "src/main.rs").otherwise("candidate.py")
    return s.select("id", "place", F.col("s.proposal.patch").alias("patch"), source.alias("source"), file.alias("file"))


def _replies(spark, folder):
    m = C.once(read(spark, folder, "messages"), "message_id")
    return m.where("lower(trim(role)) in ('assistant', 'model', 'bot')").select("message_id", "content")


def _stream_lines(spark, folder):
    """A compiler's output made of the observed codes of each case, among lines that are no JSON."""
    c = cases(spark, folder).select("case_id", F.posexplode_outer("observed_codes").alias("n", "code"))
    span = F.struct(F.lit("src/main.rs").alias("file_name"), F.col("n").cast("long").alias("line_start"), F.col("n").cast("long").alias("line_end"), F.lit(True).alias("is_primary"))
    body = F.struct(F.lit("error").alias("level"), F.lit("failed").alias("message"), F.struct("code").alias("code"), F.array(span).alias("spans"))
    line = F.when(F.col("code").isNull(), F.lit("Compiling main")).otherwise(F.to_json(F.struct(F.lit("compiler-message").alias("reason"), body.alias("message"))))
    return c.select("case_id", F.coalesce("n", F.lit(0)).alias("n"), line.alias("line"))


def _brace_errors(content: str) -> int:
    """A stand-in for a verifier that runs nothing: brackets that do not pair up."""
    return sum(abs(content.count(a) - content.count(b)) for a, b in ("()", "[]", "{}"))


def _replayed(spark, folder):
    """Every episode's proposals replayed on the program it was about; ``case_id`` is the episode's id."""
    about = cases(spark, folder).select("case_id", "broken").unionByName(problems(spark, folder).select(F.col("id").alias("case_id"), F.col("reference_source").alias("broken")))
    e = episodes(spark, folder)
    c = join_with_hot_keys(e.select("id", "case_id"), about, "case_id").select(F.col("id").alias("case_id"), F.concat("broken", F.lit("\n(")).alias("content"))
    steps = e.select(F.col("id").alias("case_id"), F.posexplode("steps").alias("place", "s"))
    p = steps.select("case_id", F.coalesce("s.actor", F.lit("tiny")).alias("actor"), F.struct("s.attempt", "place").alias("place"), F.col("s.proposal.action").alias("action"), F.col("s.proposal.patch").alias("patch"), F.lit(None).cast("string").alias("error"))
    return R.replay(c, p, _brace_errors)


def _written(spark, folder):
    scratch = Scratch(spark, "jsonl")
    rows = problems(spark, folder).select("id", "family_id", "semantic_variant", "function_name")
    jsonl.create(rows, f"{scratch.root}/problems")
    return scratch, rows


def _strict(spark, folder):
    scratch, rows = _written(spark, folder)
    return jsonl.scan_strict(spark, f"{scratch.root}/problems", rows.schema).drop("file", "ordinal")


def _lenient(spark, folder):
    scratch, _ = _written(spark, folder)
    spark.range(5).select(F.lit("not json").alias("value")).write.mode("append").text(f"{scratch.root}/problems")
    return jsonl.scan_lenient(spark, f"{scratch.root}/problems", "id string, function_name string")


def _ingested(spark, folder):
    """Trajectories written as a log, streamed with their repeats, each id once."""
    scratch = Scratch(spark, "log")
    rows = read(spark, folder, "trajectories").select("id", "case_id", "outcome")
    rows.write.json(f"{scratch.root}/in")
    log = logs.read_log(spark, f"{scratch.root}/in", rows.schema)
    logs.ingest(log, "id", f"{scratch.root}/out", f"{scratch.root}/state", f"{scratch.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").join(spark.read.parquet(f"{scratch.root}/state").select("id"), "id", "left_semi").select("id", "case_id", "outcome")


def _by_functions(text: str) -> str:
    """A stand-in for a verifier that runs nothing: two functions pass, three don't, anything else stays unstable."""
    return {2: "passed", 3: "refused"}.get(text.count("def "), "late_unstable")


def _judged(spark, folder):
    p = problems(spark, folder).select("id", F.sha2("reference_source", 256).alias("key"), "reference_source")
    cache = p.where(F.col("id") < "p-8").select("key", F.lit("passed").alias("status"), F.lit(1).alias("ordinal"))
    return R.verify_missing(p, cache, "key", "reference_source", _by_functions)[0]


def _sunk(spark, folder, how: str):
    """Suppliers through a sink and back."""
    scratch = Scratch(spark, "sink")
    rows = read(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    path = f"{scratch.root}/t"
    if how == "append":
        jsonl.append(rows.where("s_nationkey < 12"), path)
        jsonl.append(rows.where("s_nationkey >= 12"), path)
    elif how == "state":
        jsonl.append_with_state(rows, rows.select("s_suppkey"), path, f"{scratch.root}/state")
        state = spark.read.schema(rows.select("s_suppkey").schema).json(f"{scratch.root}/state")
        return spark.read.schema(rows.schema).json(path).join(state, "s_suppkey", "left_semi")
    elif how == "overwrite":
        jsonl.overwrite(rows.limit(1), path)
        jsonl.overwrite(rows, path)
    elif how == "create":
        jsonl.create(rows, path)
    else:
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_nationkey").alias("nations"))
        jsonl.manifest(one, path)
        return spark.read.schema(one.schema).json(path)
    return spark.read.schema(rows.schema).json(path)


_T1 = "WITH t AS (SELECT * FROM trajectories QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1), c AS (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ingested_at) = 1), p AS (SELECT * FROM problems QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)\n"
_LINES = "SELECT case_id, CASE WHEN broken LIKE '%' || chr(10) THEN string_split(broken[:-2], chr(10)) ELSE string_split(broken, chr(10)) END AS l FROM c"
_WINDOW = "array_to_string(list_transform(range(1, least(31, len(l)) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ' | ' || l[i] || chr(10)), '')"

QUERIES = {
    "TXT1": lambda s, d: _patches(s, d).select("id", "place", PT.parse_udf("patch", "file").alias("r")).select("id", "place", F.size(F.coalesce("r.blocks", F.array().cast("array<struct<file:string,search:string,replace:string>>"))).alias("blocks"), "r.error"),
    "TXT2": lambda s, d: _patches(s, d).where("patch like '%@@%' and patch not like '%<<<<<<<%'").select("id", "place", F.explode(PT.parse_udf("patch", "file")["blocks"]).alias("b")).select("id", "place", "b.file", F.sha1("b.search").alias("search_sha1"), F.sha1("b.replace").alias("replace_sha1")),
    "TXT3": lambda s, d: _patches(s, d).select("id", "place", PT.apply_udf("source", "patch", "file").alias("r")).select("id", "place", F.sha1("r.content").alias("content_sha1"), "r.error"),
    "TXT4": lambda s, d: read(s, d, "documents").select("doc_id", TX.occurrence_count(F.col("text"), "ss").alias("n")),
    "TXT5": lambda s, d: _patches(s, d).select("id", "place", PT.apply_udf(F.regexp_replace("source", "    ", "\t"), "patch", "file").alias("r")).select("id", "place", "r.loose", "r.error"),
    "TXT6": lambda s, d: cases(s, d).select("case_id", TX.squeezed(F.col("broken")).alias("squeezed")),
    "TXT7": lambda s, d: _patches(s, d).select("id", "place", PT.apply_udf("source", "patch", "file")["blocks"].alias("blocks")).where("blocks > 1"),
    "TXT8": lambda s, d: _patches(s, d).select("id", "place", F.sha1(PT.canonical_udf("patch", "file")).alias("canonical_sha1")),
    "TXT9": lambda s, d: cases(s, d).select("case_id", TX.numbered_window(F.col("broken"), F.lit(10), F.lit(11)).alias("excerpt")),
    "TXT10": lambda s, d: cases(s, d).select("case_id", TX.diagnostic_context(F.col("intended_code"), F.col("category"), F.lit("src/main.rs"), F.lit(None).cast("string"), TX.numbered_window(F.col("broken"), F.lit(10), F.lit(11)), F.size("observed_codes") + 1).alias("context")),
    "TXT11": lambda s, d: TX.check_results(_stream_lines(s, d), "case_id", "n", "line").select("case_id", F.size("errors").alias("n_errors"), "warnings", "passed"),
    "TXT12": lambda s, d: problems(s, d).select("id", TX.model_context(F.col("family_id"), F.col("function_name"), F.lit("mismatch"), F.lit(False), F.lit(None).cast("double"), F.col("semantic_variant"), F.lit(None).cast("long"), F.col("reference_source"), F.lit("pass"), J.SUFFIX).alias("context")),
    "TXT13": lambda s, d: read(s, d, "documents").select("doc_id", TX.truncated(F.col("text"), 80).alias("short")),
    "JSN1": lambda s, d: _replies(s, d).select("message_id", F.sha1(JT.first_object_udf("content")).alias("object_sha1")),
    "JSN2": lambda s, d: _replies(s, d).select("message_id", JT.proposal_udf("content").alias("p")).select("message_id", "p.action", "p.confidence", "p.error"),
    "JSN3": lambda s, d: _replies(s, d).select("message_id", JT.any_action_udf("content").alias("action")),
    "JSN4": lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
    "JSN5": lambda s, d: problems(s, d).select("id", JT.strict_equal_udf("edge_inputs", F.regexp_replace("edge_inputs", "1", "1.0")).alias("same")),
    "FLT16": lambda s, d: problems(s, d).select("id", JT.strict_json_udf("edge_inputs").alias("strict")),
    "FLT17": lambda s, d: problems(s, d).select("id", TX.profile_column(F.concat(F.lit("events: Ir Dr\nsummary: "), (F.col("semantic_variant") + 1).cast("string"), F.lit(" 7\n"))).alias("count")),
    "UDF_policy": lambda s, d: problems(s, d).select("id", PG.policy_udf("reference_source", "function_name").alias("violation")),
    "UDF_contract": lambda s, d: _replies(s, d).select("message_id", JT.contract_udf("content").alias("ok")),
    "TRJ7": lambda s, d: _patches(s, d).withColumn("c", PT.canonical_udf("patch", "file")).select("id", "place", F.coalesce(F.col("c").isNotNull() & (PT.apply_udf("source", "patch", "file")["content"] == PT.apply_udf("source", "c", "file")["content"]), F.lit(False)).alias("proven")),
    "COR6": lambda s, d: problems(s, d).select("id", PG.fingerprint_udf("reference_source").alias("fingerprint")),
    "COR16": lambda s, d: problems(s, d).select("id", C.canonical_json_sha256("edge_inputs").alias("digest")),
    "COR18": lambda s, d: cases(s, d).where("original is not null").select("case_id", F.size(PG.mutants_udf("original")).alias("sites")),
    "COR19": lambda s, d: PG.all_mutants(cases(s, d).where("original is not null").select(F.col("case_id").alias("seed"), "original"), "seed", "original").groupBy("category", "intended_code").agg(F.count(F.lit(1)).alias("n")),
    "COR21": lambda s, d: C.ungrouped_split(cases(s, d).select("case_id"), "case_id", 0.1, 7).where("held_out").select("case_id"),
    "COR22": lambda s, d: problems(s, d).select(F.concat("id", F.lit(":"), C.canonical_json_sha256("edge_inputs")).alias("list_id")),
    "SRT3": lambda s, d: C.twister_shuffle(read(s, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 7),
    "WIN10": lambda s, d: C.capped_by_category(cases(s, d).select("category", "case_id", F.struct("created_at", "case_id").alias("at")).withColumn("at", F.concat(F.col("at.created_at").cast("string"), F.lit(" "), "at.case_id")), "category", "case_id", "at", 25, 120).select("category", "case_id"),
    "SRC1": _strict,
    "SRC2": _lenient,
    "LOOP1": lambda s, d: _replayed(s, d).select("case_id", "outcome", "attempts", "escalated"),
    "LOOP2": lambda s, d: _replayed(s, d).where("escalated").select("case_id", "attempts", F.size("steps").alias("steps")),
    "LOOP3": lambda s, d: _replayed(s, d).select("case_id", F.size(F.filter("steps", lambda x: x["reverted"])).alias("reverted"), F.size(F.filter("steps", lambda x: x["applied"])).alias("applied")),
    "LOOP6": _ingested,
    "LOOP7": lambda s, d: _judged(s, d).groupBy("status", "cached").agg(F.count(F.lit(1)).alias("n")),
    "LOOP8": lambda s, d: _judged(s, d).select("key", "status"),
    "JN11": lambda s, d: _judged(s, d).groupBy("cached").agg(F.count(F.lit(1)).alias("n")),
    "LOOP5": lambda s, d: R.overlaid(episodes(s, d).select("id", F.when(F.col("escalated"), 6).alias("budget"), F.nullif("model", F.lit("frontier-x")).alias("system_prompt"), "escalated"), {"budget": "budget", "system_prompt": "system_prompt", "escalate": "escalated"}).select("id", "budget", "frontier_budget", "max_changed_lines", "allow_loose", "system_prompt", "escalate"),
    "LOOP9": lambda s, d: R.ordered_map(read(s, d, "supplier").select("s_suppkey", "s_name"), str.lower, "s_name", "s_suppkey").select("s_suppkey", "result"),
    "SNK1": lambda s, d: _sunk(s, d, "append"),
    "SNK2": lambda s, d: _sunk(s, d, "state"),
    "SNK3": lambda s, d: _sunk(s, d, "overwrite"),
    "SNK4": lambda s, d: _sunk(s, d, "create"),
    "SNK5": lambda s, d: _sunk(s, d, "manifest"),
    "SRC6": lambda s, d: seeds.seed_programs(s),
    "COR20": lambda s, d: PG.all_mutants(seeds.seed_programs(s), "seed_index", "source").select("seed_index", "category", "intended_code", "site", "case_id"),
    "COR23": lambda s, d: seeds.batteries(s),
    "ext_tumbling": lambda s, d: logs.tumbling(read(s, d, "events"), "ts", "1 hour", "event_type", "event_id").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", "total"),
    "ext_sliding": lambda s, d: logs.sliding(read(s, d, "events"), "ts", "2 hours", "1 hour", "event_type").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n"),
    "ext_sessions": lambda s, d: logs.sessions(read(s, d, "events"), "ts", "3 hours", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")),
}
_JUDGED = _T1.rstrip() + """, q AS (SELECT id, sha256(reference_source) AS key, (length(reference_source) - length(replace(reference_source, 'def ', ''))) // 4 AS k FROM p),
j AS (SELECT DISTINCT key, key IN (SELECT key FROM q WHERE id < 'p-8') AS cached, CASE WHEN key IN (SELECT key FROM q WHERE id < 'p-8') OR k = 2 THEN 'passed' WHEN k = 3 THEN 'refused' ELSE 'late_unstable' END AS status FROM q)
"""
_OBJECTS = """WITH m AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ingested_at) = 1),
r AS (SELECT message_id, content, nullif(regexp_extract(content, '\\{.*\\}', 0, 's'), '') AS o FROM m WHERE lower(trim(role)) IN ('assistant', 'model', 'bot'))
"""
ORACLES = {
    "WIN10": _T1.rstrip() + ", r AS (SELECT category, case_id, created_at, row_number() OVER (PARTITION BY category ORDER BY created_at, case_id) AS n FROM c) SELECT category, case_id FROM (SELECT * FROM r WHERE n <= 25 ORDER BY created_at, case_id LIMIT 120)",
    "LOOP7": _JUDGED + "SELECT status, cached, count(*) AS n FROM j GROUP BY ALL",
    "LOOP8": _JUDGED + "SELECT key, status FROM j",
    "JN11": _JUDGED + "SELECT cached, count(*) AS n FROM j GROUP BY ALL",
    "JSN1": _OBJECTS + "SELECT message_id, sha1(o) AS object_sha1 FROM r",
    "JSN2": _OBJECTS + "SELECT message_id, CASE WHEN ok THEN o->>'action' END AS action, CASE WHEN ok THEN coalesce(CAST(o->>'confidence' AS DOUBLE), 0.0) END AS confidence, CASE WHEN o IS NULL THEN 'no object' WHEN NOT ok THEN 'unknown action' END AS error FROM (SELECT *, o->>'action' IN ('patch', 'no_fix', 'escalate') AS ok FROM r)",
    "JSN3": _OBJECTS + "SELECT message_id, CASE WHEN json_valid(o) THEN o->>'action' END AS action FROM r",
    "JSN5": _T1 + "SELECT id, CASE WHEN regexp_matches(edge_inputs, '1[0-9]*1') THEN NULL ELSE NOT contains(edge_inputs, '1') END AS same FROM p",
    "TXT4": "SELECT doc_id, CAST(CASE WHEN text IS NOT NULL THEN len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'ss')) END AS INT) AS n FROM documents",
    "TXT6": _T1 + "SELECT case_id, trim(regexp_replace(broken, '\\s+', ' ', 'g')) AS squeezed FROM c",
    "TXT9": _T1.rstrip() + f", l AS ({_LINES}) SELECT case_id, {_WINDOW} AS excerpt FROM l",
    "TXT10": _T1.rstrip() + f", l AS ({_LINES}) SELECT c.case_id, 'file: src/main.rs' || chr(10) || 'error[' || intended_code || ']: ' || coalesce(category, '') || chr(10) || '--- src/main.rs (context) ---' || chr(10) || {_WINDOW} || chr(10) || CASE WHEN len(observed_codes) > 0 THEN chr(10) || '(note: ' || (len(observed_codes) + 1) || ' total errors; fix this one first)' || chr(10) ELSE '' END AS context FROM c JOIN l USING (case_id)",
    "TXT11": _T1 + "SELECT case_id, CAST(coalesce(len(list_filter(observed_codes, lambda x: x IS NOT NULL)), 0) AS INT) AS n_errors, 0 AS warnings, coalesce(len(observed_codes), 0) = 0 AS passed FROM c",
    "TXT12": _T1 + f"SELECT id, 'family: ' || family_id || chr(10) || 'function: ' || function_name || chr(10) || 'status: mismatch' || chr(10) || 'correct: false' || chr(10) || 'reward: unavailable' || chr(10) || 'reference_instruction_count: ' || semantic_variant || chr(10) || 'candidate_instruction_count: unavailable' || chr(10) || '--- slow reference ---' || chr(10) || reference_source || chr(10) || '--- candidate.py ---' || chr(10) || 'pass' || '{J.SUFFIX}' AS context FROM p",
    "TXT13": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents",
    "JSN4": "SELECT event_id, props->>'k' AS k FROM events",
    "FLT16": _T1 + "SELECT id, json_valid(edge_inputs) AS strict FROM p",
    "FLT17": _T1 + "SELECT id, CASE WHEN semantic_variant + 1 > 0 THEN semantic_variant + 1 END AS count FROM p",
    "COR16": _T1 + "SELECT id, sha256(replace(edge_inputs, ' ', '')) AS digest FROM p",
    "COR22": _T1 + "SELECT id || ':' || sha256(replace(edge_inputs, ' ', '')) AS list_id FROM p",
    "SRC1": _T1 + "SELECT id, family_id, semantic_variant, function_name FROM p",
    "SRC2": _T1 + "SELECT id, function_name FROM p",
    "LOOP6": "SELECT DISTINCT id, case_id, outcome FROM trajectories",
    "COR21": _T1 + "SELECT case_id FROM c WHERE substr(sha256('7:' || case_id), 1, 8) < '1999999a'",
    "LOOP5": _T1 + "SELECT id, CASE WHEN escalated THEN 6 ELSE 4 END AS budget, 2 AS frontier_budget, 60 AS max_changed_lines, true AS allow_loose, CASE WHEN model IS NULL OR model = 'frontier-x' THEN '' ELSE model END AS system_prompt, coalesce(escalated, true) AS escalate FROM t",
    "LOOP9": "SELECT s_suppkey, lower(s_name) AS result FROM supplier",
    **{k: "SELECT s_suppkey, s_name, s_nationkey FROM supplier" for k in ("SNK1", "SNK2", "SNK3", "SNK4")},
    "SNK5": "SELECT count(*) AS n, count(DISTINCT s_nationkey) AS nations FROM supplier",
    "ext_tumbling": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT CAST(epoch(w) AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2",
    "ext_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), z AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM z GROUP BY 1",
}
