"""Explicit schemas of the record types; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


class _Schema:
    """A StructType parsed when it is asked for: parsing needs a session, importing doesn't."""

    def __init__(self, text: str):
        self.text = text

    def __call__(self) -> T.StructType:
        return T.StructType.fromDDL(self.text)


PROPOSAL = "struct<action:string,patch:string,reason:string,confidence:float>"
STEP = (
    "struct<attempt:bigint,actor:string,primary_code:string,error_count:bigint,context:string,proposal:" + PROPOSAL + ","
    "patch_applied:boolean,patch_fuzzy:boolean,error_count_after:bigint,reverted:boolean,model_latency_ms:bigint,tokens_out:bigint>"
)
MESSAGE = "struct<role:string,content:string>"
META = "struct<case_id:string,teacher_model:string,attempt:bigint,attempts:bigint,reward:double,source:string,kind:string,family_id:string,focus_copy:int,category:string,intended_code:string>"
VERDICT = "struct<passed:boolean,status:string,correct:boolean,reward:double,reference_instruction_count:bigint,candidate_instruction_count:bigint>"
VERIFICATION = "struct<status:string,method:string,harness_status:string,correct:boolean,positive_log_speedup:double,tested:bigint,reference_counts:array<bigint>,candidate_counts:array<bigint>,cache_key:string>"
DIAGNOSTIC = "struct<code:string,message:string,file:string,line_start:bigint,line_end:bigint,rendered:string>"

EPISODE_FIELDS = f"id string, created_at timestamp, case_id string, model string, command string, initial_codes array<string>, steps array<{STEP}>, outcome string, attempts bigint, escalated boolean, total_latency_ms bigint"
EPISODE = _Schema(EPISODE_FIELDS)
TEACHER_EPISODE = _Schema(EPISODE_FIELDS + ", category string, intended_code string")
EXAMPLE = _Schema(f"messages array<{MESSAGE}>, meta {META}")
EDIT_BLOCK = _Schema("file string, search string, replace string")
PATCH_ERROR = _Schema("kind string, file string, count int, changed int, cap int, detail string")
PROBLEM = _Schema(
    "schema_version int, id string, family_id string, template_id string, semantic_variant bigint, split_hint string, function_name string, reference_source string, normalized_ast_sha256 string, "
    "input_generator struct<kind:string,version:int>, edge_inputs string, benchmark_variants array<struct<id:string,inputs:string>>, benchmark_variant_ids array<string>, private_seed_policy string, verification struct<status:string,method:string>"
)
CHECKPOINT = _Schema(f"verification_key string, problem_id string, source_sha256 string, verifier_config string, verification {VERIFICATION}")
CASE = _Schema("case_id string, seed_index int, category string, intended_code string, original string, broken string, observed_codes array<string>, verified boolean")
STRUCTURAL_CASE = _Schema("case_id string, category string, broken string, fixed string, source string")
CHECK_RESULT = _Schema(f"errors array<{DIAGNOSTIC}>, warnings bigint, passed boolean")
VERIFY_STATE = _Schema("passed boolean, error_count bigint, primary_code string, codes array<string>, context string")
EVAL_ROW = _Schema("arm string, case_id string, intended_code string, category string, success boolean, attempts bigint, latency_ms bigint, escalated boolean")
SPEEDUP_ROW = _Schema(f"case_id string, family_id string, success boolean, outcome string, attempts bigint, latency_ms bigint, proposal {PROPOSAL}, parser_outcome string, verifier {VERDICT}, failure_category string")
RESUME_STATE = _Schema("case_id string, outcome string, diagnostic struct<attempts:bigint,steps:array<struct<attempt:bigint,status:string>>>")
