"""Repair episodes: quality gates, accepted steps, and training examples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The task cues that close a context, and the verifier's statuses.
LEGACY_SUFFIX = "\nRewrite candidate.py to be correct and use fewer instruction references."
SUFFIX = "\nReturn one JSON proposal with action \"patch\" and exact SEARCH/REPLACE blocks. Rewrite candidate.py to be correct and use fewer instruction references."
STATUSES = ("passed", "no_speedup", "mismatch", "candidate_error", "infrastructure_error", "bridge_error")
OUTCOMES = ("success", "escalate", "no_fix", "budget_exhausted", "error")


def action_of(step: Column) -> Column:
    return F.lower(F.trim(step["proposal"]["action"]))


def accepted(step: Column, unapplied: bool = False) -> Column:
    """A patch that was applied and not reverted; with ``unapplied`` any patch. Null flags count as false."""
    patch = F.coalesce(action_of(step) == "patch", F.lit(False))
    if unapplied:
        return patch
    return patch & F.coalesce(step["patch_applied"], F.lit(False)) & ~F.coalesce(step["reverted"], F.lit(False))


def in_order(steps: str = "steps") -> Column:
    """The steps sorted by attempt, equal attempts in the order they stand."""
    with_place = F.transform(steps, lambda s, i: F.struct(s["attempt"].alias("a"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(with_place), lambda t: t["s"])


def verified_success(trajectories: DataFrame, cases: DataFrame) -> DataFrame:
    """Successful episodes of verified cases; an episode of no case is not verified."""
    ok = cases.where(F.coalesce("verified", F.lit(False))).select("case_id").distinct()
    return trajectories.where("outcome = 'success'").join(ok, "case_id", "left_semi")


def accepted_steps(trajectories: DataFrame, unapplied: bool = False) -> DataFrame:
    """(id, case_id, model, place, step): one row per accepted step, filtered before the array is exploded."""
    kept = F.filter(in_order(), lambda s: accepted(s, unapplied))
    return trajectories.select("id", "case_id", "model", F.posexplode(kept).alias("place", "step"))


def safe_failures(trajectories: DataFrame) -> DataFrame:
    """Failed episodes without context and patch, so that no answer leaks."""
    slim = F.transform("steps", lambda s: F.struct(s["attempt"].alias("attempt"), s["primary_code"].alias("primary_code"), s["error_count"].alias("error_count"), s["error_count_after"].alias("error_count_after")))
    return trajectories.where("outcome <> 'success'").select("id", "case_id", "outcome", slim.alias("steps"))


def project_allowed(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns only; a missing one is an error."""
    if missing := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df.select(*allowed)


def refuse_fields(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """``df`` if it has none of the forbidden columns, at any depth of structs."""

    def names(schema, prefix=""):
        for f in schema.fields:
            yield f.name
            inner = getattr(f.dataType, "elementType", f.dataType)
            if hasattr(inner, "fields"):
                yield from names(inner)

    if found := sorted(set(names(df.schema)) & set(forbidden)):
        raise ValueError(f"forbidden fields: {', '.join(found)}")
    return df


def require_exact_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` if its columns are exactly ``fields``."""
    if set(df.columns) != set(fields):
        raise ValueError(f"fields differ: {sorted(set(df.columns) ^ set(fields))}")
    return df


def checked_source(df: DataFrame, name: str, key: str, hint: str, allowed: list[str]) -> DataFrame:
    """One row (rows, distinct_ids, hints_allowed, sources_present) of a guarded training table.

    A name that speaks of evaluation data, or not of training data, is refused.
    """
    low = name.lower()
    if "eval" in low or "dev_behavioral" in low or not ("train" in low or "corpus" in low):
        raise ValueError(f"not a training source: {name}")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_ids"), F.coalesce(F.bool_and(F.col(hint).isin(allowed)), F.lit(True)).alias("hints_allowed"),
        F.coalesce(F.bool_and(F.col("reference_source").isNotNull()), F.lit(True)).alias("sources_present"),
    )


def positive_reward(passed: Column, correct: Column, reward: Column) -> Column:
    """Passed, correct and of a finite reward above 0."""
    return F.coalesce(passed & correct & ~F.isnan(reward) & (reward > 0) & (reward < float("inf")), F.lit(False))


def known_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("bridge_error")


def severity(status: Column, correct: Column) -> Column:
    """0 passed, 1 no speedup (both only if correct), 2 mismatch or candidate error, 3 anything else."""
    right = F.coalesce(correct, F.lit(False))
    return F.when((status == "passed") & right, 0).when((status == "no_speedup") & right, 1).when(status.isin("mismatch", "candidate_error"), 2).otherwise(3)


def relative_path(path: Column) -> Column:
    """Whether a path is relative and never climbs."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & ~path.rlike(r"^[A-Za-z]:|\\"), F.lit(False))


def mutation_valid(broken: Column, source: Column) -> Column:
    return F.coalesce((broken != source) & (F.trim(broken) != ""), F.lit(False))


def verify_or_discard(observed: Column, intended: Column) -> Column:
    """The intended code is among the observed ones; no observed code means it passed, hence false."""
    return F.coalesce((F.size(observed) > 0) & F.array_contains(observed, intended), F.lit(False))


# --- chats -----------------------------------------------------------------------------------------


def chat_shape(roles: Column) -> Column:
    """At least three messages, system first, assistant last, user and assistant in strict alternation between."""
    rest = F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(1)))
    alternate = F.forall(F.transform(rest, lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    return F.coalesce((F.size(roles) >= 3) & (F.get(roles, 0) == "system") & (F.get(roles, F.size(roles) - 1) == "assistant") & alternate, F.lit(False))


def chat_ends(roles: Column, contents: Column) -> Column:
    """The weaker check: system first, assistant last, all contents present."""
    return F.coalesce((F.get(roles, 0) == "system") & (F.get(roles, F.size(roles) - 1) == "assistant") & F.forall(contents, lambda c: c.isNotNull() & (c != "")), F.lit(False))


def proposal_json(p: Column) -> Column:
    """A proposal as JSON text; a null reason is empty, a null confidence 0."""
    return F.to_json(F.struct(p["action"].alias("action"), F.coalesce(p["patch"], F.lit("")).alias("patch"), F.coalesce(p["reason"], F.lit("")).alias("reason"), F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence")))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def single_turns(trajectories: DataFrame, system: str) -> DataFrame:
    """One example per accepted step: system, its context, its proposal; with meta."""
    s = accepted_steps(trajectories)
    meta = F.struct("case_id", F.col("model").alias("teacher_model"), F.col("step.attempt").alias("attempt"), F.lit("single").alias("kind"))
    messages = F.array(_message("system", F.lit(system)), _message("user", F.col("step.context")), _message("assistant", proposal_json(F.col("step.proposal"))))
    return s.select("id", messages.alias("messages"), meta.alias("meta"))


def repair_traces(trajectories: DataFrame, system: str) -> DataFrame:
    """All steps as turns, of episodes with a reverted step whose last accepted attempt is not the first."""
    steps = trajectories.withColumn("_s", in_order()).withColumn("_ok", F.filter("_s", lambda s: accepted(s)))
    last = F.get("_ok", F.size("_ok") - 1)["attempt"]
    kept = steps.where(F.exists("_s", lambda s: F.coalesce(s["reverted"], F.lit(False))) & (last >= 1))
    turns = F.flatten(F.transform("_s", lambda s: F.array(_message("user", s["context"]), _message("assistant", proposal_json(s["proposal"])))))
    return kept.select("id", F.concat(F.array(_message("system", F.lit(system))), turns).alias("messages"), F.size("_s").alias("n_steps"))


def canonical_suffix(context: Column, strict: bool = True) -> Column:
    """A context that ends in the legacy cue ends in the current one instead; no cue raises, or is null if not ``strict``."""
    cut = lambda tail: F.substring(context, F.lit(1), F.length(context) - len(tail))
    miss = F.raise_error(F.lit("context has no known cue")) if strict else F.lit(None)
    return F.when(context.endswith(SUFFIX), context).when(context.endswith(LEGACY_SUFFIX), F.concat(cut(LEGACY_SUFFIX), F.lit(SUFFIX))).otherwise(miss.cast("string"))


def after_marker(context: Column, marker: str, suffix: str = "") -> Column:
    """What follows the first ``marker``, less a closing ``suffix``; null without marker."""
    at = F.locate(marker, context)
    rest = F.substring(context, at + len(marker), F.length(context))
    rest = F.when(rest.endswith(suffix), F.substring(rest, F.lit(1), F.length(rest) - len(suffix))).otherwise(rest) if suffix else rest
    return F.when(at > 0, rest)


def patch_format(patch: Column) -> Column:
    return F.when(patch.contains("<<<<<<< SEARCH"), "search_replace").when(patch.contains("@@"), "unified_diff").otherwise("other")


def outcome_tally(trajectories: DataFrame) -> DataFrame:
    """(outcome, n) with every unknown or null outcome as ``other``."""
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("other")
    return trajectories.groupBy(known.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def solve_report(trajectories: DataFrame) -> DataFrame:
    """(attempts, episodes, solved, recovered): recovered episodes succeed after more than one step."""
    won = F.coalesce(F.col("outcome") == "success", F.lit(False))
    return trajectories.groupBy("attempts").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(won).alias("solved"), F.count_if(won & (F.size("steps") > 1)).alias("recovered"))


def last_in_log(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("_r")).select("_r.*")


def episode_defects(trajectories: DataFrame) -> DataFrame:
    """(id, defect) of recorded episodes that break the loop's rules.

    over_budget: more steps than attempts; success_unverified: success whose last step left errors or was no accepted
    patch; no_fix_without: outcome no_fix whose last step proposes something else; escalated_without:
    escalated without a frontier step.
    """
    last = F.get("_s", F.size("_s") - 1)
    t = trajectories.withColumn("_s", in_order()).withColumn("_l", last)
    rules = {
        "over_budget": F.size("_s") > F.col("attempts"),
        "success_unverified": (F.col("outcome") == "success") & (F.size("_s") > 0) & ~accepted(F.col("_l")),
        "no_fix_without": (F.col("outcome") == "no_fix") & ~F.coalesce(F.lower(F.trim(F.col("_l.proposal.action"))) == "no_fix", F.lit(False)),
        "escalated_without": F.col("escalated") & ~F.exists("_s", lambda s: F.coalesce(s["actor"] == "frontier", F.lit(False))),
    }
    flags = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return t.select("id", F.explode(flags).alias("defect"))
