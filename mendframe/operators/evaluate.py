"""Summaries of evaluation rows: arms, codes, families, failures, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mendframe.operators.kernels import nearest_rank


def arm_summary(rows: DataFrame) -> DataFrame:
    """arm, n, solved, repair_rate, avg_attempts, median_ms, p95_ms, escalated of each arm.

    Latencies are nearest-rank: the values at 0-based index floor(n / 2) and floor(0.95 n) among all
    rows of the arm; nulls leave the ranks. Rates are rounded half to even. Null flags count as false.
    """
    ok, up = F.coalesce("success", F.lit(False)), F.coalesce("escalated", F.lit(False))
    base = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("solved"), F.bround(F.count_if(ok) / F.count(F.lit(1)), 3).alias("repair_rate"),
        F.bround(F.avg("attempts"), 2).alias("avg_attempts"), F.count_if(up).alias("escalated"),
    )
    ranks = nearest_rank(rows, "arm", "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return base.join(ranks, "arm", "left")


def with_empty_arms(summary: DataFrame, arms: list[str]) -> DataFrame:
    """``summary`` with a row of zeros for each arm that has no rows."""
    every = summary.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    kinds = {f.name: f.dataType for f in summary.schema}
    return every.join(summary, "arm", "left").select("arm", *(F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in summary.columns if c != "arm"))


def envelope(rows: DataFrame) -> DataFrame:
    """arm, code, solved, n, rate: results by intended code, a null code as ``?``."""
    ok = F.coalesce("success", F.lit(False))
    return rows.groupBy("arm", F.coalesce("intended_code", F.lit("?")).alias("code")).agg(
        F.count_if(ok).alias("solved"), F.count(F.lit(1)).alias("n"), F.bround(F.count_if(ok) / F.count(F.lit(1)), 3).alias("rate")
    )


def envelope_pivot(rows: DataFrame, arms: list[str]) -> DataFrame:
    """One row per code and a column per arm with ``solved/n``, ``-`` where an arm lacks the code."""
    cell = F.concat_ws("/", F.first("solved"), F.first("n"))
    wide = envelope(rows).groupBy("code").pivot("arm", arms).agg(cell)
    return wide.select("code", *(F.when(F.coalesce(F.col(f"`{a}`"), F.lit("")) == "", "-").otherwise(F.col(f"`{a}`")).alias(a) for a in arms))


def family_summary(rows: DataFrame) -> DataFrame:
    """family_id, solved, n, rate of each family and, as ``*``, of all."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    out = rows.rollup("family_id").agg(ok.alias("solved"), F.count(F.lit(1)).alias("n"), F.bround(ok / F.count(F.lit(1)), 4).alias("rate"), F.grouping("family_id").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "*").otherwise(F.coalesce("family_id", F.lit("?"))).alias("family_id"), "solved", "n", "rate")


def failure_category(action: Column, reason: Column, applied: Column, status: Column) -> Column:
    """Why a proposal failed; the order of the rules matters."""
    return (
        F.when(F.coalesce(reason.startswith("model_error"), F.lit(False)), "formatting")
        .when(action.isin("no_fix", "escalate"), "missed_optimization")
        .when(~F.coalesce(applied, F.lit(False)), "invalid_patch")
        .when(status.isin("passed", "no_speedup"), "correct_but_not_faster")
        .when(status.isin("mismatch", "candidate_error"), "semantic_failure")
        .otherwise("missed_optimization")
    )


def category_histogram(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def ood_summary(rows: DataFrame) -> DataFrame:
    """model, solved, n, rate to four digits."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    return rows.groupBy("model").agg(ok.alias("solved"), F.count(F.lit(1)).alias("n"), F.bround(ok / F.count(F.lit(1)), 4).alias("rate"))


def escalation_composite(tiny: DataFrame, frontier: DataFrame) -> DataFrame:
    """Per case the tiny run, followed by the frontier run where the tiny one failed.

    Attempts add up and ``escalated`` is set where there was a second run; ``latency_ms`` is the frontier
    run's alone, ``total_latency_ms`` the sum of both. Both have case_id, success, attempts, latency_ms.
    """
    f = frontier.select("case_id", F.col("success").alias("_ok"), F.col("attempts").alias("_n"), F.col("latency_ms").alias("_ms"))
    second = ~F.coalesce("success", F.lit(False)) & F.col("_n").isNotNull()
    return tiny.join(f, "case_id", "left").select(
        "case_id", F.when(second, F.col("_ok")).otherwise(F.col("success")).alias("success"), (F.col("attempts") + F.when(second, F.col("_n")).otherwise(0)).alias("attempts"),
        F.when(second, F.col("_ms")).otherwise(F.col("latency_ms")).alias("latency_ms"), (F.col("latency_ms") + F.when(second, F.col("_ms")).otherwise(0)).alias("total_latency_ms"), second.alias("escalated"),
    )


def compare_runs(before: DataFrame, after: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, change): gained, lost, both, neither, or only in one run."""
    a, b = before.select(key, F.coalesce("success", F.lit(False)).alias("_a")), after.select(key, F.coalesce("success", F.lit(False)).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "only_after").when(F.col("_b").isNull(), "only_before").when(~F.col("_a") & F.col("_b"), "gained")
        .when(F.col("_a") & ~F.col("_b"), "lost").when(F.col("_a"), "both").otherwise("neither")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def spike_gate(reports: DataFrame, expected: int) -> DataFrame:
    """One row (complete, all_positive, attacks_rejected, passed); reports have problem_id, stable, log_speedup, is_attack, rejected.

    Without any attack nothing was rejected: false.
    """
    own = ~F.coalesce("is_attack", F.lit(False))
    good = F.coalesce(F.col("stable") & (F.col("log_speedup") > 0), F.lit(False))
    out = reports.agg(
        (F.countDistinct(F.when(own, F.col("problem_id"))) == expected).alias("complete"), F.coalesce(F.bool_and(F.when(own, good)), F.lit(False)).alias("all_positive"),
        F.coalesce(F.bool_and(F.when(~own, F.coalesce("rejected", F.lit(False)))), F.lit(False)).alias("attacks_rejected"),
    )
    return out.withColumn("passed", F.col("complete") & F.col("all_positive") & F.col("attacks_rejected"))


def log_speedup(reference: Column, candidate: Column) -> Column:
    """ln(reference / candidate) of positive counts, else null."""
    return F.when((reference > 0) & (candidate > 0), F.log(reference.cast("double") / candidate.cast("double")))


def reward(status: Column, correct: Column, speedup: Column) -> Column:
    """Null for infrastructure errors, 0 where incorrect, else the speedup if above 0, else 0."""
    return F.when(status == "bridge_error", F.lit(None).cast("double")).when(~F.coalesce(correct, F.lit(False)), 0.0).otherwise(F.greatest(F.coalesce(speedup, F.lit(0.0)), F.lit(0.0)))


def repeatable(counts: Column) -> Column:
    """At least two counts, all equal."""
    return F.coalesce((F.size(counts) >= 2) & (F.size(F.array_distinct(counts)) == 1), F.lit(False))
