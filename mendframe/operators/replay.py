"""The bounded repair loop replayed over scripted proposals, and a verification cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from mendframe.functions.patches import PatchError, apply_patch


@dataclass(frozen=True)
class LoopConfig:
    """Settings of a loop; ``overlay`` takes a recipe's own over the defaults, nulls keep what is there."""

    budget: int = 4
    frontier_budget: int = 2
    max_changed_lines: int = 60
    allow_loose: bool = True
    system_prompt: str = ""
    escalate: bool = True

    def overlay(self, **own) -> LoopConfig:
        return replace(self, **{k: v for k, v in own.items() if v is not None})


def overlaid(df: DataFrame, own: dict[str, str], base: LoopConfig = LoopConfig()) -> DataFrame:
    """``df`` with a column of each setting of ``base``, where the columns named in ``own`` take precedence unless null."""
    settings = {k: F.coalesce(own[k], F.lit(v)) if k in own else F.lit(v) for k, v in vars(base).items()}
    return df.withColumns(settings)


def ordered_map(df: DataFrame, fn: Callable[[str], str], column: str, ordinal: str, out: str = "result") -> DataFrame:
    """``df`` with ``fn`` of a column, computed over all partitions at once; ``ordinal`` still gives the order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [None if x is None else fn(x) for x in b[column]]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    if ordinal not in df.columns:
        raise ValueError(f"no column {ordinal}")
    return df.mapInPandas(run, f"{kinds}, `{out}` string")


REPLAYED = "case_id string, outcome string, attempts long, escalated boolean, steps array<struct<attempt:long,actor:string,applied:boolean,reverted:boolean,errors_before:long,errors_after:long,context:string,note:string>>, content string"


@dataclass
class Loop:
    """One episode: attempts are bounded, a patch that leaves more errors is taken back, one that leaves as many stays.

    ``verify`` counts the errors of a content and never runs it.
    """

    content: str
    verify: Callable[[str], int]
    steps: list[dict] = field(default_factory=list)
    feedback: str | None = None

    def phase(self, actor: str, proposals: list[dict], budget: int) -> str | None:
        """Outcome of a phase, or None where its budget ran out; the attempt numbers go on from earlier phases, feedback doesn't."""
        self.feedback = None
        for p in proposals[:budget]:
            errors = self.verify(self.content)
            if errors == 0:
                return "success"
            shown = self.feedback or f"{errors} errors"
            self.feedback = None
            step = {"attempt": len(self.steps), "actor": actor, "applied": False, "reverted": False, "errors_before": errors, "errors_after": None, "context": shown, "note": None}
            self.steps.append(step)
            action = (p.get("action") or "").strip().lower()
            if p.get("error"):
                step["note"] = f"model_error: {p['error']}"  # costs an attempt, the loop goes on
                continue
            if action in ("escalate", "no_fix"):
                step["note"] = action
                return action
            try:
                new = apply_patch(self.content, p.get("patch") or "", "main")[0]
            except PatchError as e:
                step["note"] = e.kind
                self.feedback = f"patch did not apply: {e.kind}"
                continue
            after = self.verify(new)
            step |= {"applied": True, "errors_after": after}
            if after > errors:
                step["reverted"] = True
                self.feedback = f"patch reverted: errors {errors} -> {after}"
            else:
                self.content = new
                if after == 0:
                    return "success"
        return "success" if self.verify(self.content) == 0 else None


def run_episode(content: str, tiny: list[dict], frontier: list[dict], verify: Callable[[str], int], budget: int = 4, frontier_budget: int = 2) -> dict:
    """Two phases: the second runs only if the first asks for it or runs out, and there are frontier proposals."""
    loop = Loop(content, verify)
    outcome = loop.phase("tiny", tiny, budget)
    escalated = outcome in (None, "escalate") and bool(frontier)
    if escalated:
        outcome = loop.phase("frontier", frontier, frontier_budget)
    return {"outcome": outcome or "escalate", "attempts": len(loop.steps), "escalated": escalated, "steps": loop.steps, "content": loop.content}


def replay(cases: DataFrame, proposals: DataFrame, verify: Callable[[str], int], budget: int = 4, frontier_budget: int = 2) -> DataFrame:
    """Episodes of ``cases`` (case_id, content) under ``proposals`` (case_id, actor, place, action, patch, error).

    Proposals of a case and actor are used in order of ``place``, which may be any sortable column, up to the budget of
    that actor's phase: places need not start at 0 and are not counted over both actors. The rest of them is cut off
    by a top-k window, which drops them before and after its shuffle,, so a hot case stays small; a case
    without proposals ends at once. ``verify`` is shipped to the executors.
    """
    limit = F.when(F.col("actor") == "tiny", budget).otherwise(frontier_budget)
    w = Window.partitionBy("case_id", "actor").orderBy("place", "patch", "action")
    numbered = proposals.where("case_id is not null and actor is not null").withColumn("_n", F.row_number().over(w))
    used = numbered.where(F.col("_n") <= max(budget, frontier_budget)).where(F.col("_n") <= limit)
    script = F.array_sort(F.collect_list(F.struct("actor", F.col("_n").alias("place"), "action", "patch", "error"))).alias("script")
    rows = cases.join(used.groupBy("case_id").agg(script), "case_id", "left").select("case_id", "content", "script")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for case, content, script in zip(b["case_id"], b["content"], b["script"]):
                steps = [dict(s) for s in script] if script is not None else []
                of = lambda a: sorted((s for s in steps if s["actor"] == a), key=lambda s: s["place"])  # noqa: B023, E731
                e = run_episode(content or "", of("tiny"), of("frontier"), verify, budget, frontier_budget)
                out.append((case, e["outcome"], e["attempts"], e["escalated"], e["steps"], e["content"]))
            yield pd.DataFrame(out, columns=["case_id", "outcome", "attempts", "escalated", "steps", "content"])

    return rows.mapInPandas(run, REPLAYED)


def verify_missing(items: DataFrame, cache: DataFrame, key: str, text: str, judge: Callable[[str], str], retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(key, status, cached) of all items, and the new rows (key, status) for the cache.

    A key in the cache is not judged again; of repeated keys the last by ``ordinal`` counts. Statuses that end in
    ``_unstable`` are judged up to ``retries`` more times. Passes and failures are both kept.
    """
    known = cache.groupBy(key).agg(F.max_by("status", "ordinal").alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                status = judge(t)
                for _ in range(retries):
                    if not status.endswith("_unstable"):
                        break
                    status = judge(t)
                out.append((k, status))
            yield pd.DataFrame(out, columns=[key, "status"])

    kind = items.schema[key].dataType.simpleString()
    missing = items.join(known, key, "left_anti").dropDuplicates([key]).select(key, text)
    fresh = missing.mapInPandas(run, f"{key} {kind}, status string")
    hits = items.select(key).distinct().join(known, key).withColumn("cached", F.lit(True))
    return hits.unionByName(fresh.withColumn("cached", F.lit(False))), fresh
