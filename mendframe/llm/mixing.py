"""Documents drawn from several sources so that each has its target share of all tokens."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mendframe.llm.encode import FOLDER, encode
from mendframe.llm.records import table, tidy
from mendframe.session import Scratch

#: Steps of the priority histogram by which each source's cut is found.
STEPS = 4096
ROUNDS = 200


def source_form(c: str) -> Column:
    """A source as it is compared: trimmed, lower case, ``-`` read as ``_``."""
    return F.translate(tidy(c), "-", "_")


def language_form(c: str) -> Column:
    """Two lower-case letters, else ``und``: at most 677 values whatever the column holds."""
    x = tidy(c)
    return F.when(x.rlike("^[a-z]{2}$"), x).otherwise("und")


def topic(text: str) -> Column:
    """What a text mostly is: code, table, report (with headings) or prose."""
    t = F.col(text)
    return F.when(t.contains("```"), "code").when(t.rlike("[│|].*[│|]"), "table").when(t.rlike("(?m)^#+ "), "report").otherwise("prose")


def rake(tokens: np.ndarray, targets: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Cell totals near every margin, none above ``cap``: iterative proportional fitting.

    ``targets`` has (group of each cell, total of each group); the last is kept best, as it is fitted last in each round.
    Where a cap stops a cell, its group's other cells take the rest as far as they can.
    """
    x = tokens.astype(float).copy()
    for _ in range(rounds):
        before = x.copy()
        for group, want in targets:
            full = np.zeros(len(x), bool)
            while True:  # cells that would pass their cap are set to it, the rest of the group scales
                fixed = np.bincount(group[full], cap[full], len(want))
                loose = np.bincount(group[~full], x[~full], len(want))
                scale = np.divide(np.maximum(want - fixed, 0), loose, out=np.ones(len(want)), where=loose > 0)
                y = np.where(full, cap, x * scale[group])
                more = ~full & (y > cap)
                if not more.any():
                    break
                full |= more
            x = y
        if np.abs(x - before).max(initial=0) <= 1e-9 * max(x.max(initial=0), 1):
            break
    return x


def plan(cells: list[tuple[str, str, str, float]], targets: dict[str, tuple[float, int]]) -> tuple[list[tuple[str, str, str, int, float]], dict[str, float]]:
    """((source, lang, topic, whole copies, share of one more) of each cell, tokens wanted of each source).

    The total is the largest at which every source that has text can give its share within its
    repeats; shares of sources without text fall to the others in proportion. Within that the
    weights are raked to the languages and topics of the whole corpus, and to sources last.
    """
    names = sorted(s for s, (p, m) in targets.items() if p > 0 and m > 0)
    mine = [(s, g, t, n) for s, g, t, n in cells if s in names and n > 0]
    have: dict[str, float] = {}
    for s, _, _, n in mine:
        have[s] = have.get(s, 0) + n
    share = sum(targets[s][0] for s in have)
    if not share:
        return [], {}
    total = min(n * targets[s][1] / (targets[s][0] / share) for s, n in have.items())
    tokens = np.array([n for *_, n in mine], float)
    cap = tokens * np.array([targets[s][1] for s, *_ in mine])

    def margin(k: int, whole: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        values = sorted({c[k] for c in mine})
        at = np.array([values.index(c[k]) for c in mine])
        want = np.array([whole.get(v, 0.0) for v in values])
        return at, want / max(want.sum(), 1e-12) * total

    corpus: list[dict[str, float]] = [{}, {}]
    for _, g, t, n in cells:
        corpus[0][g] = corpus[0].get(g, 0) + n
        corpus[1][t] = corpus[1].get(t, 0) + n
    fitted = rake(tokens, [margin(1, corpus[0]), margin(2, corpus[1]), margin(0, {s: targets[s][0] for s in have})], cap)
    weight = np.minimum(fitted / tokens, cap / tokens)
    out = []
    for (s, g, t, _), w in zip(mine, weight):
        most = targets[s][1]
        base = min(int(math.floor(w + 1e-9)), most)
        out.append((s, g, t, base, float(min(max(w - base, 0), 1)) if base < most else 0.0))
    return out, {s: targets[s][0] / share * total for s in have}


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, name: str = "mixing") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((mix_name, doc_id, source, lang, topic, tokens, copies), report per mix_name and source, margins of languages and topics).

    Sizes are tokens of the public tokenizer over whole texts. Each document is taken the whole number of times its
    cell's weight says; one more copy goes to documents in the order of a hash over the
    rest of the weight (sequential Poisson sampling) until the source has its tokens, which leaves an
    error of half a document. Documents of null source, or without tokens, are never drawn but
    nothing else is left out. A source without text reports zero; a mix of none selects nothing.
    The targets are a fixed small table: at most (sources x 677 languages x 4 topics) cells reach the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_name", source_form("source").alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null").collect():
        p, m = wanted.setdefault(r["mix_name"], {}).get(r["source"], (0.0, 0))
        wanted[r["mix_name"]][r["source"]] = (p + float(r["target_share"] or 0), max(m, int(r["max_repeats"] or 0)))
    ids = encode(docs.select("doc_id", "text"), name=tokenizer, folder=folder, scratch_name=f"{name}_encode").select("doc_id", F.size("ids").alias("tokens"))
    traits = docs.select("doc_id", source_form("source").alias("source"), language_form("lang").alias("lang"), topic("text").alias("topic")).where("source is not null")
    named = sorted({s for m in wanted.values() for s in m})
    sized = scratch.write(traits.join(ids, "doc_id").where("tokens > 0"), "sized")
    other = F.when(F.col("source").isin(named), F.col("source")).otherwise("") if named else F.lit("")
    cells = [tuple(r) for r in sized.groupBy(other.alias("source"), "lang", "topic").agg(F.sum("tokens").cast("double").alias("n")).collect()]
    rows, goals = [], []
    for m, t in sorted(wanted.items()):
        weights, need = plan(cells, t)
        rows += [(m, *w) for w in weights]
        goals += [(m, s, n) for s, n in need.items()]
    weights = spark.createDataFrame(rows, "mix_name string, source string, lang string, topic string, base int, more double")
    drawn = sized.join(F.broadcast(weights), ["source", "lang", "topic"])
    u = (F.pmod(F.xxhash64("mix_name", "doc_id"), F.lit(1 << 40)) + 1) / float(1 << 40)
    order = F.when(F.col("more") > 0, u / F.col("more"))
    drawn = drawn.withColumn("order", order).withColumn("step", F.least(F.floor(F.col("order") * (STEPS / 4)), F.lit(STEPS)).cast("int"))
    drawn = scratch.write(drawn, "drawn")
    # Where each source's cut falls: tokens of its copies and of each step, at most STEPS rows a source.
    base = {(r[0], r[1]): float(r[2] or 0) for r in drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("base"))).collect()}
    steps: dict[tuple[str, str], list[tuple[int, float]]] = {}
    for m, s, k, n in drawn.where("step is not null").groupBy("mix_name", "source", "step").agg(F.sum("tokens").cast("double")).collect():
        steps.setdefault((m, s), []).append((k, n))
    cuts = []
    for m, s, goal in goals:
        left, at = goal - base.get((m, s), 0.0), -1
        for k, n in sorted(steps.get((m, s), [])):
            at = k
            if n >= left:
                break
            left -= n
        else:
            at, left = STEPS + 1, 0.0
        cuts.append((m, s, at, float(max(left, 0))))
    cut = spark.createDataFrame(cuts, "mix_name string, source string, cut int, rest double")
    placed = drawn.join(F.broadcast(cut), ["mix_name", "source"])
    # The step of the cut is counted again in as many finer ones, so only one in STEPS * STEPS documents is ordered one by one.
    fine = F.least(F.floor((F.col("order") * (STEPS / 4) - F.col("cut")) * STEPS), F.lit(STEPS - 1)).cast("int")
    placed = placed.withColumn("fine", F.when(F.col("step") == F.col("cut"), F.greatest(fine, F.lit(0))))
    finer: dict[tuple[str, str], list[tuple[int, float]]] = {}
    for m, s, k, n in placed.where("fine is not null").groupBy("mix_name", "source", "fine").agg(F.sum("tokens").cast("double")).collect():
        finer.setdefault((m, s), []).append((k, n))
    ends = []
    for m, s, _, left in cuts:
        at = STEPS
        for k, n in sorted(finer.get((m, s), [])):
            at = k
            if n >= left:
                break
            left -= n
        else:
            at, left = STEPS, 0.0
        ends.append((m, s, at, left))
    end = spark.createDataFrame(ends, "mix_name string, source string, fine_cut int, fine_rest double")
    placed = placed.join(F.broadcast(end), ["mix_name", "source"])
    w = Window.partitionBy("mix_name", "source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = placed.where("fine = fine_cut").withColumn("_sum", F.sum("tokens").over(w))
    on = on.withColumn("copies", F.col("base") + (F.col("_sum") - F.col("tokens") / 2 <= F.col("fine_rest")).cast("int")).drop("_sum")
    before = (F.col("step") < F.col("cut")) | F.coalesce(F.col("fine") < F.col("fine_cut"), F.lit(False))
    off = placed.where("fine is null or fine <> fine_cut").withColumn("copies", F.col("base") + F.coalesce(before.cast("int"), F.lit(0)))
    chosen = scratch.write(off.unionByName(on).where("copies > 0").select("mix_name", "doc_id", "source", "lang", "topic", F.col("tokens").cast("long").alias("tokens"), "copies"), "chosen")
    asked = spark.createDataFrame([(m, s, p, k) for m, t in wanted.items() for s, (p, k) in t.items()], "mix_name string, source string, target_share double, max_repeats int")
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("available_documents"), F.sum("tokens").alias("available_tokens"))
    got = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = chosen.groupBy("mix_name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all"))
    report = asked.join(there, "source", "left").join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("available_documents", "available_tokens", "documents", "tokens", "most_copies")),
        F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"),
    )
    # Margins of languages and topics: the corpus's, those of the raked weights, and those drawn.
    planned = drawn.withColumn("_w", F.col("tokens") * (F.col("base") + F.col("more")))
    margins = reduce(DataFrame.unionByName, (_margin(k, sized, planned, chosen) for k in ("lang", "topic")))
    return chosen, report, margins


def _margin(k: str, sized: DataFrame, planned: DataFrame, chosen: DataFrame) -> DataFrame:
    """mix_name, margin, value and its share of the tokens of the corpus, of the raked weights and of the mix, of one margin."""
    share = lambda n, *by: F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    goal = sized.groupBy(k).agg(F.sum("tokens").alias("n")).select(k, share("n", F.lit(1)).alias("target_share"))  # at most 677 values
    plan_ = planned.groupBy("mix_name", k).agg(F.sum("_w").alias("n")).select("mix_name", k, share("n", "mix_name").alias("planned_share"))
    got = chosen.groupBy("mix_name", k).agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).select("mix_name", k, share("n", "mix_name").alias("actual_share"))
    out = plan_.join(got, ["mix_name", k], "left").join(goal, k)
    return out.select("mix_name", F.lit({"lang": "language"}.get(k, k)).alias("margin"), F.col(k).alias("value"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("target_share", "planned_share", "actual_share")))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p7_selected(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), name="mixing_selected")[0].drop("lang", "topic")


def p7_margins(spark: SparkSession, folder: str) -> DataFrame:
    """How near each mix comes to the corpus's shares of languages and topics, which are fitted before its sources."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), name="mixing_margins")[2]


def p7_sound(spark: SparkSession, folder: str) -> DataFrame:
    """For each source of each mix what must hold however it is drawn: no document more often than allowed, none without text, shares that sum to 1."""
    report = mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), name="mixing_sound")[1]
    whole = F.round(F.sum("actual_share").over(Window.partitionBy("mix_name")), 4)
    return report.select("mix_name", "source", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), ((F.col("available_tokens") > 0) | (F.col("tokens") == 0)).alias("from_text"), whole.alias("shares"))


QUERIES = {"p7_report": p7_report, "p7_selected": p7_selected, "p7_margins": p7_margins, "p7_sound": p7_sound}
ORACLES: dict[str, str] = {
    "p7_sound": "SELECT mix_name, replace(lower(trim(source)), '-', '_') AS source, max(max_repeats) AS max_repeats, true AS within_repeats, true AS from_text, 1.0::DOUBLE AS shares FROM mix_targets GROUP BY 1, 2"
}
