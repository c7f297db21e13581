"""Text columns: white space, windows of lines, diagnostics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def squeezed(text: Column) -> Column:
    """White space trimmed and collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    """The first n characters and ``...`` of a longer text."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def lines(text: Column) -> Column:
    """The lines of a text: a carriage return before a line feed is dropped, so is the line after a final line feed."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def numbered_window(text: Column, first: Column, last: Column, pad: int = 20) -> Column:
    """Lines ``first`` - pad to ``last`` + pad as ``   7 | line``, each ended; numbers above 9999 widen."""
    row = lambda x, i: F.concat(F.when(i + 1 < 1000, F.lpad((i + 1).cast("string"), 4, " ")).otherwise((i + 1).cast("string")), F.lit(" | "), x, F.lit("\n"))
    all_rows = F.transform(lines(text), row)
    start = F.greatest(first - pad, F.lit(1))
    count = F.greatest(F.least(last + pad, F.size(all_rows)) - start + 1, F.lit(0))
    return F.array_join(F.slice(all_rows, start, count), "")


def diagnostic_context(code: Column, message: Column, file: Column, rendered: Column, excerpt: Column, errors: Column) -> Column:
    """What a model is shown: the file, the first diagnostic, its excerpt, and how many errors there are in all."""
    plain = F.concat(F.lit("error"), F.when(code.isNotNull(), F.concat(F.lit("["), code, F.lit("]"))).otherwise(""), F.lit(": "), F.coalesce(message, F.lit("")), F.lit("\n"))
    return F.concat(
        F.when(file.isNotNull(), F.concat(F.lit("file: "), file, F.lit("\n"))).otherwise(""),
        F.when(F.coalesce(rendered, F.lit("")) != "", F.concat(rendered, F.lit("\n"))).otherwise(plain),
        F.when(file.isNotNull() & excerpt.isNotNull(), F.concat(F.lit("--- "), file, F.lit(" (context) ---\n"), excerpt, F.lit("\n"))).otherwise(""),
        F.when(errors > 1, F.concat(F.lit("\n(note: "), errors.cast("string"), F.lit(" total errors; fix this one first)\n"))).otherwise(""),
    )


def model_context(family: Column, function: Column, status: Column, correct: Column, reward: Column, reference: Column, candidate: Column, source: Column, text: Column, suffix: str) -> Column:
    """The prompt of a speed-up task; nulls among reward and counts read ``unavailable``."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unavailable"))
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    return F.concat(
        part("family", family), part("function", function), part("status", status), part("correct", correct.cast("string")), part("reward", known(reward)),
        part("reference_instruction_count", known(reference)), part("candidate_instruction_count", known(candidate)),
        F.lit("--- slow reference ---\n"), source, F.lit("\n--- candidate.py ---\n"), text, F.lit(suffix),
    )


COMPILER = "reason string, message struct<level:string,message:string,code:struct<code:string>,rendered:string,spans:array<struct<file_name:string,line_start:bigint,line_end:bigint,is_primary:boolean>>>"


def compiler_events(stream: DataFrame, line: str) -> DataFrame:
    """``stream`` with ``event``: the parsed compiler messages among its lines; anything else drops out."""
    trimmed = stream.withColumn("_t", F.trim(line)).where(F.col("_t").startswith("{"))
    parsed = trimmed.withColumn("event", F.from_json("_t", COMPILER)).drop("_t")
    return parsed.where("event.reason = 'compiler-message' and event.message is not null")


def check_results(stream: DataFrame, key: str, ordinal: str, line: str) -> DataFrame:
    """key, errors, warnings, passed: a compiler's JSON lines reduced to one row per run, errors in order.

    A diagnostic's place is its first primary span, else its first, else none with lines 0.
    """
    e = compiler_events(stream, line).select(key, ordinal, F.col("event.message").alias("m"))
    span = F.coalesce(F.get(F.filter("m.spans", lambda s: s["is_primary"]), F.lit(0)), F.get("m.spans", F.lit(0)))
    error = F.struct(
        F.col(ordinal).alias("at"), F.col("m.code.code").alias("code"), F.col("m.message").alias("message"), span["file_name"].alias("file"),
        F.coalesce(span["line_start"], F.lit(0)).alias("line_start"), F.coalesce(span["line_end"], F.lit(0)).alias("line_end"), F.coalesce("m.rendered", F.lit("")).alias("rendered"),
    )
    out = e.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("m.level") == "error", error))).alias("errors"), F.count_if(F.col("m.level") == "warning").alias("warnings"))
    out = stream.select(key).distinct().join(out, key, "left")
    empty = F.array().cast(out.schema["errors"].dataType)
    return out.select(key, F.coalesce("errors", empty).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.size(F.coalesce("errors", empty)) == 0).alias("passed"))


def lenient_json(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Lines that are JSON objects, parsed as ``value``; others are skipped."""
    t = df.withColumn("_t", F.trim(line)).where(F.col("_t").startswith("{"))
    parsed = t.withColumn("value", F.from_json("_t", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})).where("value is not null and value._bad is null")
    return parsed.withColumn("value", F.col("value").dropFields("_bad")).drop("_t")


def profile_count(text: str) -> int:
    """The instruction count of a profile with exactly one events and one summary line; anything else raises ValueError."""
    found = {"events": [], "summary": []}
    for x in text.splitlines():
        name, _, rest = x.partition(":")
        if name in found and _:
            found[name].append(rest.split())
    (events,), (summary,) = found["events"], found["summary"]  # unpacking fails unless there is one of each
    if events.count("Ir") != 1 or len(events) != len(summary):
        raise ValueError("incomplete summary")
    values = [int(x) for x in summary]
    count = values[events.index("Ir")]
    if min(values) < 0 or count <= 0:
        raise ValueError("count out of range")
    return count


def profile_column(text: Column) -> Column:
    """``profile_count`` by built-in functions, null where the profile is not to be trusted."""
    ls = F.split(F.coalesce(text, F.lit("")), "\\R")
    of = lambda name: F.filter(ls, lambda x: x.startswith(f"{name}:"))
    fields = lambda found: F.filter(F.split(F.substring_index(F.get(found, F.lit(0)), ":", -1), r"\s+"), lambda x: x != "")
    events, raw = fields(of("events")), fields(of("summary"))
    values = F.transform(raw, lambda x: x.try_cast("long"))
    count = F.get(values, F.array_position(events, "Ir").cast("int") - 1)
    sound = (F.size(of("events")) == 1) & (F.size(of("summary")) == 1) & (F.size(F.filter(events, lambda x: x == "Ir")) == 1) & (F.size(events) == F.size(raw))
    return F.when(sound & F.forall(values, lambda x: F.coalesce(x >= 0, F.lit(False))) & (count > 0), count)


def occurrence_count(text: Column, part: str) -> Column:
    """Number of occurrences of a non-empty part, overlapping ones too; null where the text is."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{part}\\E)"))
