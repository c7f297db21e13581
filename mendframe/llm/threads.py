"""Ordered conversations from chat messages that are stored one to a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mendframe.llm.records import table
from mendframe.llm.setjoin import _ints
from mendframe.llm.shingles import slices, word_hashes, words_with
from mendframe.operators.components import hot_keys, join_with_hot_keys
from mendframe.session import Scratch

SPEAKERS = {
    "system": ["system", "sys", "developer", "dev", "instruction", "instructions"],
    "user": ["user", "usr", "human", "person", "customer", "client", "prompter", "asker"],
    "assistant": ["assistant", "asst", "model", "bot", "chatbot", "ai", "llm", "agent", "gpt"],
}
#: White space, control and format characters, and the blank letters of some scripts.
INVISIBLE = "\\s\\p{Z}\\p{Cc}\\p{Cf}\\u2800\\u3164\\uffa0\\u115f\\u1160\\u034f\\ufe00-\\ufe0f"
#: Bits of the sketches of a message's words and of its names.
WORD_BITS, NAME_BITS = 512, 64
SKETCH = [f"w{i}" for i in range((WORD_BITS + NAME_BITS) // 64)]
#: Attempts of a trajectory that are linked in one group, and how many turns such a group can have at most: any more
#: than two an attempt break the conversation, so beyond this nothing has to be linked.
BLOCK, FULL = 256, 1 << 16
#: How far from a turn, in order of attempt and in order of time, the turns lie that may be its parent.
REACH = 4
#: What a link is worth: equal attempts, unknown ones, time, shared names, shared words; and a beginning without parent.
AGREE, UNKNOWN, TIME, NAMES, WORDS, ROOT = 4.0, 1.0, 0.5, 0.3, 0.2, 0.95
NONE = -(1 << 62)


def speaker(role: str) -> Column:
    """system, user or assistant under any case, padding, punctuation or synonym; else null."""
    word = F.lower(F.regexp_replace(F.col(role), "[^\\p{L}]", ""))
    out = F.when(word.isin(SPEAKERS["system"]), "system").when(word.isin(SPEAKERS["user"]), "user")
    return out.when(word.isin(SPEAKERS["assistant"]), "assistant")


def blank(text: str) -> Column:
    """True where nothing of a text can be seen."""
    return F.coalesce(~F.col(text).rlike(f"[^{INVISIBLE}]"), F.lit(True))


def sketched(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` replaced by sketches of all its words and of its names (words with ``_``): one bit of each that occurs."""
    names = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + "".join(f", {c} long" for c in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw in slices(batches, text):
            at, h = word_hashes(offsets, raw)
            named = words_with(ord("_"), offsets, raw)
            bits = np.zeros((rows.num_rows, WORD_BITS + NAME_BITS), bool)
            bits[at, (h % np.uint64(WORD_BITS)).astype(np.int64)] = True
            bits[at[named], WORD_BITS + (h[named] >> np.uint64(32)).astype(np.int64) % NAME_BITS] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], [*names, *SKETCH])

    return df.mapInArrow(run, schema)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared bits of two arrays of sketches over those of the smaller."""
    ones = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    return ones(a & b) / np.maximum(np.minimum(ones(a), ones(b)), 1)


class Turns:
    """Turns of whole groups as arrays: group, who (0 user, 1 assistant), attempt, msg, time (``NONE`` where unknown), sketch."""

    def __init__(self, group: np.ndarray, who: np.ndarray, attempt: np.ndarray, msg: np.ndarray, time: np.ndarray, sketch: np.ndarray):
        self.group, self.who, self.attempt, self.msg, self.time, self.sketch = group, who, attempt, msg, time, sketch

    def scores(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What each link of a child to a parent is worth.

        Attempts that agree (a reply has its prompt's, a prompt the one after the reply it follows) count most; where
        either is unknown a parent that isn't later counts a little (without times, only a reply's). Time falls with the gap.
        """
        ac, ap, tc, tp = self.attempt[c], self.attempt[p], self.time[c], self.time[p]
        timed = (tc != NONE) & (tp != NONE)
        before = np.where(timed, tp <= tc, self.who[c] == 1)
        agree = AGREE * (ap == ac - (self.who[c] == 0))
        base = np.where((ac != NONE) & (ap != NONE), agree, UNKNOWN * before)
        gap = np.abs(np.where(timed, tc - tp, 0)) / 6e7
        near = np.where(timed, TIME * np.where(before, 1.0, 0.5) / (1 + gap), 0.0)
        words = WORD_BITS // 64
        return base + near + NAMES * _overlap(self.sketch[c, words:], self.sketch[p, words:]) + WORDS * _overlap(self.sketch[c, :words], self.sketch[p, :words])

    def parents(self) -> np.ndarray:
        """The likeliest parent of each turn, by place; -1 for a beginning. Ties go to the least msg."""
        n = len(self.group)
        children, above = [], []
        for order in (np.lexsort((self.msg, self.who, self.attempt, self.group)), np.lexsort((self.msg, self.who, self.time, self.group))):
            for d in range(1, REACH + 1):
                i, j = order[:-d], order[d:]
                ok = (self.group[i] == self.group[j]) & (self.who[i] != self.who[j])
                children += [i[ok], j[ok]]
                above += [j[ok], i[ok]]
        first = np.flatnonzero(self.who == 0)  # a prompt may begin its conversation
        c, p = np.concatenate([*children, first]), np.concatenate([*above, np.full(len(first), -1)])
        root = np.where(self.attempt[c] == NONE, ROOT, np.where(self.attempt[c] == 0, AGREE + ROOT, 0.0))
        score = np.where(p < 0, root, self.scores(c, p) if n else 0.0)
        order = np.lexsort((np.where(p < 0, NONE, self.msg[p]), -score, c))
        c, p = c[order], p[order]
        out = np.full(n, -1)
        best = np.ones(len(c), bool)
        best[1:] = c[1:] != c[:-1]
        out[c[best]] = p[best]
        return out

    def mended(self, parent: np.ndarray) -> np.ndarray:
        """Attempts by the links where they are unknown or don't follow from the parent's; ``NONE`` where those are unknown too."""
        up = np.maximum(parent, 0)
        out = np.where((parent < 0) & (self.who == 0) & (self.attempt == NONE), 0, self.attempt)
        for _ in range(2 * REACH):
            want = np.where(out[up] == NONE, NONE, out[up] + (self.who == 0))
            new = np.where(parent < 0, out, np.where(want == NONE, out, want))
            if (new == out).all():
                break
            out = new
        return out


LINKED = "traj_id string, who byte, attempt long, mended long, msg long, parent long, kids int, straight boolean, sound boolean, lost boolean, blank boolean, ghost boolean, full boolean"


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of whole groups, sorted by (g, g2), in; every turn once, with its link, out."""
    held: pa.Table | None = None
    schema = None

    def solve(x: pa.Table) -> pa.RecordBatch:
        col = {c: x.column(c).to_numpy() for c in ("g", "g2", "who", "attempt", "c1", "c2", "msg", "time", "blank", "ghost")}
        order = np.lexsort((col["msg"], col["c2"], col["c1"], col["who"], col["attempt"], col["ghost"], col["g2"], col["g"]))
        same = ["g", "g2", "ghost", "attempt", "who", "c1", "c2"]
        first = np.ones(len(order), bool)
        first[1:] = np.any([col[c][order[1:]] != col[c][order[:-1]] for c in same], axis=0)
        order = order[first]  # a lost attempt that was found again may repeat a turn
        col = {k: v[order] for k, v in col.items()}
        new = np.ones(len(order), bool)
        new[1:] = (col["g"][1:] != col["g"][:-1]) | (col["g2"][1:] != col["g2"][:-1])
        group = np.cumsum(new) - 1
        words = np.stack([x.column(c).to_numpy()[order] for c in SKETCH], 1).view(np.uint64)
        n = len(order)
        said = np.flatnonzero(col["who"] < 2)
        t = Turns(group[said], col["who"][said].astype(np.int64), col["attempt"][said], col["msg"][said], col["time"][said], words[said])
        parent = t.parents()
        ghost = col["ghost"][said].astype(bool)
        mended, up = t.mended(parent), np.maximum(parent, 0)
        follows = lambda a: np.where(parent < 0, (t.who == 0) & (a == 0), (a != NONE) & (a[up] != NONE) & (a == a[up] + (t.who == 0)))
        linked = (parent >= 0) & ~ghost
        full = lambda value, kind: np.full(n, value, kind)
        out = {"mended": full(NONE, np.int64), "parent": full(NONE, np.int64), "kids": full(0, np.int32), "straight": full(True, bool), "sound": full(True, bool)}
        out["mended"][said] = mended
        out["parent"][said] = np.where(parent < 0, NONE, t.msg[up])
        out["kids"][said] = np.bincount(parent[linked], minlength=len(said))
        out["straight"][said] = follows(t.attempt) | ghost
        out["sound"][said] = follows(mended) | ghost
        ints = lambda v: pa.array(v, mask=v == NONE)
        cols = [
            x.column("traj_id").combine_chunks().take(pa.array(order)), pa.array(col["who"].astype(np.int8)), ints(col["attempt"]), ints(out["mended"]), ints(col["msg"]), ints(out["parent"]), pa.array(out["kids"]),
            pa.array(out["straight"]), pa.array(out["sound"]), pa.array((col["who"] < 2) & (col["attempt"] == NONE)), pa.array(col["blank"].astype(bool)), pa.array(col["ghost"].astype(bool)), pa.array(np.zeros(n, bool)),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINKED.split(", ")])

    def overfull(x: pa.Table) -> pa.RecordBatch:
        row = {"traj_id": x.column("traj_id")[0].as_py(), "who": 0, "full": True}
        kinds = {"string": pa.string(), "byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([row.get(c)], kinds[k]) for c, k in (f.split() for f in LINKED.split(", "))], [f.split()[0] for f in LINKED.split(", ")])

    skip = None  # the group whose rows are no longer looked at
    for batch in batches:
        x = pa.Table.from_batches([batch])
        if schema is None:
            schema = x.schema
        if skip is not None:
            keep = (_ints(batch, "g") != skip[0]) | (_ints(batch, "g2") != skip[1])
            x = x.filter(pa.array(keep))
            skip = None if keep.any() else skip
        held = x if held is None else pa.concat_tables([held, x])
        if not held.num_rows:
            continue
        g, g2 = held.column("g").to_numpy(), held.column("g2").to_numpy()
        last = (g == g[-1]) & (g2 == g2[-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield solve(held.slice(0, cut))
            held = held.slice(cut)
        if held.num_rows > FULL:
            skip = (g[-1], g2[-1])
            yield overfull(held)
            held = held.slice(0, 0)
    if held is not None and held.num_rows:
        yield solve(held)


def turns_of(messages: DataFrame, trajectories: DataFrame, scratch: Scratch) -> DataFrame:
    """traj_id, attempt, who, c1, c2, msg, time, blank and sketches of every turn: rows equal in trajectory, attempt, speaker and content are one.

    A user row without attempt has that of the step of its trajectory whose context it repeats; such a turn may come twice.
    """
    who = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2).cast("byte")
    rows = messages.select("message_id", "traj_id", F.col("attempt").cast("long").alias("attempt"), speaker("role").alias("speaker"), "content", F.unix_micros("created_at").alias("time"))
    rows = rows.where("speaker is not null and traj_id is not null")
    rows = rows.select("message_id", "traj_id", "attempt", who.alias("who"), "time", F.xxhash64("content").alias("c1"), F.hash("content").alias("c2"), blank("content").alias("blank"), "content")
    key = ["traj_id", "attempt", "who", "c1", "c2"]
    once = sketched(rows, "content").groupBy(*key).agg(F.min("message_id").alias("msg"), F.min("time").alias("time"), F.max("blank").alias("blank"), *(F.max(c).alias(c) for c in SKETCH))
    once = scratch.write(once, "turns")
    is_lost = F.col("attempt").isNull() & (F.col("who") == 0)
    steps = trajectories.select(F.col("id").alias("traj_id"), F.explode(F.transform("steps", lambda s: F.struct(s["attempt"].alias("a"), F.xxhash64(s["context"]).alias("c1"), F.hash(s["context"]).alias("c2"), s["context"].isNotNull().alias("ok")))).alias("s"))
    at = steps.where("s.ok").groupBy("traj_id", "s.c1", "s.c2").agg(F.min("s.a").alias("a"))
    # Both sides have each key once, so no key is hot here.
    found = once.where(is_lost).join(at, ["traj_id", "c1", "c2"], "left").withColumn("attempt", F.col("a")).drop("a")
    return once.where(~is_lost).unionByName(found)


def linked_turns(messages: DataFrame, trajectories: DataFrame, scratch: Scratch) -> DataFrame:
    """Every turn with its likeliest parent, in the columns of ``LINKED``.

    Turns are linked in groups of ``BLOCK`` attempts of one trajectory; the last replies of a block go along to the
    next as ghosts, for its first prompts. Candidates are the turns of the other speaker within ``REACH`` places in order of
    attempt or of time, so candidates grow with the turns and not with their pairs. A group of more than ``FULL`` turns is
    no conversation (two turns an attempt make 512) and gives a single row that says so.
    """
    t = scratch.write(turns_of(messages, trajectories, scratch), "found")
    block = F.coalesce(F.floor(F.col("attempt") / BLOCK), F.lit(0)).cast("long")
    placed = t.select("*", block.alias("block"))
    full = hot_keys(placed.select(F.xxhash64("traj_id", "block").alias("k")), "k", least=FULL)
    over = None
    if full:  # hot groups, at most 1,000, that hold more turns than a conversation can: broken, and not moved
        is_full = F.xxhash64("traj_id", "block").isin(full)
        over = placed.where(is_full).select("traj_id").distinct()
        placed = placed.where(~is_full)
    ghosts = F.when((F.col("who") == 1) & (F.pmod("attempt", F.lit(BLOCK)) == BLOCK - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = placed.withColumn("ghost", F.explode(ghosts)).withColumn("block", F.col("block") + F.col("ghost"))
    known = lambda c: F.coalesce(F.col(c), F.lit(NONE)).alias(c)
    rows = each.select(
        F.xxhash64("traj_id", "block").alias("g"), F.hash("traj_id", "block").alias("g2"), "traj_id", "who", known("attempt"), "c1", "c2", known("msg"), known("time"), "blank", (F.col("ghost") == 1).alias("ghost"), *SKETCH
    )
    out = rows.repartition("g").sortWithinPartitions("g", "g2").mapInArrow(_link, LINKED)
    out = scratch.write(out, "linked")
    scratch.drop("turns", "found")
    if over is None:
        return out
    more = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in LINKED.split(", ")} | {"who": F.lit(0).cast("byte"), "full": F.lit(True)}
    return out.unionByName(over.select("traj_id", *(v.alias(k) for k, v in more.items() if k != "traj_id")))


def conversations(messages: DataFrame, trajectories: DataFrame, name: str = "threads", mend: bool = False) -> DataFrame:
    """traj_id, turn_no, message_id, attempt, speaker, parent, mended of every turn of each kept conversation.

    Rows of no speaker or no trajectory are ignored; rows equal in trajectory, attempt, speaker and
    content (null equal to null) are one turn with the least message_id. Each turn is tied to its likeliest parent by
    attempt, time, shared names and shared words, and a conversation is kept when these links form one chain: one prompt
    begins it, at attempt 0; every prompt has one reply, no turn has two; each attempt follows from the parent's; no user or
    assistant turn lacks visible content; there is one system turn at most. Places in the chain are turn numbers.

    Unless ``mend``, an attempt that stays unknown or doesn't follow from the parent's breaks the conversation. With it, such
    attempts are put right by the links, and ``mended`` tells where. Empty tables give none.
    """
    scratch = Scratch(messages.sparkSession, name)
    rows = linked_turns(messages, trajectories, scratch)
    user, reply, live = F.col("who") == 0, F.col("who") == 1, ~F.col("ghost")
    straight = F.col("sound") if mend else F.col("straight") & ~F.col("lost")
    shape = rows.groupBy("traj_id").agg(
        F.count_if(user & live).alias("users"), F.count_if(reply & live).alias("replies"), F.count_if(user & live & F.col("parent").isNull()).alias("roots"), F.count_if(user & live & (F.col("kids") == 0)).alias("unanswered"),
        F.max("kids").alias("kids"), F.count_if(live & (F.col("who") == 2)).alias("systems"), F.bool_and(straight | (F.col("who") == 2)).alias("straight"), F.bool_or(F.col("blank") & (F.col("who") < 2)).alias("blank"), F.bool_or("full").alias("full"),
    )
    kept = shape.where("users = replies and roots = 1 and unanswered = 0 and kids = 1 and systems <= 1 and straight and not blank and not full").select("traj_id", "systems")
    attempt = F.col("mended" if mend else "attempt")
    number = F.when(F.col("who") == 2, 0).otherwise(F.col("systems") + 2 * attempt + F.col("who"))
    return join_with_hot_keys(rows.where(live), kept, "traj_id").select(
        "traj_id", number.cast("long").alias("turn_no"), F.col("msg").alias("message_id"), attempt.alias("attempt"),
        F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")), F.col("who").cast("int") + 1).alias("speaker"), "parent",
        (F.coalesce(~F.col("attempt").eqNullSafe(F.col("mended")), F.lit(False)) & (F.col("who") < 2)).alias("mended"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "messages"), table(spark, folder, "trajectories")).select("traj_id", "turn_no", "message_id")


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with their parents, also of conversations whose lost or wrong attempts the links put right."""
    return conversations(table(spark, folder, "messages"), table(spark, folder, "trajectories"), "thread_links", mend=True).select("traj_id", "turn_no", "message_id", "speaker", "parent", "mended")


_SQL = """
WITH m AS (
  SELECT message_id, traj_id, attempt, content,
    CASE lower(regexp_replace(role, '[^\\p{L}]', '', 'g'))
      WHEN 'system' THEN 'system' WHEN 'sys' THEN 'system' WHEN 'developer' THEN 'system' WHEN 'dev' THEN 'system' WHEN 'instruction' THEN 'system' WHEN 'instructions' THEN 'system'
      WHEN 'user' THEN 'user' WHEN 'usr' THEN 'user' WHEN 'human' THEN 'user' WHEN 'person' THEN 'user' WHEN 'customer' THEN 'user' WHEN 'client' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'asker' THEN 'user'
      WHEN 'assistant' THEN 'assistant' WHEN 'asst' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'chatbot' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'llm' THEN 'assistant' WHEN 'agent' THEN 'assistant' WHEN 'gpt' THEN 'assistant' END AS who,
    coalesce(regexp_replace(content, '[\\s\\pZ\\p{Cc}\\p{Cf}\\x{2800}\\x{3164}\\x{ffa0}\\x{115f}\\x{1160}\\x{034f}\\x{fe00}-\\x{fe0f}]+', '', 'g') = '', true) AS unseen
  FROM messages WHERE traj_id IS NOT NULL),
s AS (SELECT id, x.attempt AS a, x.context AS c FROM (SELECT id, unnest(steps) AS x FROM trajectories)),
r AS (
  SELECT message_id, m.traj_id, who, content, unseen, CASE WHEN attempt IS NULL AND who = 'user' THEN (SELECT min(s.a) FROM s WHERE s.id = m.traj_id AND s.c = m.content) ELSE attempt END AS att
  FROM m WHERE who IS NOT NULL),
t AS (SELECT traj_id, att, who, content, min(message_id) AS mid, bool_or(unseen) AS unseen FROM r GROUP BY ALL),
p AS (SELECT traj_id, att, count(*) FILTER (who = 'user') AS u, count(*) FILTER (who = 'assistant') AS a, bool_or(unseen) AS unseen FROM t WHERE who <> 'system' GROUP BY ALL),
k AS (SELECT traj_id FROM p GROUP BY traj_id HAVING bool_and(u = 1 AND a = 1 AND NOT unseen AND att IS NOT NULL) AND min(att) = 0 AND max(att) = count(att) - 1),
y AS (SELECT traj_id, count(*) AS n FROM t WHERE who = 'system' GROUP BY traj_id)
SELECT t.traj_id, CAST(CASE WHEN who = 'system' THEN 0 ELSE coalesce(n, 0) + 2 * att + CASE WHEN who = 'assistant' THEN 1 ELSE 0 END END AS BIGINT) AS turn_no, mid AS message_id
FROM t JOIN k USING (traj_id) LEFT JOIN y USING (traj_id) WHERE coalesce(n, 0) <= 1
"""
QUERIES = {"p3_found": p3_found, "p3_links": p3_links}
ORACLES = {"p3_found": _SQL}
