"""Set-similarity joins of whole collections: records to classes, classes to blocks, blocks to links.

Texts are cut into shingles once, into a table of records. Records with equal sets of shingles are one class and are
never expanded. Classes meet in blocks: a block is one shingle that both classes picked. A class picks the
prefix of its shingles in a fixed global order, so no pair at the threshold can miss every block. Within blocks a binary trie of sketches finds the pairs within the
Hamming budget of the threshold, and only those are compared shingle by shingle.

The global order puts shingles first whose counter is small. Counters cover all records; they are a table whose width grows with the
number of shingles up to 4,194,304 sums (32 MB), which is all that ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mendframe.llm import bittrie
from mendframe.llm.shingles import Shingles, distinct, mix, set_ids, shingles, slices
from mendframe.operators.components import balanced_pairs, hot_keys, join_with_hot_keys
from mendframe.session import Scratch

#: Bits of the least and the greatest number of counters, and shingles a counter while it grows.
COUNTER_BITS, PER_COUNTER = (16, 22), 256
BLOOM_WORDS = 1 << 17
#: A block of more rows than this is compared chunk by chunk, each pair of chunks in its own group.
CHUNK = 2048
#: A shingle picked by more rows than this, and than one row in 100,000, is spread over salts before its rows are grouped.
HOT_ROWS, HOT_SHARE = 50_000, 1e-5
#: Place of the rows of side 1, of both sides (3) and of side 2 within a block, and which runs of
#: rows meet: in a block of one chunk, then across the two ends of a pair of chunks.
SIDE_ORDER = np.array([0, 0, 2, 1])
MEETING = [(0, 1), (0, 2), (1, 1), (1, 2), (0, 4), (0, 5), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4)]


@dataclass(frozen=True)
class Rule:
    """k words a shingle; least similarity; ``window`` successive shingles have a fingerprint, which is picked too and of which alignments start."""

    k: int = 3
    threshold: float = 0.6
    window: int = 0
    across: bool = False  # only pairs of one record of side 1 and one of side 2
    chunk: int = CHUNK
    hot_rows: int = HOT_ROWS


def _salt(part: np.ndarray) -> np.ndarray:
    return mix(part.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), _long(flat))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, offsets) of a list column without nulls."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _rows(batch: pa.RecordBatch, name: str) -> Shingles:
    """The shingles of a list column, row by row."""
    flat, offsets = _flat(_column(batch, name))
    return Shingles(len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), flat)


def records(recs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """record_kind, key, side, cid, n, once, sketch, toks of each record, written once; texts are not read again.

    ``cid`` names the class of records of equal sets, ``n`` is the size of the set. Of equal sets of a side next to each
    other only the first, ``once``, brings its sketch and shingles: sorted, or in order of reading where the rule has a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw in slices(batches, "text"):
            s = shingles(offsets, raw, _salt(_ints(rows, "part")), rule.k)
            d = distinct(s)
            ids, sizes = set_ids(d)
            once = np.zeros(len(ids), bool)
            once[np.unique(mix(ids + _ints(rows, "side").astype(np.uint64)), return_index=True)[1]] = True
            once &= sizes > 0
            kept = once[d.row]
            words, width = bittrie.sketches(Shingles(d.rows, d.row[kept], d.hash[kept]), sizes)
            own = np.repeat(once, width)
            t = s if rule.window else d
            kept = once[t.row]
            yield pa.RecordBatch.from_arrays(
                [*(_column(rows, c) for c in ("record_kind", "key", "side")), _long(ids), pa.array(sizes.astype(np.int32)), pa.array(once), _lists(words[own], np.where(once, width, 0)), _lists(t.hash[kept], np.bincount(t.row[kept], minlength=t.rows))],
                ["record_kind", "key", "side", "cid", "n", "once", "sketch", "toks"],
            )

    schema = "record_kind string, key string, side int, cid long, n int, once boolean, sketch array<long>, toks array<long>"
    return scratch.write(recs.select("record_kind", "key", "side", "part", "text").mapInArrow(run, schema), "records", **{"parquet.enable.dictionary": "false"})


def counters(recs: DataFrame) -> np.ndarray:
    """Sums over the sets of ``records`` of shingles by the low bits of their hash; a power of two of them."""
    sets = recs.where("once")
    total = sets.agg(F.sum("n")).collect()[0][0] or 0
    width = 1 << min(max(int(total // PER_COUNTER).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.int64)
        for b in batches:
            sums += np.bincount((_flat(_column(b, "toks"))[0] & np.uint64(width - 1)).astype(np.int64), minlength=width)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _long(sums[at])], ["cell", "n"])

    got = sets.select("toks").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def count_of(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    return counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]


def winnow(s: Shingles, order: np.ndarray, window: int) -> np.ndarray:
    """Mask of the positions that are least by ``order`` in some window of successive shingles.

    The last of equal minima is taken. A text with fewer shingles than a window has one window.
    """
    n = len(s.hash)
    chosen = np.zeros(n, bool)
    if not n:
        return chosen
    m = n - window + 1
    if m > 0:
        whole = np.flatnonzero(s.row[:m] == s.row[window - 1 :])
        best = np.stack([order[whole + j] for j in range(window - 1, -1, -1)]).argmin(0)
        chosen[whole + window - 1 - best] = True
    size = np.bincount(s.row, minlength=s.rows)
    begin = (np.cumsum(size) - size)[(size > 0) & (size < window)]
    for b, c in zip(begin, size[(size > 0) & (size < window)]):
        chosen[b + c - 1 - order[b : b + c][::-1].argmin()] = True
    return chosen


def rarity(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number of each hash that grows with its counter, then with the hash; the same in every text."""
    c = count_of(counts, h)
    return (np.log2(c + 1.0) * (1 << 17)).astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)


def _prefix(n: np.ndarray, rule: Rule) -> np.ndarray:
    """How many of n shingles in a global order suffice to meet every set that is alike."""
    return n - np.ceil(rule.threshold * n - 1e-9).astype(np.int64) + 1


def picks(d: Shingles, sizes: np.ndarray, counts: np.ndarray, rule: Rule) -> Shingles:
    """The prefix of each set of distinct shingles, which no set at the threshold can miss."""
    order = np.lexsort((rarity(counts, d.hash), d.row))
    rank = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[d.row]
    order = order[rank < _prefix(sizes, rule)[d.row]]
    return Shingles(d.rows, d.row[order], d.hash[order])


def fingerprints(s: Shingles, counts: np.ndarray, rule: Rule) -> Shingles:
    """The distinct shingles by which each text is found across splits: those of ``marks``."""
    at = marks(s, counts, rule)
    return distinct(Shingles(s.rows, s.row[at], s.hash[at]))


def marks(s: Shingles, counts: np.ndarray, rule: Rule) -> np.ndarray:
    """Mask of the positions of fingerprints: the minima of all windows, and the prefix.

    A run of ``window`` equal shingles shares a minimum; texts that are alike but share no such run, with edits every
    few words, still share a shingle of their prefixes. So no pair at the threshold shares no fingerprint.
    """
    d = distinct(s)
    p = picks(d, np.bincount(d.row, minlength=d.rows), counts, rule)
    key = mix(p.hash + mix(p.row.astype(np.uint64)))  # of a text and a shingle
    return winnow(s, rarity(counts, s.hash), rule.window) | np.isin(mix(s.hash + mix(s.row.astype(np.uint64))), key)


def salts(h: np.ndarray, ids: np.ndarray, counts: np.ndarray, rule: Rule) -> np.ndarray:
    """0, or one of several salts of a shingle that very many rows may pick.

    A shingle's counter bounds its rows from above. Counters are so many that a mean one stays far below the floor at every
    size, so one beyond it holds a shingle near that; any other one there is spread needlessly, not wrongly.
    """
    floor = max(rule.hot_rows, int(counts.sum() * HOT_SHARE))
    spread = np.minimum(count_of(counts, h) // floor, 16_384)
    return np.where(spread > 0, 1 + mix(ids.view(np.uint64)) % np.maximum(spread, 1).astype(np.uint64), np.uint64(0)).astype(np.int16)


def _picked(recs: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    shared = recs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, ids, n, side = _rows(b, "toks"), _ints(b, "cid"), _ints(b, "n"), _ints(b, "side")
            p = fingerprints(s, shared.value, rule) if rule.window else picks(s, n, shared.value, rule)
            own = ids[p.row]
            yield pa.RecordBatch.from_arrays(
                [_long(p.hash), pa.array(salts(p.hash, own, shared.value, rule)), _long(own), pa.array(n[p.row].astype(np.int32)), pa.array(side[p.row].astype(np.int8))], ["h", "salt", "cid", "n", "side"]
            )

    return recs.where("once").select("side", "cid", "n", "toks").mapInArrow(run, "h long, salt short, cid long, n int, side byte")


def _members(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (h, salt, n, cid) in; (h, cid, n, side, chunk) of the blocks that can hold a pair out.

    Blocks stream through: rows of a block wait only until it is seen to hold a pair, at most
    a few chunks of them, after which they go out as they are. Chunks follow one another in size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        opened: tuple[int, int] | None = None
        sent = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, opened, sent
            h, salt, n, cid, side = held
            if not len(h):
                return
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (cid[1:] != cid[:-1])
            at = np.flatnonzero(first)
            side = np.bitwise_or.reduceat(side, at)
            h, salt, n, cid = h[at], salt[at], n[at], cid[at]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(h)))
            group = np.cumsum(new) - 1
            want = (count > 1) & (~np.bool_(rule.across) | (np.bitwise_or.reduceat(side, begin) == 3)) | (salt[begin] > 0)
            pos = np.arange(len(h)) - begin[group]
            if opened == (h[0], salt[0]):
                want[0] = True
                pos[: count[0]] += sent
            keep_from = len(h)
            if not last:
                keep_from = begin[-1]
                if count[-1] > 4 * rule.chunk:  # a long block goes out now, but for its last row
                    want[-1] = True
                    keep_from = len(h) - 1
                    opened, sent = (h[-1], salt[-1]), int(pos[-1])
            take = want[group] & (np.arange(len(h)) < keep_from)
            chunk = (salt[take] << 40) + pos[take] // rule.chunk
            held = np.stack([h[keep_from:], salt[keep_from:], n[keep_from:], cid[keep_from:], side[keep_from:]])
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(cid[take]), pa.array(n[take].astype(np.int32)), pa.array(side[take].astype(np.int8)), pa.array(chunk)], ["h", "cid", "n", "side", "chunk"])

        for batch in batches:
            rows = np.stack([_ints(batch, c) for c in ("h", "salt", "n", "cid", "side")])
            held = np.concatenate([held, rows], axis=1)
            yield from flush(False)
        yield from flush(True)

    return run


def _passing(ids: np.ndarray, keep: np.ndarray) -> np.ndarray:
    at = mix(ids) % np.uint64(len(keep) * 64)
    return (keep.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(cids: DataFrame) -> np.ndarray:
    """A filter of fixed size that every id of ``cids`` passes; built by the executors, and all that is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_WORDS, np.uint64)
        for b in batches:
            at = mix(_ints(b, "cid").view(np.uint64)) % np.uint64(BLOOM_WORDS * 64)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        w = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), _long(bits[w])], ["w", "bits"])

    got = cids.select("cid").mapInArrow(run, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BLOOM_WORDS, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _trie(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (h, ca, cb) in; pairs of classes within the budget out."""
    names = ["h", "ca", "cb", "end", "cid", "side", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), np.int64)
        words: list[np.ndarray] = []

        def solve(x: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            new = np.ones(x.shape[1], bool)
            new[1:] = (x[:3, 1:] != x[:3, :-1]).any(0)
            group = np.cumsum(new) - 1
            level = bittrie.levels(x[6])
            width = bittrie.WORDS << level
            # Within a block rows lie by end and side, then by sketch: each such run is a trie of its own.
            i, j = bittrie.join_levels(level, (flat, np.cumsum(width) - width), x[6], group, x[3] * 3 + SIDE_ORDER[x[5]], 6, MEETING, rule.threshold)
            a, b = x[4, i], x[4, j]
            ok = a != b
            a, b = np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])
            once = np.unique(mix(a.view(np.uint64)) + b.view(np.uint64), return_index=True)[1]
            return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([_ints(batch, c) for c in names])], axis=1)
            words.append(_flat(_column(batch, "sketch"))[0])
            if held.shape[1] > 16 * rule.chunk:
                differs = (held[:3] != held[:3, -1:]).any(0)
                cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                if cut:
                    flat = np.concatenate(words)
                    at = int((bittrie.WORDS << bittrie.levels(held[6, :cut])).sum())
                    yield solve(held[:, :cut], flat[:at])
                    held, words = held[:, cut:], [flat[at:]]
        if held.shape[1]:
            yield solve(held, np.concatenate(words))

    return run


def _chunk_pairs(members: DataFrame, long_blocks: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Rows of long blocks once for each pair of chunks that can hold a pair: h, ca, cb, end, cid, side.

    Chunks are runs of a block in order of size, so those whose sizes are not within the threshold of each other don't meet.
    """
    mine = scratch.write(join_with_hot_keys(members, long_blocks, "h"), "long")
    spans = scratch.write(mine.groupBy("h", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "spans")
    of = lambda k: spans.select("h", *(F.col(c).alias(f"{c}{k}") for c in ("chunk", "lo", "hi")))
    meet = balanced_pairs(of("a"), of("b").withColumnRenamed("h", "h"), "h", "chunka", "chunkb")
    t = F.lit(rule.threshold) - 1e-9
    meet = meet.where((F.col("chunka") <= F.col("chunkb")) & (F.col("hib") >= t * F.col("loa")) & (F.col("hia") >= t * F.col("lob"))).select("h", "chunka", "chunkb")
    ends = meet.select("h", F.col("chunka").alias("chunk"), "chunka", "chunkb", F.lit(0).alias("end")).unionByName(
        meet.where("chunka <> chunkb").select("h", F.col("chunkb").alias("chunk"), "chunka", "chunkb", F.lit(1).alias("end"))
    )
    ends = scratch.write(ends.select(F.xxhash64("h", "chunk").alias("hc"), F.col("h").alias("eh"), F.col("chunk").alias("ec"), "chunka", "chunkb", "end", F.xxhash64("chunka", "chunkb").alias("ek")), "ends")
    rows = scratch.write(mine.withColumn("hc", F.xxhash64("h", "chunk")), "keyed")
    both = balanced_pairs(rows, ends, "hc", "cid", "ek").where("h = eh and chunk = ec")
    return both.select("h", F.col("chunka").alias("ca"), F.col("chunkb").alias("cb"), "end", "cid", "side")


def candidate_pairs(recs: DataFrame, rule: Rule, scratch: Scratch, counts: np.ndarray) -> DataFrame:
    """(a, b), a < b: each pair of classes of ``records`` that share a block and pass the budget, once."""
    rows = _picked(recs, counts, rule).repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "cid")
    members = scratch.write(rows.mapInArrow(_members(rule), "h long, cid long, n int, side byte, chunk long"), "members")
    sketches = recs.where("once").select("cid", "n", "sketch").dropDuplicates(["cid"])
    zero = F.lit(0).cast("long")
    plain = members.select("h", zero.alias("ca"), zero.alias("cb"), F.lit(0).alias("end"), "cid", "side")
    long_blocks = scratch.write(members.where("chunk <> 0").select("h").distinct(), "long_blocks")
    if not long_blocks.isEmpty():
        short = join_with_hot_keys(plain, long_blocks.withColumn("_long", F.lit(1)), "h", "left").where("_long is null").drop("_long")
        plain = short.unionByName(_chunk_pairs(members, long_blocks, rule, scratch))
    blocks = plain.join(sketches, "cid").repartition("h", "ca", "cb").sortWithinPartitions("h", "ca", "cb")
    out = scratch.write(blocks.mapInArrow(_trie(rule), "a long, b long").distinct(), "pairs")
    scratch.drop("members", "long_blocks", "long", "spans", "ends", "keyed")
    return out


def sets_of(recs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, n, toks) of the classes in ``pairs``, each once."""
    keep = recs.sparkSession.sparkContext.broadcast(filter_of(pairs.select(F.explode(F.array("a", "b")).alias("cid"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_passing(_column(b, "cid").to_numpy().view(np.uint64), keep.value)))

    some = recs.where("once").select("cid", "n", "toks").mapInArrow(run, "cid long, n int, toks array<long>")
    return scratch.write(some.dropDuplicates(["cid"]), "sets")


def with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, ta, tb: the pairs with the sets of both ends. ``pairs`` and ``sets`` are tables; hot classes are counted on pairs alone."""
    of = lambda k: sets.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("toks").alias(f"t{k}"))
    hot = hot_keys(pairs, "b")
    return join_with_hot_keys(join_with_hot_keys(pairs, of("a"), "a"), of("b"), "b", hot=hot)


def exact_links(recs: DataFrame, pairs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold, by their whole sets."""
    both = with_both(pairs, sets_of(recs, pairs, scratch))
    i = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", (i / (F.col("na") + F.col("nb") - i)).alias("similarity")).where(F.col("similarity") >= rule.threshold)
