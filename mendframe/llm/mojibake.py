"""Texts that were decoded with the wrong character encoding, and what they were before.

Adjacent character pairs are counted over the distinct texts of the corpus, once as they stand and once without
runs that read as UTF-8 bytes, so that no garbled text makes itself usual however often it occurs; characters that no
right decoding gives are not counted at all. Maximum-scoring segments of two kinds isolate what is improbable: of pairs whose mutual
information is negative once the text's own occurrences are left out, and of a line's pairs whose information falls short of
the rarity of their second characters. Inverse mappings (encode as it was wrongly decoded, decode as it was
meant) are tried inside these only, and a mapping is taken only where the restored characters are likelier in the corpus. A text that is found
out in this way is then tried throughout.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.llm.records import table
from mendframe.llm.shingles import mix, mix_one

#: Counters of pairs and of single characters; the model never outgrows them.
PAIRS, SINGLES = 1 << 20, 1 << 16
#: Mutual information (natural log) below which a pair counts towards an improbable segment.
EXPECTED = -1.0
#: Score of a usual pair with a non-ASCII character, and how far a stretch of them must fall short of it in all
#: before its line is tried as a text of another encoding.
USUAL, WORST = -3.7, 8.0
#: Mean log frequency below which characters are too rare to come from a text of the corpus.
COMMON = -11.0
#: By how much a reading as UTF-8 must be likelier (natural log) than what stands there.
GAIN = 1.0

#: Ways UTF-8 bytes are read wrongly: each byte as one character of these code pages.
AS_BYTES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15", "iso8859-2", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257", "cp852", "mac_cyrillic")
#: (meant, read as) of texts that never were UTF-8.
MULTIBYTE = tuple((t, w) for t in ("gb18030", "shift_jis", "cp932", "euc_jp", "euc_kr", "big5") for w in ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman"))
ONE_BYTE = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"), ("cp866", "latin-1"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "cp1252"), ("cp437", "latin-1"), ("cp850", "cp1252"), ("cp850", "latin-1"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("mac_cyrillic", "mac_roman"), ("mac_cyrillic", "cp1252"),
)
QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
LOST = "�"
HIGH = re.compile(r"[^\x00-\x7f]")
RUN = re.compile(r"[^\x00-\x7f]{2,}")
RUNS = re.compile(r"[^\x00-\x7f]+")
#: What no right decoding gives: the replacement sign and controls other than the line break among them.
NEVER = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
#: Controls and private characters, which no restored text holds.
ODD = re.compile("[\x80-\x9f\ue000-\uf8ff]")


@functools.cache
def to_bytes(page: str) -> dict[str, int]:
    """Character to byte of a code page; bytes it leaves out stand for the control of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if page in ("cp1252", "cp1250", "cp1251", "cp1254"):
        for b in range(0x80, 0xA0):  # controls survive in some decoders
            out.setdefault(chr(b), b)
    return out


@functools.cache
def _known(page: str) -> frozenset[str]:
    """The non-ASCII characters of a page."""
    return frozenset(c for c in to_bytes(page) if c > "\x7f")


def _controls(e: UnicodeError) -> tuple[bytes, int]:
    return bytes(map(ord, e.object[e.start : e.end])), e.end


codecs.register_error("mendframe-controls", _controls)


def as_bytes(text: str, high: set[str], page: str) -> bytes | None:
    """``text`` as bytes of ``page``; ``high`` are its non-ASCII characters. None where one isn't in the page."""
    return text.encode(page, "mendframe-controls") if high <= _known(page) else None


class PairModel:
    """log P(second | first) of adjacent characters from bounded counters."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, standing: PairModel | None = None):
        """``standing`` is the model of the texts as they stand where these counts leave out runs that read as UTF-8 bytes."""
        self.pairs, self.singles, self.standing = pairs, singles, standing or self
        self.total = float(max(singles.sum(), 1))
        self.seen: dict[tuple[str, str], float] = {}

    @staticmethod
    def cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)

    @staticmethod
    def one(a: np.ndarray) -> np.ndarray:
        return (mix(a.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) & np.uint64(SINGLES - 1)).astype(np.int64)

    def scores(self, points: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """For each adjacent pair, or those ``at`` places, the log of P(second | first): its information plus the log frequency of the second."""
        a, b = points[:-1][at], points[1:][at]
        na, back = self.singles[self.one(a)], (self.singles[self.one(b)] + 0.1) / self.total
        return np.log((self.pairs[self.cells(a, b)] + 4.0 * back) / (na + 4.0))

    def information(self, points: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Pointwise mutual information of the pairs ``at`` places, by what other texts hold: ``text`` numbers the text of each."""
        a, b = points[:-1][at], points[1:][at]
        cells = self.cells(a, b)
        _, where, own = np.unique(text.astype(np.int64) * PAIRS + cells, return_inverse=True, return_counts=True)
        n = np.maximum(self.pairs[cells] - own[where], 0)
        back = (self.singles[self.one(b)] + 0.1) / self.total
        return np.log((n + 4.0 * back) / (self.singles[self.one(a)] + 4.0)) - np.log(back)

    def common(self, characters: list[str]) -> float:
        """Mean log frequency of characters."""
        return float(np.log((self.singles[self.one(points_of("".join(characters)))] + 0.1) / self.total).mean())

    def pair(self, two: str) -> float:
        """``scores`` of one pair without arrays; pairs recur, so scores are kept."""
        got = self.seen.get(two)
        if got is None:
            a, b = map(ord, two)
            na, nb = (int(self.singles[mix_one(c + 0x5851F42D4C957F2D) & (SINGLES - 1)]) for c in (a, b))
            back = (nb + 0.1) / self.total
            got = self.seen[two] = math.log((int(self.pairs[mix_one(a << 21 | b) & (PAIRS - 1)]) + 4.0 * back) / (na + 4.0))
        return got

    def text(self, s: str) -> float:
        """Log probability of ``s`` after its first character."""
        return sum(self.pair(s[i : i + 2]) for i in range(len(s) - 1))

    def marked(self, s: str, floor: float = -math.inf) -> float:
        """Log probability of the pairs of ``s``, a line, that hold a non-ASCII character; the others stay as they are in any mapping.

        As no pair adds to it, it is given up where it falls below ``floor``.
        """
        s = f"\n{s}\n"
        total = 0.0
        for m in RUNS.finditer(s):
            total += self.text(s[m.start() - 1 : m.end() + 1])
            if total < floor:
                break
        return total


def points_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def readable(text: str) -> np.ndarray:
    """Mask of the characters of ``text`` that lie in a run of non-ASCII ones which reads as UTF-8 bytes."""
    out = np.zeros(len(text), bool)
    for m in RUN.finditer(text):
        if utf8_readings(m[0]):
            out[m.start() : m.end()] = True
    return out


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(texts between line breaks as one string, its code points, the number of the text of each)."""
    whole = "\n" + "\n".join(texts) + "\n"
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return whole, points_of(whole), np.concatenate(([0], np.repeat(np.arange(len(texts)), sizes)))


def impossible(points: np.ndarray) -> np.ndarray:
    """Mask of the characters of ``NEVER``."""
    return (points >= 0x80) & (points < 0xA0) & (points != 0x85) | (points == 0xFFFD)


def pair_counts(docs: DataFrame, text: str) -> PairModel:
    """Counts over every distinct text of the table, without runs that read as UTF-8 bytes and with them; only the tables of counters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles = np.zeros((2, PAIRS), np.int64), np.zeros((2, SINGLES), np.int64)
        for batch in batches:
            for part in portions(batch.column(0).to_pylist()):
                s, x, _ = joined(part)
                cells, ones, never = PairModel.cells(x[:-1], x[1:]), PairModel.one(x[1:]), impossible(x)
                for k, out in enumerate((never | readable(s), never)):
                    pairs[k] += np.bincount(cells[~(out[:-1] | out[1:])], minlength=PAIRS)
                    singles[k] += np.bincount(ones[~out[1:]], minlength=SINGLES)
        both = np.concatenate([pairs.reshape(-1), singles.reshape(-1)])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[at])], ["cell", "n"])

    got = docs.select(text).where(F.length(text) > 0).distinct().mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(2 * (PAIRS + SINGLES), np.int64)
    both[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    pairs, singles = both[: 2 * PAIRS].reshape(2, -1), both[2 * PAIRS :].reshape(2, -1)
    return PairModel(pairs[0], singles[0], PairModel(pairs[1], singles[1]))


def portions(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text is one of its own and stays whole."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def maximal_segments(x: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments of ``x`` as half-open ranges, by one pass over its sign changes."""
    if not len(x) or x.max() <= 0:
        return []
    sign = x > 0
    cut = np.flatnonzero(np.diff(sign)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
    sums = np.add.reduceat(x, begin)
    stack: list[list[float]] = []  # left position, right position, sum before, sum through
    total = 0.0
    for b, e, s in zip(begin.tolist(), end.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        k = [b, e, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= k[2]:
                j -= 1
            if j < 0 or stack[j][3] >= k[3]:
                stack.append(k)
                break
            k = [stack[j][0], k[1], stack[j][2], k[3]]
            del stack[j:]
    return [(int(a), int(b)) for a, b, _, _ in stack]


Span = tuple[int, int]


def all_runs(text: str) -> list[Span]:
    """The runs of non-ASCII characters outside inline code."""
    quoted = [m.span() for m in QUOTED.finditer(text)] if "`" in text else []
    return [m.span() for m in RUNS.finditer(text) if not any(a <= m.start() < b for a, b in quoted)]


def suspicious_runs(texts: list[str], model: PairModel) -> list[tuple[list[Span], set[int]]]:
    """For each text (the runs of non-ASCII characters outside inline code that an improbable segment touches; the starts of
    those that lie in a stretch of improbable pairs of their line)."""
    whole, x, of = joined(texts)
    high = x > 127
    near = np.flatnonzero(high[:-1] | high[1:])
    if not len(near):
        return [([], set()) for _ in texts]
    s = np.full(len(x) - 1, -1.0)  # a garbled sequence has no pair of two ASCII characters
    s[near] = EXPECTED - model.information(x, near, of[near])
    s[np.flatnonzero(np.diff(of))] = -1e9  # no segment spans two texts
    wide = np.zeros(len(x), bool)
    for a, b in maximal_segments(s):
        wide[a : b + 1] = True
    # Successive pairs of one line: what the best segment that ends at each of them sums to.
    line = np.cumsum(x == 10)[near]
    short = USUAL - model.standing.scores(x, near)
    sums = np.cumsum(short)
    far = 1e6 * (line - line[0])
    least = np.minimum.accumulate(sums - short - far) + far
    worst = np.zeros(len(x), bool)
    edge = np.flatnonzero(np.diff(line, prepend=-1))
    bad = np.maximum.reduceat(sums - least, edge) > WORST
    worst[near[np.repeat(bad, np.diff(np.append(edge, len(near))))] + 1] = True
    worst[1:-1] &= high[1:-1]
    inside = np.diff(np.concatenate(([0], high.view(np.int8), [0])))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    ends = np.stack([begin, end], 1).reshape(-1)
    touched = np.add.reduceat(wide.astype(np.int64), ends)[::2] > 0
    in_bad = np.zeros(len(begin), bool)
    at = np.searchsorted(near, begin - 1)
    in_bad[:] = np.repeat(bad, np.diff(np.append(edge, len(near))))[np.minimum(at, len(near) - 1)]
    first = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in texts])))
    out: list[tuple[list[Span], set[int]]] = [([], set()) for _ in texts]
    quoted: dict[int, list[Span]] = {}
    for k in np.flatnonzero(touched | in_bad).tolist():
        t = int(of[begin[k]])
        a, b = int(begin[k] - first[t]), int(end[k] - first[t])
        if t not in quoted:
            quoted[t] = [m.span() for m in QUOTED.finditer(texts[t])] if "`" in texts[t] else []
        if not any(p <= a < q for p, q in quoted[t]):
            out[t][0].append((a, b))
            if in_bad[k]:
                out[t][1].add(a)
    return out


@functools.lru_cache(1 << 17)
def utf8_readings(run: str) -> tuple[str, ...]:
    """The texts whose UTF-8 bytes, read as some code page, give ``run``; words recur, so readings are kept."""
    high, found = set(run), {}
    for page in AS_BYTES:
        raw = as_bytes(run, high, page)
        try:
            new = raw.decode("utf-8") if raw is not None else run
        except UnicodeDecodeError:
            continue
        if new != run and LOST not in new and not (len(run) < 4 and ODD.search(new)):
            found[new] = None
    return tuple(found)


def _gain(model: PairModel, text: str, a: int, b: int, new: str) -> float:
    """By how much ``new`` is likelier than ``text[a:b]`` where it stands."""
    before, after = text[max(a - 1, 0) : a] or "\n", text[b : b + 1] or "\n"
    return model.text(before + new + after) - model.text(before + text[a:b] + after)


def reading_gain(model: PairModel, text: str, a: int, b: int, new: str) -> float:
    """By how much ``new`` is likelier than ``text[a:b]`` by the texts as they stand or, where its characters are
    no rarer than those that stand there, without readable runs: garbled pairs may be usual, but not there."""
    gain = _gain(model.standing, text, a, b, new)
    if model.standing is not model and model.common(list(new)) >= model.common(list(text[a:b])):
        gain = max(gain, _gain(model, text, a, b, new))
    return gain


def repair_runs(line: str, model: PairModel, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """(line with every run put right that reads as UTF-8 bytes, how many)."""
    out, done, fixed = [], 0, 0
    for a, b in runs:
        best, gain = None, GAIN
        for new in utf8_readings(line[a:b]) if b - a > 1 else ():
            g = reading_gain(model, line, a, b, new)
            if g > gain:
                best, gain = new, g
        if best is not None:
            out += [line[done:a], best]
            done, fixed = b, fixed + 1
    out.append(line[done:])
    return "".join(out), fixed


#: Code pages whose unused bytes some decoders drop.
GAPPED = ("cp1252", "cp1250", "cp1251", "cp1254", "cp1257")
Mapping = tuple[str, str]


@functools.cache
def _stretch(page: str) -> re.Pattern:
    return re.compile("[\x00-\x7f" + re.escape("".join(sorted(_known(page)))) + "]+")


def pieces(line: str, page: str) -> list[tuple[int, int, bytes]]:
    """The longest parts of a line that a page can hold and that have two or more of its characters, with their bytes."""
    out = []
    for m in _stretch(page).finditer(line):
        high = HIGH.findall(m[0])
        if len(high) > 1:
            out.append((m.start(), m.end(), as_bytes(m[0], set(high), page)))
    return out


def lossy_reading(line: str, model: PairModel) -> str | None:
    """``line`` with the parts that read as UTF-8 bytes of which some were dropped, each gap a replacement sign, or None.

    At least three characters of a part must come out whole, no fewer than there are gaps, and be as common in
    the corpus as a text's characters are.
    """
    for page in GAPPED:
        out, done = [], 0
        for a, b, raw in pieces(line, page):
            new = raw.decode("utf-8", "replace")
            whole = [c for c in HIGH.findall(new) if c != LOST]
            if len(whole) >= 3 and len(whole) >= new.count(LOST) and model.common(whole) > COMMON:
                out += [line[done:a], new]
                done = b
        if out:
            return "".join([*out, line[done:]])
    return None


def repair_whole(line: str, model: PairModel, mappings: tuple[Mapping, ...], floor: float, each: float) -> tuple[str | None, float, Mapping | None]:
    """(line with the parts that never were UTF-8 as they were, how much likelier, by which mapping), or None.

    A part is changed when it gains more than ``floor`` and more than ``each`` a character; the mapping of the largest gain is taken.
    """
    best, gain, by = None, 0.0, None
    pages: dict[str, list[str]] = {}
    for meant, page in mappings:
        pages.setdefault(page, []).append(meant)
    own: dict[Span, tuple[float, float]] = {}
    for page, meanings in pages.items():
        parts = pieces(line, page)
        for meant in meanings if parts else ():
            out, done, total = [], 0, 0.0
            for a, b, raw in parts:
                try:
                    new = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                old = line[a:b]
                if new == old or ODD.search(new):
                    continue
                if (a, b) not in own:
                    own[a, b] = model.marked(old), max(floor, each * len(HIGH.findall(old)))
                now, least = own[a, b]
                g = model.marked(new, now + least) - now
                if g > least:
                    out += [line[done:a], new]
                    done, total = b, total + g
            if total > gain:
                best, gain, by = "".join([*out, line[done:]]), total, (meant, page)
    return best, gain, by


def repair(text: str, model: PairModel, runs: list[Span], bad: set[int]) -> tuple[str, int]:
    """(text with every line put right as far as an inverse mapping explains it, how many were undone).

    Runs are read as UTF-8 bytes; a line with a run that begins in ``bad`` is also tried as a text
    of another encoding, and the likelier of both is kept. A mapping that one line bears out is
    tried on the text's other lines too, where any gain is enough.
    """
    lines, fixed = text.split("\n"), 0
    starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
    by: dict[int, list[Span]] = {}
    tried = set()
    for k, (a, b) in zip((np.searchsorted(starts, [a for a, _ in runs], side="right") - 1).tolist(), runs):
        by.setdefault(k, []).append((a - int(starts[k]), b - int(starts[k])))
        if a in bad:
            tried.add(k)
    trusted: dict[Mapping, None] = {}
    done = set()
    for k, own in by.items():
        new, n = repair_runs(lines[k], model, own)
        if k in tried and sum(b - a for a, b in own) > 1:
            whole, gain, mapping = repair_whole(lines[k], model.standing, (*MULTIBYTE, *ONE_BYTE), 6.0, 1.5)
            if whole is not None and (not n or gain > model.standing.text(f"\n{new}\n") - model.standing.text(f"\n{lines[k]}\n") and model.text(f"\n{whole}\n") > model.text(f"\n{new}\n")):
                new, n = whole, 1
                trusted[mapping] = None
            if not n and (lossy := lossy_reading(lines[k], model.standing)) is not None:
                new, n = lossy, 1
        if n:
            done.add(k)
        lines[k], fixed = new, fixed + n
    for k, x in enumerate(lines) if trusted else ():
        if k not in done and HIGH.search(x) and all_runs(x):
            whole, _, _ = repair_whole(x, model.standing, tuple(trusted), 1.0, 0.0)
            if whole is not None:
                lines[k], fixed = whole, fixed + 1
    return "\n".join(lines), fixed


def examine(text: str, model: PairModel, runs: list[Span], bad: set[int]) -> tuple[bool, str, int, bool]:
    """(garbled, text as far as it can be put right, mappings undone, whether nothing garbled is left).

    ``runs`` and ``bad`` are the text's ``suspicious_runs``. Once one of them is put right, all runs of the text are tried, and
    again as long as anything is undone: text may have been garbled more than once.
    """
    out, undone = repair(text, model, runs, bad)
    n = undone
    while n:
        new, n = repair(out, model, all_runs(out), suspicious_runs([out], model)[0][1])
        # UTF-8 that is read right is shorter; other mappings keep the length and are not undone twice.
        out, undone, n = new, undone + n, n if len(new) < len(out) else 0
    lost = any(NEVER.search(text[a:b]) for a, b in runs) if not undone else NEVER.search(QUOTED.sub("``", out)) is not None
    return undone > 0 or lost, out, undone, not lost


def examined(texts: list[str], model: PairModel) -> Iterator[tuple[int, str, int, bool]]:
    """(place, restored, undone, whole) of the garbled ones among ``texts``."""
    at = 0
    for part in portions(texts):
        for k, (runs, bad) in enumerate(suspicious_runs(part, model)):
            if runs and (r := examine(part[k], model, runs, bad))[0]:
                yield at + k, *r[1:]
        at += len(part)


def garbled_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, restored, undone, whole of every row whose text holds characters from a wrong decoding.

    ``whole`` says that nothing lost is left in ``restored``. Null, empty and ASCII texts are sound; so
    is a text that only quotes a garbled sequence between single backticks on one line. Other columns are ignored,
    repeated rows give repeated rows, an empty table gives none.
    """
    model = pair_counts(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.pairs, model.singles, model.standing.pairs, model.standing.singles))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles, *standing = shared.value
        own = PairModel(pairs, singles, PairModel(*standing))
        for b in batches:
            keys = b["k"].tolist()
            rows = [(keys[k], *r) for k, *r in examined(b["t"].tolist(), own)]
            yield pd.DataFrame(rows, columns=["k", "restored", "undone", "whole"])

    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]"))
    return some.mapInPandas(run, f"k {kind}, restored string, undone int, whole boolean").withColumnRenamed("k", key)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents"))


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
ORACLES: dict[str, str] = {}
