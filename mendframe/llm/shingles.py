"""Word shingles of Arrow text columns as 64-bit hashes, by whole-buffer numpy operations.

A word is a longest run of ASCII letters, digits and underscore, case kept; a shingle is a run
of ``k`` successive words of one text. Hashes are 64 bits of a keyed polynomial over the bytes,
mixed; two different shingles are taken for one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
#: One random odd 64-bit number per byte value, and the base of the polynomial.
BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
#: Bytes of text handled at a time; one longer text is still handled whole.
SLICE_BYTES = 1 << 20

_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, SLICE_BYTES), BASE if which == "p" else BASE_INV, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    """``mix`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


@dataclass
class Shingles:
    """The shingles of ``rows`` texts: ``hash[i]`` is the next shingle of text ``row[i]``, in reading order."""

    rows: int
    row: np.ndarray
    hash: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string array, null as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of consecutive texts that ``offsets`` cut out of ``raw``."""
    data = raw[offsets[0] : offsets[-1]]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = IS_WORD[data]
    starts_of_rows = offsets[:-1] - offsets[0]
    starts_of_rows = starts_of_rows[starts_of_rows < n]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[starts_of_rows] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[starts_of_rows[starts_of_rows > 0] - 1] = False
    end = np.flatnonzero(inside & ~after)
    sums = np.cumsum(BYTE_KEY[data] * _power("p", n), dtype=np.uint64)
    low = sums[begin - 1]
    low[begin == 0] = 0
    hashes = mix((sums[end] - low) * _power("i", n)[begin])
    rows = np.searchsorted(offsets[1:] - offsets[0], begin, side="right")
    return rows, hashes


def words_with(byte: int, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each word of ``word_hashes``, whether it holds a byte."""
    data = raw[offsets[0] : offsets[-1]]
    if not len(data):
        return np.zeros(0, bool)
    inside = IS_WORD[data]
    cut = offsets[:-1] - offsets[0]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[cut[cut < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    return np.add.reduceat((data == byte).astype(np.int64), begin) > 0 if len(begin) else np.zeros(0, bool)


def shingles(offsets: np.ndarray, raw: np.ndarray, salt: np.ndarray, k: int = 3) -> Shingles:
    """All shingles in reading order; ``salt`` (one per text) keeps records of different kinds apart."""
    rows, words = word_hashes(offsets, raw)
    m = len(words) - k + 1
    if m <= 0:
        return Shingles(len(offsets) - 1, np.zeros(0, np.int64), np.zeros(0, np.uint64))
    whole = rows[:m] == rows[k - 1 :]
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = mix(out + words[j : m + j] + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
    rows, out = rows[:m][whole], out[whole]
    return Shingles(len(offsets) - 1, rows, mix(out ^ salt[rows]))


def _by_row_and_hash(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by row, then hash: by one 64-bit key of both, unless their cut-off bits matter."""
    if row[-1] < 1 << 20:
        key = row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
        order = np.argsort(key)
        k, x = key[order], h[order]
        if not ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            return order
    return np.lexsort((h, row))


def distinct(s: Shingles) -> Shingles:
    """Each shingle of a text once, ordered by hash within the text."""
    if not len(s.hash):
        return s
    order = _by_row_and_hash(s.row, s.hash)
    row, h = s.row[order], s.hash[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return Shingles(s.rows, row[first], h[first])


def set_ids(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """(id, size) of each text's set of shingles, from ``distinct``; equal sets have equal ids."""
    sizes = np.bincount(s.row, minlength=s.rows).astype(np.int64)
    sums = np.zeros(s.rows, np.uint64)
    if len(s.hash):
        at = np.flatnonzero(sizes)
        begin = np.cumsum(sizes) - sizes
        sums[at] = np.add.reduceat(mix(s.hash + np.uint64(0xD1B54A32D192ED03)), begin[at])
    return mix(sums ^ sizes.astype(np.uint64)), sizes


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SLICE_BYTES`` of text, with their offsets and bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        if not len(column):
            continue
        offsets, raw = buffers(column)
        at = 0
        while at < len(column):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), len(column))
            yield batch.slice(at, to - at), offsets[at : to + 1], raw
            at = to
