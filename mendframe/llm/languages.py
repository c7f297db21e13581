"""Which language a short text is written in, by profiles of its letters fitted on labelled texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendframe.llm.records import tidy
from mendframe.llm.shingles import mix

#: Labelled rows that profiles are fitted on, cells of a profile, and the least trigrams of a text to be judged.
FIT_ROWS, CELLS, LEAST = 2000, 1 << 13, 8


def letters(text: str) -> str:
    """Lower-case letters, composed, with one blank for anything else between them."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFC", text.lower())).split()) + " "


def trigrams(text: str) -> np.ndarray:
    """Cells of the successive three letters of a text."""
    x = np.frombuffer(letters(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (mix(x[:-2] << np.uint64(42) ^ x[1:-1] << np.uint64(21) ^ x[2:]) & np.uint64(CELLS - 1)).astype(np.int64) if len(x) > 2 else np.zeros(0, np.int64)


class Profiles:
    """log P(trigram | language) of each language; without any, every text is of unknown language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        self.log = np.array([np.log((counts[k] + 0.05) / (counts[k].sum() + 0.05 * CELLS)) for k in self.names]).reshape(len(self.names), CELLS)

    def foreign(self, text: str, home: str = "en") -> float | None:
        """How much likelier, a trigram, a text is in the best of the other languages than in ``home``; None where it is too short or ``home`` unknown."""
        at = trigrams(text)
        if len(at) < LEAST or home not in self.names or len(self.names) < 2:
            return None
        mean = self.log[:, at].mean(1)
        k = self.names.index(home)
        return float(np.delete(mean, k).max() - mean[k])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Profiles:
    """Profiles of the languages that at least one in a hundred of the fitted rows names: at most ``rows`` rows with a text
    and two letters as ``lang`` are read. Labels may be wrong here and there; a profile averages over them."""
    some = labelled.select(tidy(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").rlike("^[a-z]{2}$") & (F.length("text") > 0)).limit(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby("lang"):
                n = sum((np.bincount(trigrams(t), minlength=CELLS) for t in g["text"]), np.zeros(CELLS, np.int64))
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": k, "cell": at.astype(np.int32), "n": n[at], "docs": len(g)})

    got = some.mapInPandas(run, "lang string, cell int, n long, docs long").groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.max("docs").alias("docs")).toPandas()
    counts: dict[str, np.ndarray] = {}
    share = got.groupby("lang")["docs"].max()
    for k in share.index[share >= max(2, share.sum() / 100)]:
        mine = got[got["lang"] == k]
        counts[k] = np.zeros(CELLS)
        counts[k][mine["cell"].to_numpy()] = mine["n"].to_numpy()
    return Profiles(counts)

