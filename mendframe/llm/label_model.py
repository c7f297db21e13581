"""A label model over noisy labelling functions, fitted by expectation maximisation.

Each labelling function votes 1 (defect), -1 (sound) or 0 (abstains). Given the true class, votes are
taken as independent, and abstaining says nothing about the class. Rows with the same votes are one pattern, so fitting needs only the
count of each pattern: at most 3 ** functions rows, whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Counts added to each vote of each class, so that a function starts as mostly right.
PRIOR_RIGHT, PRIOR_WRONG = 20.0, 1.0


def fit(patterns: Sequence[tuple[int, ...]], counts: Sequence[int], rounds: int = 100, share: float = 0.05) -> tuple[float, np.ndarray]:
    """(prior of the defect, likelihood[class, function, vote + 1]), 1 for abstaining, at a maximum a posteriori."""
    votes = np.array(patterns, np.int64).reshape(len(patterns), -1)
    n = np.array(counts, float)
    m = votes.shape[1]
    base = np.zeros((2, m, 3))
    base[0] = [PRIOR_RIGHT, 0, PRIOR_WRONG]
    base[1] = [PRIOR_WRONG, 0, PRIOR_RIGHT]
    like = base / base.sum(2, keepdims=True)
    like[:, :, 1] = 1
    prior = share
    onehot = np.stack([(votes == v).astype(float) for v in (-1, 0, 1)], 2)
    for _ in range(rounds):
        post = posterior(votes, prior, like)
        weight = np.stack([(1 - post) * n, post * n])
        grown = base + np.einsum("cp,pmv->cmv", weight, onehot)
        grown[:, :, 1] = 0
        like_new = grown / grown.sum(2, keepdims=True)
        # A function never turns against its own meaning.
        like_new[1, :, 2] = np.maximum(like_new[1, :, 2], like_new[0, :, 2])
        like_new[0, :, 0] = np.maximum(like_new[0, :, 0], like_new[1, :, 0])
        like_new /= like_new.sum(2, keepdims=True)
        like_new[:, :, 1] = 1
        prior_new = float((weight[1].sum() + 1) / (n.sum() + 2)) if len(n) else share
        done = abs(prior_new - prior) < 1e-9 and np.abs(like_new - like).max(initial=0) < 1e-9
        prior, like = prior_new, like_new
        if done:
            break
    return prior, like


def posterior(votes: np.ndarray, prior: float, like: np.ndarray) -> np.ndarray:
    """Probability of the defect for each row of votes."""
    votes = np.asarray(votes, np.int64)
    at = np.arange(votes.shape[1])
    log = np.log(np.clip(like, 1e-12, 1))
    yes = math.log(max(prior, 1e-12)) + log[1, at, votes + 1].sum(1)
    no = math.log(max(1 - prior, 1e-12)) + log[0, at, votes + 1].sum(1)
    return 1 / (1 + np.exp(np.clip(no - yes, -700, 700)))


def held_out(patterns: Sequence[tuple[int, ...]], counts: Sequence[int]) -> list[tuple[float, int, bool]]:
    """(posterior without a function, rows, whether that function then votes for the defect), for each function that votes on a pattern.

    The model is fitted again without each function in turn, so its vote is evidence that the posterior hasn't seen.
    """
    votes = np.array(patterns, np.int64).reshape(len(patterns), -1)
    rows = []
    for j in range(votes.shape[1]):
        rest = np.delete(votes, j, axis=1)
        prior, like = fit([tuple(r) for r in rest], counts)
        post = posterior(rest, prior, like)
        rows += [(float(q), n, v > 0) for q, n, v in zip(post, counts, votes[:, j]) if v]
    return rows


def cutoff(patterns: Sequence[tuple[int, ...]], counts: Sequence[int], precision: float = 0.8, least: float = 0.5) -> float:
    """The least posterior, not below ``least``, from which on functions left out of the fit agree: ``precision`` of the votes they cast are for the defect.

    Where no posterior reaches it, the one that comes nearest is taken.
    """
    rows = held_out(patterns, counts) if len(patterns) and len(patterns[0]) > 1 else []
    best, cut = -1.0, least
    for q in sorted({least, *(q for q, _, _ in rows if q > least)}):
        total = sum(n for p, n, _ in rows if p >= q)
        share = sum(n for p, n, ok in rows if ok and p >= q) / total if total else 0.0
        if total and share >= precision:
            return q
        if share > best + 1e-12:
            best, cut = share, q
    return cut
