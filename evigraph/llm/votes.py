"""Reliability of voters that may abstain, from patterns of their votes and how often each occurs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def log_odds(votes: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log of P(good | votes) / P(bad | votes) of each row of votes: 1, 0, or -1 for an abstention, which says nothing."""
    yes, no = np.log(good / bad), np.log((1 - good) / (1 - bad))
    return np.log(prior / (1 - prior)) + ((votes == 1) * yes + (votes == 0) * no).sum(1)


def fit_patterns(votes: np.ndarray, counts: Sequence[int], *, rounds: int = 25, prior: float = 0.8, floor: float = 0.02, good: float = 0.9, bad: float = 0.4, imagined: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, P(1 | good), P(1 | bad)) of maximum likelihood, by expectation-maximisation over patterns and their counts.

    The start says that voters are mostly right, which fixes the meaning of "good"; each stays on that
    side and within `floor` of 0 and 1. `imagined` votes of the start's kind are added for each voter and
    class; more of them keep voters apart that always agree. Without rows the start is the answer.
    """
    n, voters = np.asarray(counts, np.float64), votes.shape[1]
    g, b = np.full(voters, good), np.full(voters, bad)
    if not n.sum():
        return prior, g, b
    voted, one = votes >= 0, votes == 1
    for _ in range(rounds):
        p = n / (1 + np.exp(-log_odds(votes, prior, g, b)))
        q = n - p
        new_prior = min(1 - floor, max(floor, p.sum() / n.sum()))
        new_g = np.clip((p @ one + imagined * good) / (p @ voted + imagined), floor, 1 - floor)
        new_b = np.minimum(np.clip((q @ one + imagined * bad) / (q @ voted + imagined), floor, 1 - floor), new_g)
        moved = max(abs(new_prior - prior), np.abs(new_g - g).max(), np.abs(new_b - b).max())
        prior, g, b = new_prior, new_g, new_b
        if moved < 1e-4:
            break
    return float(prior), g, b
