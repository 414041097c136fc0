"""Features and the counterfactual-regularised logistic model; free of Spark."""

from __future__ import annotations

import math
import re

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)

#: Neutral names of groups, in sets whose members are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "transgender people", "nonbinary people"), ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"), ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "latina", "arab", "african", "european", "indigenous"),
    ("american", "mexican", "chinese", "indian", "russian", "turkish", "french", "german", "spanish", "polish"),
    ("immigrant", "refugee", "migrant", "foreigner"), ("immigrants", "refugees", "migrants", "foreigners"),
    ("old", "young", "elderly", "teenage"), ("deaf", "blind", "disabled", "autistic", "paralyzed"),
)
SWAPS = {term: group for group in IDENTITY_TERMS for term in group}
IDENTITY = re.compile(r"\b(" + "|".join(sorted(map(re.escape, SWAPS), key=len, reverse=True)) + r")\b")


def features(text: str | None) -> set[str]:
    """The words of a text in lower case, and the stems of 4 to 6 letters that begin longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in STEMS))


def score(weights: dict[str, float], bias: float, text: str | None) -> float:
    """The logistic of the summed weights of a text's features."""
    total = bias + sum(weights[f] for f in weights.keys() & features(text))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def swapped(text: str | None) -> list[str]:
    """The sentences with group names, each once with every name replaced by another of its set: next, and next but one."""
    body = (text or "").lower()
    if not IDENTITY.search(body):
        return []
    out = []
    for step in (1, 2):
        def other(found, step=step):
            group = SWAPS[found[0]]
            return group[(group.index(found[0]) + step) % len(group)]

        out.append(IDENTITY.sub(other, body))
    return out


def fit(rows: list[tuple[list[int], int, list[tuple[list[int], list[int]]]]], size: int, balance: float = 8.0, ridge: float = 1e-5,
        steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for sets of feature numbers: mean log loss, plus `balance` times the mean squared change of
    the score's logit under a swap, plus `ridge` times the squared weights. Nesterov steps.

    rows: (features, label, pairs of (features lost, features gained) of the swaps). One label only: no weights, and the
    intercept is the smoothed share of label 1.
    """
    y = np.array([label for _, label, _ in rows], dtype=float)
    prior = (y.sum() + 1) / (len(y) + 2)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if size == 0 or y.sum() in (0, len(y)):
        return weights, bias
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    col = np.concatenate([np.asarray(f, dtype=np.int64) for f, _, _ in rows]) if len(at) else np.zeros(0, np.int64)
    pairs = [p for _, _, swaps in rows for p in swaps]
    p_at = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(pairs)]) if pairs else np.zeros(0, np.int64)
    p_col = np.concatenate([np.asarray([*a, *b], dtype=np.int64) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    n_pairs = max(1, len(pairs))

    def gradient(w, b):
        z = np.bincount(at, w[col], len(rows)) + b
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        change = np.bincount(p_at.astype(np.int64), sign * w[p_col.astype(np.int64)], n_pairs)
        g = np.bincount(col, error[at], size) + 2 * ridge * w
        if pairs:
            g += 2 * balance / n_pairs * np.bincount(p_col.astype(np.int64), sign * change[p_at.astype(np.int64)], size)
        return g, error.sum()

    # a bound on the curvature of each coordinate, so that rare words take long steps
    wide = np.bincount(at, minlength=len(rows)) + 1.0
    curve = 0.25 / len(y) * np.bincount(col, wide[at], size) + 2 * ridge
    if pairs:
        pair_wide = np.bincount(p_at.astype(np.int64), minlength=n_pairs)
        curve += 2 * balance / n_pairs * np.bincount(p_col.astype(np.int64), pair_wide[p_at.astype(np.int64)], size)
    curve_b = 0.25 * wide.mean()
    v, vb, old, old_b = weights.copy(), bias, weights.copy(), bias
    for k in range(steps):
        g, gb = gradient(v, vb)
        weights, bias = v - g / curve, vb - gb / curve_b
        push = k / (k + 3)
        v, vb = weights + push * (weights - old), bias + push * (bias - old_b)
        old, old_b = weights, bias
    return weights, bias
