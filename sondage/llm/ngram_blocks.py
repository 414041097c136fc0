"""Tokens, bigrams and their counts in blocks of documents; free of Spark."""

from __future__ import annotations

import numpy as np
import zstandard

from sondage.llm.shingles import FACTORS, WordHashes, mixed

#: Hashes of the end of a text, counted as a token, and of what stands before its first token, a context only.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def pack_texts(texts: list[bytes | None]) -> bytes:
    lengths = np.array([len(t or b"") for t in texts], dtype=np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(t or b"" for t in texts))


def unpack_texts(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, np.uint64, n)).astype(np.int64) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


class Block:
    """The tokens of some documents as numbers into the block's sorted distinct words and bigrams.

    words, pairs: sorted distinct hashes. word, pair: the number of each token's word and of the bigram that ends in it.
    context: the number of each bigram's first word among `contexts`, the words and START.
    """

    def __init__(self, texts: list[bytes], hasher: WordHashes):
        parts, self.lengths = [], np.zeros(len(texts), dtype=np.int64)
        end = np.array([END])
        for k, text in enumerate(texts):
            found = hasher.of(text)
            parts += (found, end)
            self.lengths[k] = len(found) + 1
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        firsts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[firsts] = START
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.contexts, context = np.unique(before, return_inverse=True)
        hashed = mixed(before * FACTORS[0] + tokens * FACTORS[1])
        self.pairs, at, self.pair = np.unique(hashed, return_index=True, return_inverse=True)
        self.context, self.last = context[at], self.word[at]
        self.word_counts = np.bincount(self.word, minlength=len(self.words))
        self.pair_counts = np.bincount(self.pair, minlength=len(self.pairs))
        self.context_counts = np.bincount(context, minlength=len(self.contexts))
        self.firsts = firsts

    def keys(self):
        """What the block asks for and adds to: (kind, hashes, counts) of words, contexts and bigrams, in this order."""
        return ((0, self.words, self.word_counts), (1, self.contexts, self.context_counts), (2, self.pairs, self.pair_counts))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text."""
        return np.add.reduceat(values, self.firsts) if len(self.firsts) else np.zeros(0, values.dtype)


def salted(kind: int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the three kinds share the buckets without meeting one another."""
    return mixed(hashes ^ FACTORS[60 + kind])


def bucket_of(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


#: Buckets of context counts: none, and one for each power of two.
CONTEXTS = 66
#: Relative frequencies are counted on a grid of sixteenths of an octave for the weights' sake; zero is apart.
STEPS = 16


def grid(values: np.ndarray) -> np.ndarray:
    """Grid place of each value from 2^-64 to 1: 0 for zero, else 1 and more."""
    with np.errstate(divide="ignore"):
        place = np.rint(-np.log2(values) * STEPS)
    return np.where(values > 0, 1 + np.minimum(place, 64 * STEPS), 0).astype(np.int64)


def ungrid(places: np.ndarray) -> np.ndarray:
    return np.where(places > 0, 2.0 ** (-(places - 1) / STEPS), 0.0)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and the whole part of log2 of its count."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)


def learn_weights(buckets: np.ndarray, f2: np.ndarray, f1: np.ndarray, n: np.ndarray, uniform: float, steps: int = 50) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each context bucket by expectation-maximisation on held-out counts.
    A bucket without held-out tokens keeps the weights of the nearest one below, or even thirds."""
    size = CONTEXTS
    weights = np.full((size, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    total = np.bincount(buckets, n, size)
    for _ in range(steps):
        w = weights[buckets]
        parts = w * np.stack([f2, f1, np.full(len(f1), uniform)], axis=1)
        parts *= (n / parts.sum(axis=1))[:, None]
        for j in range(3):
            gained = np.bincount(buckets, parts[:, j], size)
            weights[:, j] = np.where(total > 0, gained / np.maximum(total, 1e-300), weights[:, j])
    # a weight of zero would make an event impossible that training merely missed
    weights = np.maximum(weights, 1e-9)
    weights[0, 0] = 0.0
    weights /= weights.sum(axis=1, keepdims=True)
    for k in range(2, size):
        if total[k] == 0:
            weights[k] = weights[k - 1]
    return weights
