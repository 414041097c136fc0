"""Word shingles as sets of 64-bit hashes, and DivideSkip over inverted lists; free of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

def _factors(n: int) -> np.ndarray:
    """Odd factors, one for each place in a shingle: outputs of the public SplitMix64 generator, made odd."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) | np.uint64(1)


FACTORS = _factors(64)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(32)) * FACTORS[40]
    z = (z ^ z >> np.uint64(29)) * FACTORS[41]
    return z ^ z >> np.uint64(32)


class WordHashes(dict):
    """Hashes of words, each computed once; emptied now and then, so that it stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Words are what white space of ASCII separates, with A-Z in lower case."""
        words = text.lower().split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordTable:
    """Hashes of all words of some bytes at once: a word's hash is the sum of numbers that a table holds for each of its
    letters at its place, A-Z as a-z; words of more than LONGEST bytes are hashed one by one."""

    LONGEST = 64
    #: Bytes that are hashed together.
    PIECE = 1 << 18

    def __init__(self):
        self.letters = mixed(np.arange(1, self.LONGEST * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 256)
        self.letters[:, 65:91] = self.letters[:, 97:123]
        self.letters = self.letters.ravel()
        self.inside = np.ones(256, dtype=bool)
        self.inside[[9, 10, 11, 12, 13, 32]] = False

    def _piece(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and beginnings of the words; a word begins at each of `first`, too, unless there is white space."""
        inside = self.inside[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first] = inside[first]
        at = np.flatnonzero(begins)
        if not len(at):
            return np.empty(0, dtype=np.uint64), at
        used = data[inside]
        starts = (np.cumsum(inside) - 1)[at]
        lengths = np.diff(starts, append=len(used))
        place = np.arange(len(used)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat(self.letters[np.minimum(place, self.LONGEST - 1) * 256 + used], starts)
        for k in np.flatnonzero(lengths > self.LONGEST).tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(used[starts[k] : starts[k] + lengths[k]].tobytes().lower())
        return hashes, at

    def of(self, data: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        """The words' hashes of each text; text k is data[cuts[k] : cuts[k + 1]]."""
        k, n = 0, len(cuts) - 1
        while k < n:
            upto = max(k + 1, int(np.searchsorted(cuts, cuts[k] + self.PIECE, "right")) - 1)
            start, end = int(cuts[k]), int(cuts[upto])
            if end - start <= self.PIECE:
                first = cuts[k:upto] - start
                hashes, at = self._piece(data[start:end], first[first < end - start])
                bounds = np.searchsorted(at, [*first, end - start])
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    yield hashes[a:b]
            else:  # one long text, cut where white space is
                found = []
                while start < end:
                    stop = min(start + self.PIECE, end)
                    while stop < end and len(gaps := np.flatnonzero(~self.inside[data[start:stop]])) == 0:
                        stop = min(stop + self.PIECE, end)
                    if stop < end:
                        stop = start + int(gaps[-1]) + 1
                    found.append(self._piece(data[start:stop], np.zeros(1, dtype=np.int64))[0])
                    start = stop
                yield np.concatenate(found)
            k = upto


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of k (up to 39) words; the whole sequence as one if it is shorter; nothing of nothing."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    total = np.full(n - size + 1, FACTORS[42 + size % 20], dtype=np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * FACTORS[j]
    found = np.sort(mixed(total))
    return found[np.r_[True, found[1:] != found[:-1]]]


def name_of(values: np.ndarray) -> bytes:
    """Sixteen bytes that stand for a set."""
    return xxhash.xxh3_128_digest(values.tobytes())


def similar(common: int, a: int, b: int, percent: int = 80) -> bool:
    return 100 * common >= percent * (a + b - common)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index:
    """Inverted lists over documents given by their common shingles and their full set sizes."""

    #: Entries of lists or documents that are looked at together.
    MOST = 1 << 18

    def __init__(self, rows: list[tuple[np.ndarray, int]]):
        sets = [np.asarray(shingles, dtype=np.int64) for shingles, _ in rows]
        self.sizes = np.array([n for _, n in rows], dtype=np.int64)
        self.lengths = np.array([len(s) for s in sets], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.shingles, terms = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *sets]), return_inverse=True)
        self.terms = terms.astype(np.int32)
        self.docs = np.repeat(np.arange(len(sets), dtype=np.int32), self.lengths)[np.argsort(terms, kind="stable")]
        self.many = np.bincount(terms, minlength=len(self.shingles))
        self.starts = np.cumsum(self.many) - self.many
        self.marked = np.zeros(len(self.shingles), dtype=bool)

    def _pieces(self, lengths: np.ndarray):
        """Bounds of neighbours that have at most MOST entries together, or one alone."""
        ends, a = np.cumsum(lengths), 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.MOST, "right")))
            yield a, b
            a = b

    def search(self, shingles: np.ndarray, size: int, percent: int = 80):
        """Yields (document, overlap) of every document similar enough, by DivideSkip.

        A partner shares at least T = percent of `size` shingles. The longest lists are set aside; the others are merged
        by counting, and a document that occurs there in T less the lists aside, T being what its own size asks for, is
        probed for in those: its own shingles are held against the marked lists.
        """
        least = -(-percent * size // 100)
        shingles = np.asarray(shingles, dtype=np.int64)
        if not len(self.shingles) or len(shingles) < least:
            return
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        lists = at[self.shingles[at] == shingles]
        if len(lists) < least:
            return
        lists = lists[np.argsort(self.many[lists], kind="stable")]
        longest = int(self.many[lists[-1]])
        aside = min(least - 1, max(0, int(least / (0.02 * np.log2(longest + 1) + 1))))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        counts = np.zeros(len(self.sizes), dtype=np.int64)
        for a, b in self._pieces(self.many[short]):
            counts += np.bincount(self.docs[_runs(self.starts[short[a:b]], self.many[short[a:b]])], minlength=len(counts))
        need = np.maximum(least, -(-percent * (size + self.sizes) // (100 + percent)))
        near = np.flatnonzero(counts + aside >= need)
        self.marked[long] = True
        for a, b in self._pieces(self.lengths[near]):
            docs = near[a:b]
            own = self.marked[self.terms[_runs(self.first[docs], self.lengths[docs])]]
            counts[docs] += np.add.reduceat(own, np.cumsum(self.lengths[docs]) - self.lengths[docs], dtype=np.int64)
        self.marked[long] = False
        total = counts[near]
        good = (total >= need[near]) & similar(total, size, self.sizes[near], percent)
        yield from zip(near[good].tolist(), total[good].tolist())


class Groups:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up, self.many = list(range(n)), n

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.many -= 1
        return True
