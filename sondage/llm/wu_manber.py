"""Wu-Manber search over words, free of Spark: block shifts, suffix buckets, direct comparison."""

from __future__ import annotations

#: Bytes of words (0-9, a-z, all of 0x80 and above); A-Z become a-z, the rest separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Every run of `size` words; all words when there are fewer; nothing of nothing."""
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


class Matcher:
    """All windows of one length: `length` words each, read in blocks of two words (one, if the length is one)."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shifts: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}

    def add(self, window: tuple, item: str) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            block, shift = window[end - b : end], self.length - end
            self.shifts[block] = min(shift, self.shifts.get(block, shift))
        same_prefix = self.buckets.setdefault(window[-b:], {}).setdefault(window[:b], [])
        for known, items in same_prefix:
            if known == window:
                items.add(item)
                return
        same_prefix.append((window, {item}))

    def search(self, words: list[bytes]):
        """Yields (start, items) for every place where a window occurs."""
        m, b, shifts, at, n = self.length, self.block, self.shifts, self.length - 1, len(words)
        farthest = m - b + 1
        while at < n:
            block = (words[at - 1], words[at]) if b == 2 else (words[at],)
            shift = shifts.get(block, farthest)
            if shift:
                at += shift
                continue
            start = at - m + 1
            for window, items in self.buckets[block].get(tuple(words[start : start + b]), ()):
                if tuple(words[start : at + 1]) == window:
                    yield start, items
            at += 1


def build(items: list[tuple[str, bytes | None]], size: int) -> list[Matcher]:
    """One matcher per window length: all shorter lengths come from items shorter than `size`."""
    by_length: dict[int, Matcher] = {}
    for item, text in items:
        for window in windows_of(words_of(text), size):
            by_length.setdefault(len(window), Matcher(len(window))).add(window, item)
    return list(by_length.values())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, sorted and disjoint."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
