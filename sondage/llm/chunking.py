"""Content-defined chunks of bytes and of lines; free of Spark."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1


def _scrambled(k: int) -> int:
    """The k-th output of the public SplitMix64 generator started at 0."""
    z = (k + 1) * 0x9E3779B97F4A7C15 & MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


GEAR = np.array([_scrambled(b) >> 32 for b in range(256)], dtype=np.uint32)


def gear_hashes(data: np.ndarray, doublings: int = 5) -> np.ndarray:
    """The gear hash h = 2h + gear[byte] mod 2^32 at every byte: it depends on the last 32 bytes alone, so it is summed
    by doubling the window instead of byte by byte. Fewer doublings end the sum at 2^doublings bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16)[:doublings]:
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return h


def cut_points(text: bytes, average_bits: int = 5, least: int = 16, most: int = 256) -> list[int]:
    """Ends of the chunks of a text: where the top bits of the gear hash are zero, `least` to `most` bytes apart."""
    found = np.flatnonzero(gear_hashes(np.frombuffer(text, np.uint8)) >> np.uint32(32 - average_bits) == 0) + 1
    cuts, last, size = [], 0, len(text)
    for at in [*found.tolist(), size]:
        while at - last > most:
            last += most
            cuts.append(last)
        if at - last >= least or (at == size and at > last):
            cuts.append(at)
            last = at
    return cuts


#: Bytes after which, if a space follows, a line is cut; the top bits of the gear hash at the other spaces that cut it.
STOPS, CLAUSE_BITS = b".!?,;:", 2
#: Words that a chunk needs to count as a passage.
LEAST_WORDS = 7
IS_STOP, IS_WHITE = (np.isin(np.arange(256), list(kind)) for kind in (STOPS, b" \t\n\x0b\x0c\r"))


def line_units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the units of a text, their words and hashes: lines, long ones cut into clauses.

    A line feed ends a unit, so does a space after a stop, and a space at which the gear hash of the last 8 bytes has its
    top bits zero: every fourth word or so, chosen by what is written there. A unit's hash sums the gear hashes of its bytes.
    """
    data = np.frombuffer(text, np.uint8)
    gear, white, space = gear_hashes(data, 3), IS_WHITE[data], data == 32
    cut = gear < np.uint32(1 << 32 - CLAUSE_BITS)
    cut[1:] |= IS_STOP[data[:-1]]
    cut &= space
    cut |= data == 10
    cut[-1] = True
    ends = cut.nonzero()[0] + 1
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1]
    begun = ~white
    begun[1:] &= white[:-1]
    return ends, np.add.reduceat(begun, starts, dtype=np.int32), np.add.reduceat(gear, starts, dtype=np.uint32)


def line_chunks(text: bytes, least: int = LEAST_WORDS) -> list[tuple[int, int, bool]]:
    """Chunks of units as half-open byte ranges, with whether they can count as repeats: several units of `least` words.

    A chunk ends after a unit whose hash is below those of the units before and after it. So a boundary depends on three
    units and on nothing before them, no two are neighbours, and the boundaries inside a passage are the same wherever it
    stands, but for those at its ends. A chunk of fewer words joins the one before it, at the start of a text the one
    after it, so a copied text is made of repeats alone; only a text of fewer words has none.
    """
    if not text:
        return []
    ends, words, hashes = line_units(text)
    # few calls: most texts are short, so what counts is the number of calls
    chosen = np.ones(len(ends), dtype=bool)
    chosen[:-1] = hashes[:-1] < hashes[1:]
    chosen[1:-1] &= hashes[1:-1] < hashes[:-2]
    chosen[0] &= len(ends) == 1
    at = chosen.nonzero()[0]
    many, units = words.cumsum()[at], (words > 0).cumsum()[at]
    enough = ((many >= least) & (units > 1)).nonzero()[0]
    if not len(enough):
        return [(0, len(text), False)]
    # the first chunk takes as much as it needs; after it every part that is large enough starts one
    first = enough[0] + 1
    large = (many[first:] - many[first - 1 : -1] >= least) & (units[first:] - units[first - 1 : -1] > 1)
    stops = ends[at[large.nonzero()[0] + first - 1]].tolist()
    stops.append(len(text))
    return [(a, b, True) for a, b in zip([0, *stops], stops)]


def digests(parts: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two signed longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype=">i8").reshape(-1, 2).astype(np.int64)
