"""What the Jaccard join does over arrays: words of many texts, coded runs of numbers, the search in a large family."""

import random
import time

import numpy as np
import pyarrow as pa

from sondage.llm import shingles as sh
from sondage.llm.near_join import _bytes_of, _coded, _cuts, _decoded

TEXTS = [b"", b" ", b"A b", b"a B", b"ab", b"x" * 70 + b" " + b"X" * 70, b"\x85 \xa0 a\x1cb", b"a\x00b", None, b"end", b"start " + b"q" * 999, b""]


def test_words_are_those_of_the_plain_split():
    draw, table = random.Random(2), sh.WordTable()
    texts = TEXTS + [bytes(draw.choice(b"aB \n\tc\x0b\x1c") for _ in range(draw.randrange(200))) for _ in range(200)] + [None]
    for piece in (1, 7, 50, 1 << 18):
        table.PIECE, known = piece, {}
        found = list(table.of(*_bytes_of(pa.array([b"cut off", *texts]).slice(1))))
        assert len(found) == len(texts)
        for hashes, text in zip(found, texts):
            words = (text or b"").lower().split()
            assert len(words) == len(hashes) and all(known.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
        assert len(set(known.values())) == len(known)
    assert [len(x) for x in table.of(*_bytes_of(pa.array([None, b""], pa.binary())))] == [0, 0]


def test_coded_runs_come_back():
    draw = np.random.default_rng(1)
    for top in (1, 3, 300, 70_000, 20_000_000):
        for _ in range(50):
            runs = [np.sort(draw.integers(0, top, size=draw.integers(0, 9))) for _ in range(draw.integers(1, 9))]
            cuts, numbers = _cuts([len(r) for r in runs]), np.concatenate(runs)
            got, bounds = _decoded(pa.concat_arrays([pa.array([b"other"]), _coded(numbers, cuts)]).slice(1))
            assert got.tolist() == numbers.tolist() and bounds.tolist() == cuts.tolist()


def test_search_in_a_large_family_takes_a_few_microseconds_a_pair():
    """Near copies of one text share most lists, and most of those too far from its centre link with nothing."""
    draw = np.random.default_rng(3)
    base = draw.integers(-(1 << 62), 1 << 62, size=400)

    def copy(edits):
        own = base.copy()
        own[draw.permutation(400)[: 5 * edits]] = draw.integers(-(1 << 62), 1 << 62, size=5 * edits)
        return own

    docs = [copy(int(k)) for k in draw.integers(1, 16, size=1200)]
    asked = [copy(int(k)) for k in draw.integers(5, 16, size=300)]
    began = time.process_time()
    index = sh.Index([(d, len(d)) for d in docs])
    found = [dict(index.search(a, len(a))) for a in asked]
    assert time.process_time() - began < 6
    for a, got in zip(asked[::20], found[::20]):
        common = [len(np.intersect1d(a, d)) for d in docs]
        assert got == {k: c for k, c in enumerate(common) if sh.similar(c, len(a), len(docs[k]))}
    assert any(found)
