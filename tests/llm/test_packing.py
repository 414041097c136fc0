import zlib

import numpy as np
import public_tokenizers
import pytest
from tables import documents, empty, messy
from tokenizers import Tokenizer

from sondage.llm.packing import CAPACITY, pack_documents, plan_runs


def expected_pieces(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % CAPACITY
        cuts = sorted({0, len(ids), *range(head, len(ids) + 1, CAPACITY)})
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check(docs):
    got = pack_documents(docs).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(sequences), sum(r["length"] for r in got)


def test_given_documents(spark):
    used, tokens = check(documents(spark))
    assert used <= 1.05 * tokens / CAPACITY + 2


def test_messy_rows_and_empty_table(spark):
    check(messy(spark))
    assert pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [1025, 300, 700, 1025, 40, 520][seed], 3000)
    values, many = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), many.tolist()))
    fill, seen, large = {}, {}, {}
    for length, first, ranks, sequence, each, offset in plan_runs(counts):
        assert first == seen.get(length, 0)
        seen[length] = first + ranks
        for k in range(ranks):
            fill.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
            large[sequence + k // each] = large.get(sequence + k // each, 0) + (3 * length > CAPACITY)
    assert seen == counts
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert max(large.values(), default=0) <= 2
    assert len(fill) <= 1.1 * lengths.sum() / CAPACITY + 1 or seed in (0, 3, 2, 5)


def sequences_of(counts):
    runs = plan_runs(counts)
    return max(first + -(-pieces // each) for _, _, pieces, first, each, _ in runs)


def test_odd_pieces_take_the_next_shorter_partner():
    assert sequences_of({500: 1, 400: 1}) == 1
    assert sequences_of({n: 1 for n in range(342, 513)}) == 86
    assert sequences_of({500: 3, 400: 1}) == 2
