"""Passages that documents share, cut out by chunks whose boundaries the content chooses."""

import random
import re

import pytest
from tables import documents, messy

from sondage.llm.chunking import GEAR, LEAST_WORDS, line_chunks
from sondage.llm.line_dedup import remove_repeated_lines
from sondage.llm.queries import op9_line_dedup

SF = "/root/testdata/sf0.001"


def chunks(text):
    """Chunks of a text, byte by byte: units, then boundaries at units of the lowest hash, then small ones join."""
    gear = [sum(int(GEAR[b]) << age for age, b in enumerate(reversed(text[max(0, k - 7) : k + 1]))) % 2**32 for k in range(len(text))]
    units, h, start = [], [], 0
    for k, byte in enumerate(text):
        if byte == 10 or (byte == 32 and (text[k - 1 : k] in list(map(bytes, zip(b".!?,;:"))) or gear[k] >> 30 == 0)) or k + 1 == len(text):
            units.append(text[start : k + 1])
            h.append(sum(gear[start : k + 1]) % 2**32)
            start = k + 1
    groups, current = [], []
    for k, unit in enumerate(units):
        current.append(unit)
        if k + 1 == len(units) or (k and h[k] < h[k - 1] and h[k] < h[k + 1]):
            groups.append(current)
            current = []
    out = []
    passage = lambda group: sum(started(u) > 0 for u in group) > 1 and started(b"".join(group)) >= LEAST_WORDS
    for group in groups:
        if out and not (passage(group) and passage(out[-1])):
            out[-1] = out[-1] + group
        else:
            out.append(group)
    return [(b"".join(group), passage(group)) for group in out]


def started(part):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", part))


def without_repeats(rows):
    """Texts by id after the removal of what stands earlier; rows in the order of their ids."""
    seen, want = set(), {}
    for doc_id, text in rows:
        kept = []
        for part, passage in chunks((text or "").encode()):
            if passage and part in seen:
                continue
            seen.add(part)
            kept.append(part)
        want[doc_id] = b"".join(kept).decode()
    return want


def test_chunks_against_single_steps():
    texts = [t.encode() for _, t in [(r, "one. two, three\n\n four five six seven eight nine ten eleven twelve; thirteen " * r) for r in range(6)]]
    rng = random.Random(8)
    texts += ["".join(rng.choices(["ab", "c", " ", ". ", "\n", ",", "é", "word "], k=rng.randint(0, 200))).encode() for _ in range(300)]
    for text in texts:
        want, at = [], 0
        for part, passage in chunks(text):
            want.append((at, at + len(part), passage))
            at += len(part)
        assert line_chunks(text) == want


def test_the_query_cuts_what_brute_force_cuts(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    got = {r["doc_id"]: r["text"] for r in op9_line_dedup(spark, SF).collect()}
    assert got == without_repeats(rows) and any(got[k] != t for k, t in rows)


def test_whole_copies_go_and_null_stays(spark):
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["text"] for r in remove_repeated_lines(messy(spark)).collect()}
    assert got[5, None] is None and got[4, ""] == ""


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


@pytest.mark.parametrize("n_lines", [1, 2, 3, 5, 8, 12])
def test_planted_passages_are_found(spark, n_lines):
    """Pairs of documents that share a passage of 51 to 60 words and nothing else."""
    rng, rows, pairs = random.Random(n_lines), [], 100
    for k in range(pairs):
        total = rng.randint(51, 60)
        passage = [words(rng, total // n_lines + (j < total % n_lines)) for j in range(n_lines)]
        for side in (0, 1):
            own = [words(rng, rng.choice([2, 5, 9, 28, 60])) for _ in range(8)]
            at = rng.randint(0, 8)
            rows.append((2 * k + side, "\n".join(own[:at] + passage + own[at:]), "\n".join(passage)))
    text, passages = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    cut = {r["row"]["doc_id"]: r for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, passage string"), keep=["doc_id"]).collect()}
    assert all(cut[2 * k]["text"] == text[2 * k] for k in range(pairs))
    assert sum(bool(cut[2 * k + 1]["removed"]) for k in range(pairs)) >= 90
    for k in range(pairs):
        doc = text[2 * k + 1].encode()
        for a, b in cut[2 * k + 1]["removed"]:
            assert set(doc[a:b].split()) <= set(passages[2 * k + 1].encode().split())
