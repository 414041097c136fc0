import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import CLASHES, PASSAGE, documents, empty, messy

from sondage.llm import chunking
from sondage.llm.line_dedup import drop_repeated_lines, remove_repeated_lines
from sondage.llm.substring_dedup import repeated_spans


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_cut_points_partition_the_text(data):
    cuts = chunking.cut_points(data)
    assert cuts == sorted(set(cuts)) and (cuts[-1:] or [0])[0] == len(data)
    sizes = np.diff([0, *cuts])
    assert all(s <= 256 for s in sizes) and all(s >= 16 for s in sizes[:-1])
    h, table, rolled = 0, chunking.GEAR.tolist(), []
    for byte in data:
        h = (2 * h + table[byte]) & 0xFFFFFFFF
        rolled.append(h)
    assert chunking.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == rolled


def test_chunks_resist_insertions():
    body = " ".join(f"token{k * 31 % 977}" for k in range(900)).encode()
    shifted = b"inserted at the front " + body
    pieces = lambda t: {t[a:b] for a, b in zip([0, *chunking.cut_points(t)], chunking.cut_points(t))}
    assert len(pieces(body) & pieces(shifted)) >= len(pieces(body)) - 3


def brute_spans(rows, least=100):
    first, found = {}, []
    chunks = []
    for doc_id, text in rows:
        data, at = (text or "").encode(), 0
        for end in chunking.cut_points(data):
            chunks.append((doc_id, text, at, data[at:end]))
            at = end
    for doc_id, _, _, piece in chunks:
        if doc_id is not None and (piece not in first or first[piece] is None or doc_id < first[piece]):
            first[piece] = doc_id
        first.setdefault(piece, None)
    per = {}
    for doc_id, text, at, piece in chunks:
        per.setdefault((doc_id, text), {})[at] = piece
    for (doc_id, _), pieces in per.items():
        seen, spans = set(), []
        for at in sorted(pieces):
            piece = pieces[at]
            if piece in seen or doc_id != first[piece]:
                if spans and spans[-1][0] + spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], spans[-1][1] + len(piece))
                else:
                    spans.append((at, len(piece)))
            seen.add(piece)
        found += [(doc_id, a, n) for a, n in spans if n >= least]
    return sorted(found, key=str)


def test_spans_match_brute_force(spark):
    for docs in (documents(spark), messy(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = [(r["doc_id"], r["start"], r["length"]) for r in repeated_spans(docs).collect()]
        assert sorted(got, key=str) == brute_spans(rows)
    assert repeated_spans(empty(spark)).count() == 0


def test_a_repeated_passage_is_found(spark):
    found = {r["doc_id"]: r for r in repeated_spans(messy(spark)).collect()}
    assert found[15]["first_doc_id"] == 14 and found[15]["length"] > len(PASSAGE) // 2 and 1 not in found


def test_messy_lines(spark):
    docs = messy(spark)
    rows = remove_repeated_lines(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["row"]["doc_id"]: r for r in rows}
    assert by_id[5]["text"] is None and by_id[5]["n_lines"] == 0 and by_id[4]["text"] == ""
    assert by_id[9]["removed"] != []  # it says the same 30 times
    assert by_id[14]["removed"] == [] and by_id[15]["removed"] != []
    whole = by_id[15]["row"]["text"]
    gone = sum(len(whole.encode()[a:b].split()) for a, b in by_id[15]["removed"])
    assert "something else first" in by_id[15]["text"] and gone > 0.5 * len(whole.split())
    kept = drop_repeated_lines(docs)
    assert kept.columns == docs.columns and set(CLASHES) < set(kept.columns) and kept.count() == docs.count()
    assert drop_repeated_lines(empty(spark)).count() == 0


def test_a_copy_goes_and_its_first_stays(spark):
    body = "alpha beta gamma\ndelta epsilon\nzeta eta theta\niota kappa"  # ten words on four lines
    docs = spark.createDataFrame([(2, body, 7), (1, body, 7), (3, "one line alone", 1)], "doc_id long, text string, n_chars long")
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in drop_repeated_lines(docs).collect()}
    assert kept[1] == (body, 7) and kept[3] == ("one line alone", 1)
    assert 2 not in kept
