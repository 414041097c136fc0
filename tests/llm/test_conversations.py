import hashlib
import random
import re
import zlib

from tables import documents, plain

from sondage.llm import turn_repair
from sondage.llm.conversations import audit_conversations, damage, repair_digests, repaired_turns
from sondage.llm.queries import QUERIES

LETTERS = "suaoSUAO12345678"


def cheapest(symbols):
    """One row after the other; for each state the least cost and letters."""
    add = lambda best: {s: min([best[p] for p in [s] if p in best] + [(c + 3, x + "I") for p, (c, x) in best.items() if turn_repair.FREE[p] == s])
                        for s in set(best) | {turn_repair.FREE[p] for p in best}}
    best = {0: (0, "")}
    for symbol in symbols:
        following = {}
        for state, (c, x) in add(add(add(best))).items():
            for letter, more, to in turn_repair.single_edits(symbol, state):
                following[to] = min(following.get(to, (1 << 40, "")), (c + more, x + letter))
        best = following
    best = add(add(add(best)))
    return min(best[s] for s in (0, 3) if s in best)


def test_runs_against_single_steps():
    random.seed(11)
    for _ in range(5000):
        symbols = "".join(random.choice(LETTERS[: random.choice([2, 4, 8, 16])]) * random.choice([1, 1, 2, 5, 30]) for _ in range(random.randint(0, 9)))
        assert turn_repair.repair(symbols) == cheapest(symbols), symbols


def test_very_long_runs():
    cost, audit = turn_repair.repair("u" * 1_000_001 + "a" * 999_999)
    assert cost == cheapest_of_long(1_000_001, 999_999) and len(audit) >= 2_000_000


def cheapest_of_long(users, assistants):
    """Growth by two equal rows is the same from some length on."""
    small = {(u, a): cheapest("u" * u + "a" * a)[0] for u in (41, 43) for a in (39, 41)}
    per_user, per_assistant = (small[43, 39] - small[41, 39]), (small[41, 41] - small[41, 39])
    return small[41, 39] + per_user * (users - 41) // 2 + per_assistant * (assistants - 39) // 2


def independent(rows):
    """The contract for one conversation's (turn, role, text) rows, with nulls already one space."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in out:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "ok")
        seen.add((role, text))
    groups = {"ok": turn_repair.OK, "truncated": turn_repair.TRUNCATED, "blank": turn_repair.BLANK, "duplicate": turn_repair.DUPLICATE}
    cost, audit = cheapest("".join(groups[f]["sua".find(r[1][:1] or "?")] for f, r in zip(faults, out)))
    turns, last, queue = [], "", list(out)
    for letter in audit:
        free = "assistant" if last == "u" else "user"
        row = queue.pop(0) if letter != "I" else (0, free, "")
        if letter != "D":
            turns.append((row[1] if letter == "K" else free, row[2]))
            last = turns[-1][0][0]
    known = [t for t, _, _ in out if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), turns


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    expected = {c: independent(g) for c, g in groups.items()}
    got = {r["conv_id"]: r for r in repair_digests(damage(df), present="present").collect()}
    assert set(got) == set(expected)
    for c, (facts, _) in expected.items():
        assert tuple(got[c][n] for n in COLUMNS[1:]) == facts, c
    turns = {}
    for c, place, role, text in plain(repaired_turns(damage(df), present="present")):
        turns.setdefault(c, []).append((role, text))
        assert place == len(turns[c]) - 1
    assert turns == {c: t for c, (_, t) in expected.items() if t}


def test_given_conversations(spark):
    compare(documents(spark, name="conversations"))


def test_messy_conversations(spark):
    random.seed(2)
    texts = ["", None, "  \n", "So it is.", "and then", "What?  \n", "é\U0001f600!", "x " * 50_000 + "end."]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]
    rows = [(random.choice([None, 1, 2, 3, 4, 5]), random.choice([None, 0, 1, 2, 5, 5000, -3]), random.choice(roles), random.choice(texts)) for _ in range(120)]
    rows += [(7, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(3000)] + [(8, 4, "user", "same.")] * 500
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, kind).selectExpr("*", "'x' as c", "'y' as t", "'z' as k", "'p' as facts", "'d' as digest").repartition(4)
    compare(df)
    assert repair_digests(damage(df.limit(0)), present="present").count() == 0
    assert audit_conversations(df.limit(0)).count() == repaired_turns(df.limit(0)).count() == 0


def test_query_columns(spark):
    assert sorted(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001").columns) == sorted(COLUMNS)
