"""Cheapest edits of a conversation's turns, by a run-length dynamic programme over min-plus matrices."""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

#: States of a repaired conversation so far: nothing, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn leads that is added or may take either role: after a user's comes an assistant's, after all else a user's.
FREE = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
ROLES = "sua"
#: Symbol of a row: its fault's letter for a role of initial s, u, a or another.
OK, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "1234", "5678"
ROLE_OF = {c: (s, "suao"[k]) for s in (OK, TRUNCATED, BLANK, DUPLICATE) for k, c in enumerate(s)}

Vector = tuple[int, int, int, int]


def keeps_to(symbol: str, state: int) -> int | None:
    """The state after keeping the row under its own role, where that is allowed."""
    role = ROLE_OF[symbol][1]
    if role == "s":
        return SYSTEM if state == START else None
    if role == "o":
        return None
    return FREE[state] if FREE[state] == (USER if role == "u" else ASSISTANT) else None


def single_edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done to one row, in the order of the letters."""
    group = ROLE_OF[symbol][0]
    out = [("D", DELETE, state)]
    if group in (OK, TRUNCATED):
        more = CUT_OFF if group == TRUNCATED else 0
        kept = keeps_to(symbol, state)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", RENAME + more, FREE[state]))
    return out


def inserted(after: Vector) -> Vector:
    """Least cost from each state where turns may be added first; two are the most that ever help."""
    best = list(after)
    for _ in range(3):
        best = [min(best[i], INSERT + best[FREE[i]]) for i in range(4)]
    return tuple(best)


END: Vector = inserted(tuple(0 if i in ENDS else NEVER for i in range(4)))


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple[Vector, ...]:
    """Least cost from state to state over 2^k rows of one symbol, added turns before each row included."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[i][m] + half[m][j] for m in range(4)) for j in range(4)) for i in range(4))
    columns = []
    for j in range(4):
        edited = tuple(min((c for _, c, to in single_edits(symbol, i) if to == j), default=NEVER) for i in range(4))
        columns.append(inserted(edited))
    return tuple(zip(*columns))


def advance(symbol: str, k: int, after: Vector) -> Vector:
    """Cost to go before 2^k rows of one symbol, from that behind them."""
    return tuple(min(step[j] + after[j] for j in range(4)) for step in power(symbol, k))


def _relative(v: Vector) -> Vector:
    least = min(v)
    return tuple(min(x - least, NEVER) for x in v)


@lru_cache(maxsize=1 << 14)
def repair_short(symbols: str) -> tuple[int, str, int]:
    """Cost, letters and illegal pairs of a conversation like many others."""
    return (*repair(symbols), illegal_pairs(symbols))


@lru_cache(maxsize=1 << 14)
def unroll(symbol: str, k: int, state: int, after: Vector) -> tuple[str, int]:
    """The least letters among the cheapest edits of 2^k rows from `state`, given the cost to go behind them, and the state then.

    Halves of a run meet the same relative costs again and again, so a long run has few different ones.
    """
    if k:
        first, middle = unroll(symbol, k - 1, state, _relative(advance(symbol, k - 1, after)))
        second, last = unroll(symbol, k - 1, middle, after)
        return first + second, last
    to_go, letters = power(symbol, 0), ""
    while True:
        best = min(to_go[state][j] + after[j] for j in range(4))
        # letters in order: D, I, K, R
        edits = [(letter, c + after[to], to, True) for letter, c, to in single_edits(symbol, state)]
        edits.append(("I", INSERT + min(to_go[FREE[state]][j] + after[j] for j in range(4)), FREE[state], False))
        letter, _, state, done = min(e for e in edits if e[1] == best)
        letters += letter
        if done:
            return letters, state


def repair(symbols: str) -> tuple[int, str]:
    """Least cost and the edits' letters for the rows of a conversation."""
    pieces = []
    for symbol, run in groupby(symbols):
        length = sum(1 for _ in run)
        pieces += [(symbol, k) for k in range(length.bit_length()) if length >> k & 1]
    behind = [END]
    for symbol, k in reversed(pieces):
        behind.append(advance(symbol, k, behind[-1]))
    cost, state, letters = behind.pop()[START], START, []
    for symbol, k in pieces:
        part, state = unroll(symbol, k, state, _relative(behind.pop()))
        letters.append(part)
    while state not in ENDS:
        letters.append("I")
        state = FREE[state]
    return cost, "".join(letters)


def illegal_pairs(symbols: str) -> int:
    """Neighbours whose initials are not those of system-user, user-assistant or assistant-user."""
    roles = [ROLE_OF[c][1] for c in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
