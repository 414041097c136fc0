"""Small NumPy steps that run inside Spark tasks on one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

MAX_LEVELS = 4096


def _flatten(lists) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    owner = np.repeat(np.arange(len(lists)), lengths)
    flat = np.concatenate([np.asarray(x) for x in lists]) if len(lists) else np.empty(0)
    return owner, flat


def pair_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joint answer counts of every item pair: one-hot columns, then their Gram matrix.

    No row is made per respondent and pair; a batch gives at most one row per
    pair of scale points.
    """
    for pdf in batches:
        for run_id, part in pdf.groupby("run_id", sort=False):
            widest = max(1, int(part["pos"].map(len).max()))
            distinct = len(np.unique(_flatten(part["pos"].tolist())[1])) * 64
            step = len(part) if distinct <= MAX_LEVELS else max(1, MAX_LEVELS // widest)
            for start in range(0, len(part), step):
                block = part.iloc[start : start + step]
                owner, pos = _flatten(block["pos"].tolist())
                _, value = _flatten(block["value"].tolist())
                levels, code = np.unique(np.column_stack([pos, value]), axis=0, return_inverse=True)
                code = code.reshape(-1)
                if len(levels) > MAX_LEVELS and len(block) > 1:
                    pieces = _small_blocks(owner, code, len(levels), len(block), widest)
                else:
                    pieces = [(owner, code, len(block))]
                for who, codes, size in pieces:
                    used, local = np.unique(codes, return_inverse=True)
                    hot = np.zeros((size, len(used)), dtype=np.float32)
                    hot[who, local.reshape(-1)] = 1.0
                    left, right = np.nonzero(np.triu(gram := hot.T @ hot, 1))
                    a, b = levels[used[left]], levels[used[right]]
                    yield pd.DataFrame(
                        {
                            "run_id": run_id,
                            "pos_a": a[:, 0].astype("int32"),
                            "pos_b": b[:, 0].astype("int32"),
                            "va": a[:, 1],
                            "vb": b[:, 1],
                            "n": gram[left, right].astype("int64"),
                        }
                    )


def _small_blocks(owner, code, n_levels, n_rows, widest):
    """Cut a block with many distinct values so each Gram matrix stays small."""
    step = max(1, MAX_LEVELS // widest)
    for start in range(0, n_rows, step):
        mask = (owner >= start) & (owner < start + step)
        yield owner[mask] - start, code[mask], min(step, n_rows - start)


def quadrature(nodes: int, span: float) -> tuple[np.ndarray, np.ndarray]:
    theta = np.linspace(-span, span, nodes)
    weight = np.exp(-0.5 * theta**2)
    return theta, weight / weight.sum()


def _probabilities(a, b, theta):
    z = np.clip(a[:, None] * (theta[None, :] - b[:, None]), -30, 30)
    return np.clip(1.0 / (1.0 + np.exp(-z)), 1e-9, 1 - 1e-9)


def _answers(part, names):
    """Answered and right-answer indicator matrices, patterns by items."""
    place = {name: i for i, name in enumerate(names)}
    owner, items = _flatten(part["items"].tolist())
    _, answers = _flatten(part["ys"].tolist())
    column = np.fromiter((place[i] for i in items), dtype=np.int64, count=len(items))
    seen = np.zeros((len(part), len(names)))
    right = np.zeros_like(seen)
    seen[owner, column] = 1.0
    right[owner, column] = answers.astype(float)
    return seen, right


def _node_weights(seen, right, a, b, theta, prior):
    """Posterior over the nodes for every pattern."""
    p = _probabilities(a, b, theta)
    log_like = right @ np.log(p) + (seen - right) @ np.log(1 - p) + np.log(prior)[None, :]
    post = np.exp(log_like - log_like.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def _posterior(part, theta, prior):
    """The run's parameters come with the rows."""
    names, a, b = [part[c].iloc[0] for c in ("param_item", "param_a", "param_b")]
    names = list(names)
    seen, right = _answers(part, names)
    return names, seen, right, _node_weights(seen, right, np.asarray(a, dtype=float), np.asarray(b, dtype=float), theta, prior)


def expected_counts(nodes: int, span: float):
    """E-step over response patterns: expected answers and right answers per item and node."""
    theta, prior = quadrature(nodes, span)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_id, part in pdf.groupby("run_id", sort=False):
                names, seen, right, post = _posterior(part, theta, prior)
                post = post * part["n"].to_numpy(dtype=float)[:, None]
                n, r = seen.T @ post, right.T @ post
                out = {"run_id": run_id, "item": names}
                out |= {f"r{q}": r[:, q] for q in range(nodes)} | {f"n{q}": n[:, q] for q in range(nodes)}
                yield pd.DataFrame(out)

    return step


HELD_RUNS = 1000
STATE = ["run_id", "param_item", "param_a", "param_b", "slices", "iterations", "converged", "open"]


def _sums(seen, right, n, a, b, theta, prior):
    """Expected right answers and answers, by item and node."""
    post = _node_weights(seen, right, a, b, theta, prior) * n[:, None]
    return np.stack([right.T @ post, seen.T @ post])


def run_steps(nodes: int, span: float, tolerance: float, max_iterations: int, bounds_a, bounds_b):
    """E-step for rows that carry their run's parameters and follow each other by run; one row per run and task.

    A slice of a run gives the sums of its patterns. A run of one slice lies here whole, at most the patterns of a slice:
    its further steps need nobody else, so they are taken at once, and it has no sums.
    """
    theta, prior = quadrature(nodes, span)

    def settle(head, seen, right, n):
        a, b = np.asarray(head["param_a"], dtype=float), np.asarray(head["param_b"], dtype=float)
        while head["open"] and head["iterations"] < max_iterations:
            r, answered = _sums(seen, right, n, a, b, theta, prior)
            old = a
            a, b = newton(r, answered, a, b, theta, bounds_a, bounds_b)
            settled = bool(np.max(np.abs(a - old)) < tolerance)
            head |= {"iterations": head["iterations"] + 1, "converged": settled, "open": not settled}
        return {**head, "param_a": a, "param_b": b, "counts": None}

    def parts_of(batches):
        for pdf in batches:
            for run_id, part in pdf.groupby("run_id", sort=False):
                names, head = list(part["param_item"].iloc[0]), part.iloc[0][STATE].to_dict()
                yield run_id, head, *_answers(part, names), part["n"].to_numpy(dtype=float)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, sums, current, whole = [], None, None, []

        def close():
            if whole:
                done.append(settle(current[1], *[np.concatenate(x) for x in zip(*whole)]))
            elif current is not None:
                done.append({**current[1], "counts": sums.ravel()})

        for run_id, head, seen, right, n in parts_of(batches):
            if current is None or run_id != current[0]:
                close()
                current, sums, whole = (run_id, head), 0.0, []
                if len(done) >= HELD_RUNS:
                    yield pd.DataFrame(done)
                    done = []
            if head["slices"] == 1:
                whole.append((seen, right, n))
            else:
                sums = sums + _sums(seen, right, n, np.asarray(head["param_a"]), np.asarray(head["param_b"]), theta, prior)
        close()
        if done:
            yield pd.DataFrame(done)

    return step


def improve_runs(nodes: int, span: float, tolerance: float, bounds_a, bounds_b):
    """M-step for runs of several slices, a batch of runs at once; a run closes when none of its slopes moves by
    `tolerance`. Runs without sums have taken their steps."""
    theta, _ = quadrature(nodes, span)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            summed = pdf["counts"].map(len) > 0
            yield pdf.loc[~summed, STATE]
            pdf = pdf[summed]
            if pdf.empty:
                continue
            sizes = pdf["param_item"].map(len).to_numpy()
            counts = [np.sum([np.asarray(c) for c in parts], axis=0).reshape(2, m, nodes) for parts, m in zip(pdf["counts"], sizes)]
            r, n = np.concatenate(counts, axis=1)
            old = np.concatenate(pdf["param_a"].tolist())
            a, b = newton(r, n, old, np.concatenate(pdf["param_b"].tolist()), theta, bounds_a, bounds_b)
            cuts = np.cumsum(sizes)[:-1]
            settled = np.array([np.max(c) < tolerance for c in np.split(np.abs(a - old), cuts)])
            yield pdf[STATE].assign(
                param_a=np.split(a, cuts), param_b=np.split(b, cuts), iterations=pdf["iterations"] + 1, converged=settled, open=~settled)

    return step


def abilities(nodes: int, span: float):
    """Posterior mean of the latent trait per response pattern."""
    theta, prior = quadrature(nodes, span)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_id, part in pdf.groupby("run_id", sort=False):
                post = _posterior(part, theta, prior)[3]
                yield pd.DataFrame({"run_id": run_id, "persona_id": part["persona_id"].to_numpy(), "theta": post @ theta})

    return step


def newton(r, n, a, b, theta, bounds_a, bounds_b, rounds=6):
    """M-step: Newton on slope and intercept of every item at once, kept inside the bounds."""
    for _ in range(rounds):
        p = _probabilities(a, b, theta)
        miss, info = r - n * p, n * p * (1 - p)
        g_a, g_c = miss @ theta, miss.sum(axis=1)
        h_aa, h_ac, h_cc = info @ theta**2 + 1e-9, info @ theta, info.sum(axis=1) + 1e-9
        det = np.maximum(h_aa * h_cc - h_ac**2, 1e-12)
        c = -a * b + np.clip((h_aa * g_c - h_ac * g_a) / det, -1.5, 1.5)
        a = np.clip(a + np.clip((h_cc * g_a - h_ac * g_c) / det, -1.0, 1.0), *bounds_a)
        b = np.clip(-c / a, *bounds_b)
    return a, b
