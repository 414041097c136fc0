"""Small tables with everything that goes wrong in real ones."""

from __future__ import annotations

LONG = " ".join(f"word{k * 7919 % 1000} the" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
SHARED = "\n".join(f"shared line number {k} is long enough" for k in range(16))
CASES = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs far away"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs far away"),
    (3, "the quick brown fox jumps over the lazy dog and runs far off"),
    (4, ""),
    (5, None),
    (6, "   \n\t \n"),
    (7, "É é x y ÀB àb"),
    (8, "É É x y ÀB àb"),
    (9, LONG),
    (10, LONG + " tail"),
    (None, "row without an id, of some words"),
    (None, "row without an id, of some words"),
    (11, "one"),
    (12, "ONE"),
    (13, "a\nline again\nline again\nline again\nline again\n\n\nend"),
    (14, PASSAGE + "\nfirst own line here\n" + SHARED),
    (15, "something else first\n" + SHARED + "\n" + PASSAGE),
    (16, "<|endoftext|> special \x00 \x85 text"),
    (2, "another text under a repeated id"),
]
#: Extra columns with names that the operators use for themselves.
CLASHES = ["row", "mark", "name", "n", "shingles", "part", "block", "length", "bucket", "score", "gone", "removed", "spans", "_salt", "norm"]


def messy(spark, cases=CASES):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, *([None] * len(CLASHES) if k % 3 else [f"x{k}"] * len(CLASHES))) for k, (i, t) in enumerate(cases)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


def empty(spark):
    return messy(spark).limit(0)


def plain(df, *keys):
    """Rows as sorted tuples, None first."""
    return sorted((tuple(r) for r in df.select(*(keys or df.columns)).collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def documents(spark, sf="sf0.001", name="documents"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
