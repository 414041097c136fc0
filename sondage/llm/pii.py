"""Personal data in texts: proposed by patterns, confirmed by checksums, weighed by the words around."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.llm import pii_rules
from sondage.llm.common import rows_with_text
from sondage.session import ship_by_value

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
COLUMNS = "spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"


def _scan(batch: pa.RecordBatch, place: int, least: float) -> Iterator[tuple[str, list]]:
    for text in batch.column(0).field(place):
        body = text.as_py() or ""
        yield body, pii_rules.find(body, least)


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, text: str = "text", least: float = pii_rules.LEAST) -> DataFrame:
    """Adds `spans` to `row`, a struct of the columns `keep` (all by default), so their names may be any.

    A span has its kind, start and end in code points (end exclusive), score, and whether it is a base one. Base kinds are
    email, ip (parts up to 255), card (13 to 19 digits that pass Luhn) and phone (9 to 15 digits after a plus); they are
    all kept, the score says how likely they are. Account numbers (mod 97) and national ids need a score of `least`, which
    words within 48 characters raise or lower, and may not overlap a base span. Spans are in the order of kinds, then starts.

    One pass in place, nothing is shuffled; a text takes time linear in its length. Null and empty texts have no spans,
    repeated rows have the same, an empty table returns no rows.
    """
    ship_by_value(pii_rules, sys.modules[__name__])
    rows, place = rows_with_text(docs, keep, text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score", "base")
        for batch in batches:
            found = [[dict(zip(names, s)) for s in spans] for _, spans in _scan(batch, place, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["row", "spans"])

    out = rows.mapInArrow(search, StructType([rows.schema["row"], *StructType.fromDDL(COLUMNS).fields]))
    kept = F.col("row") if keep is None or text in keep else F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    return out.withColumn("row", kept)


def redact(docs: DataFrame, text: str = "text", least: float = pii_rules.LEAST) -> DataFrame:
    """The documents, all their columns, with each span of personal data replaced by its kind in brackets. Where spans of
    two kinds overlap, the one that starts first is replaced up to the end of both. A null text stays null."""
    ship_by_value(pii_rules, sys.modules[__name__])
    rows, place = rows_with_text(docs, None, text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for (body, spans), known in zip(_scan(batch, place, least), batch.column(0).field(place).is_valid()):
                parts, at = [], 0
                for kind, start, end, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        parts += [body[at:start], f"[{kind}]"]
                    at = max(at, end)
                bodies.append("".join([*parts, body[at:]]) if known.as_py() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["row", "body"])

    out = rows.mapInArrow(replace, StructType([rows.schema["row"], *StructType.fromDDL("body string").fields]))
    return out.select(*[(F.col("body") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """The spans as `kind:start:end`, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
