"""Structure of conversations: faults of their turns, the cheapest repair, and the repaired turns."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sondage.llm import turn_repair
from sondage.session import ship_by_value

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
#: Turn numbers whose rows are put in order together, as a power of two.
BLOCK_BITS = 10
#: Longest conversations, in rows, that are looked up among those already repaired.
SHORT = 64
#: Conversations that a task returns at once.
FLUSH = 4096
SUMMARY = StructType([StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField("audit", StringType())])


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, turn, role, text and present: rows damaged by the checksum of `conv_id:turn`, modulo 20: 0 is not
    present, 1 loses its text, 2 its full stops, exclamation and question marks, 3 is there twice, 4 has the role user.
    Null ids, turns, roles and texts count as one space; null ids and turns come out as null."""
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn))) % 20
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), one(role).alias("role"), one(text).alias("text"),
                     kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows under fixed names; `digest` puts rows of one turn and role in order."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return df.select(
        F.col(f"`{conv_id}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), body.alias("text"),
        F.unhex(F.md5(body)).alias("digest"), (F.lit(True) if present is None else F.col(f"`{present}`")).alias("present"))


def _pick(letters: str, role: Column) -> Column:
    """One letter by the initial of the role."""
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", letters[0]).when(initial == "u", letters[1]).when(initial == "a", letters[2]).otherwise(letters[3])


def turn_symbols(rows: DataFrame) -> DataFrame:
    """One row per conversation with a letter per turn, in order, for its role and fault.

    Only digests move. Equal rows are counted first; what is left of a conversation is spread by role and text while
    repeats are found, then by blocks of turn numbers while letters are put in order. A task gets a conversation whole
    only as one letter a row, no longer than the audit that it has to return for it.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("c", "t", "role", "digest", "present", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(*STOPS)).alias("open"))
    same = light.groupBy("c", "t", "role", "digest", "present", "blank", "open").agg(F.count(F.lit(1)).cast("int").alias("n"))
    seen = F.row_number().over(Window.partitionBy("c", "present", "role", "digest").orderBy(F.col("t").asc_nulls_first()))
    role = F.col("role")
    first = F.when(F.col("open"), _pick(turn_repair.TRUNCATED, role)).otherwise(_pick(turn_repair.OK, role))
    again = _pick(turn_repair.DUPLICATE, role)
    letters = F.when(F.col("blank"), F.repeat(_pick(turn_repair.BLANK, role), F.col("n"))).when(
        F.col("seen") > 1, F.repeat(again, F.col("n"))).otherwise(F.concat(first, F.repeat(again, F.col("n") - 1)))
    marked = same.withColumn("seen", seen).select("c", "t", "role", "digest", "present", letters.alias("letters"))
    there = F.col("present")
    blocks = marked.groupBy("c", F.shiftright(F.col("t").cast("long"), BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.when(there, F.struct("t", "role", "digest", "letters")))).alias("x"))
    parts = blocks.select("c", "block", F.array_join(F.col("x.letters"), "").alias("letters"), F.size(F.array_distinct(F.filter("x.t", lambda t: t.isNotNull()))).alias("turns"),
                          F.array_min("x.t").alias("low"), F.array_max("x.t").alias("high"))
    whole = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "letters"))).alias("x"), F.sum("turns").alias("turns"),
                                   F.min("low").alias("low"), F.max("high").alias("high"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("c", gaps.alias("gaps"), F.array_join(F.col("x.letters"), "").alias("letters"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = (turn_repair.BLANK, turn_repair.DUPLICATE, turn_repair.TRUNCATED)
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for letters in batch.column(2).to_pylist():
            counts = [sum(map(letters.count, group)) for group in groups]
            done = turn_repair.repair_short(letters) if len(letters) <= SHORT else (*turn_repair.repair(letters), turn_repair.illegal_pairs(letters))
            for column, value in zip(columns, (*counts, done[2], done[0], done[1])):
                column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["c", *SUMMARY.names])


class Stream:
    """Walks through conversations in order: first the audit, then the turns it speaks of. Memory is bounded by one audit."""

    def __init__(self, names: list[str], types: list[pa.DataType], digests: bool):
        self.names, self.types, self.digests = names, types, digests

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.out: list[tuple] = []
        self.head = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for c, facts, role, text in zip(*columns):
                if facts is not None:
                    self._close()
                    self.head, self.letters, self.at, self.state, self.place = (c, facts), facts["audit"], 0, turn_repair.START, 0
                    self.hash = hashlib.sha256()
                else:
                    self._turn(role, text)
                if len(self.out) >= FLUSH:
                    yield self._flush()
        self._close()
        yield self._flush()

    def _flush(self) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in self.out], kind) for i, kind in enumerate(self.types)]
        self.out = []
        return pa.RecordBatch.from_arrays(arrays, names=self.names)

    def _emit(self, role: str, text: str) -> None:
        if self.digests:
            self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        else:
            self.out.append((self.head[0], self.place, role, text))
        self.place += 1

    def _free(self, text: str) -> None:
        self.state = turn_repair.FREE[self.state]
        self._emit("user" if self.state == turn_repair.USER else "assistant", text)

    def _added(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self._free("")

    def _turn(self, role: str, text: str) -> None:
        self._added()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self._free(text)
        elif letter == "K":
            self.state = turn_repair.SYSTEM if role[:1] == "s" else turn_repair.FREE[self.state]
            self._emit(role, text)

    def _close(self) -> None:
        if self.head is not None:
            self._added()
            if self.digests:
                c, facts = self.head
                self.out.append((c, *[facts[n] for n in SUMMARY.names], self.hash.hexdigest()))


def _walk(rows: DataFrame, audits: DataFrame, digests: bool) -> DataFrame:
    kind = audits.schema["c"].dataType
    added = [*SUMMARY.fields, StructField("repaired_sha256", StringType())] if digests else [
        StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())]
    schema = StructType([StructField("c", kind), *added])
    heads = audits.select("c", F.struct(*SUMMARY.names).alias("facts"))
    turns = rows.where("present").select("c", F.lit(1).alias("k"), "t", "role", "digest", "text")
    both = heads.withColumn("k", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    ordered = both.repartition("c").sortWithinPartitions("c", "k", F.col("t").asc_nulls_first(), "role", "digest").select("c", "facts", "role", "text")
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(Stream(arrow.names, arrow.types, digests), schema)


def _audits(rows: DataFrame) -> DataFrame:
    symbols = turn_symbols(rows)
    return symbols.mapInArrow(_summaries, StructType([symbols.schema["c"], *SUMMARY.fields]))


def _ship() -> None:
    ship_by_value(turn_repair, sys.modules[__name__])


def audit_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                        present: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    Rows count in the order of their turn (null first), then role, then the text's digest. A row's fault is the first
    of: blank (white space only), duplicate (role and text seen before in the conversation), truncated (the last
    character that is not white space is no full stop, exclamation or question mark). `gaps` are the numbers missing
    between the first and the last turn, `illegal` the neighbours whose roles' initials are not su, ua or au.

    The audit has a letter for each edit, in order, of the cheapest repair that leaves nothing, or turns of user and
    assistant by turns after at most one of the system: K keeps a row, R (3) gives it the role user or assistant,
    D (4) deletes it, I (3) adds an empty turn; blank and duplicate rows must go, truncated ones that stay cost 3.
    Of equally cheap audits it is the least. Runs of equal letters are passed in steps of powers of two.

    Null roles and texts count as one space, an empty role as an unknown one. Rows where the column `present` is false
    only name their conversation; one without other rows has zeros and an empty audit. Rows without conv_id are one
    conversation; without turn they come first and have no part in gaps. Equal rows each count. An empty table has no
    conversations. Columns of any other name are ignored. Texts of any length: only digests move.
    """
    _ship()
    return _audits(_rows(df, conv_id, turn, role, text, present)).withColumnRenamed("c", conv_id)


def repaired_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   present: str | None = None) -> DataFrame:
    """(conv_id, place, role, text): the turns that the audits of `audit_conversations` leave, places from 0."""
    _ship()
    rows = _rows(df, conv_id, turn, role, text, present)
    return _walk(rows, _audits(rows), digests=False).withColumnRenamed("c", conv_id)


def repair_digests(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   present: str | None = None) -> DataFrame:
    """The audits with the SHA-256 of the repaired turns, `role:text` joined by newlines.

    A digest has to see a conversation's texts one after the other, so they go to one task, sorted, which passes them
    on as they come; nothing is collected. Texts move once.
    """
    _ship()
    rows = _rows(df, conv_id, turn, role, text, present)
    return _walk(rows, _audits(rows), digests=True).withColumnRenamed("c", conv_id)
