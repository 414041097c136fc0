"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import ascii_lower, stage

#: A chunk ends at white space after a vowel, at 1,024 characters at least and 8,192 at most: only nearby text decides.
CHUNK = r"(?s).{1024,8191}?[aeiou]\s|(?s).{1,8192}"


def chunk_recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = CHUNK, digest=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, text_sha256 and `recipe`, the ordered list of its chunks' verified identifiers.

    Chunks are named by a 64-bit digest. Every distinct (digest, chunk) moves once, and a digest counts as verified when
    all its chunks are the same bytes. Texts that hold one that is not are named by their chunks' SHA-256 instead.
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm")).withColumn(
        "chunks", F.regexp_extract_all("norm", F.lit(pattern), F.lit(0)))
    recipes = stage(base.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: digest(c)).alias("recipe")), "recipes")
    variants = base.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("id"), "chunk").distinct()
    unsafe = stage(variants.groupBy("id").agg(F.count("*").alias("variants")).where("variants > 1").select("id"), "unsafe")
    if unsafe.isEmpty():
        return recipes
    suspects = stage(recipes.select("text_sha256", F.explode("recipe").alias("id"))
                     .join(unsafe, "id", "left_semi").select("text_sha256").distinct(), "suspects")
    told_apart = base.withColumn("text_sha256", F.sha2("norm", 256)).join(suspects, "text_sha256", "left_semi").select(
        "doc_id", "text_sha256",
        F.flatten(F.transform("chunks", lambda c: F.transform(
            F.array(*[F.conv(F.substring(F.sha2(c, 256), k, 15), 16, 10) for k in (1, 16, 31, 46)]),
            lambda part: part.cast("long")))).alias("recipe"))
    return recipes.join(suspects, "text_sha256", "left_anti").unionByName(told_apart)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = CHUNK, digest=F.xxhash64) -> DataFrame:
    """Which documents are identical after lower-casing A-Z, and which row of each group stays (the largest id).

    Documents are equal when their recipes are, compared as whole lists. Counts are combined before the shuffle, so a
    group with a third of all rows is a few rows per task; the way back is a join on light rows that can be split.

    Returns doc_id, keep_id, group_size, kept, text_sha256, a row per input row. Null text counts as empty. Null ids never
    win over others; a group of null ids only keeps null. Rows that repeat the kept id are all marked kept. An empty
    table gives no rows. Other columns are ignored.
    """
    recipes = chunk_recipes(docs, doc_id, text, pattern, digest)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
