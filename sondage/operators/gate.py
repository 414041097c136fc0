"""Gate for question variants: close enough to the original, different enough from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.hashing import question_hash


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _grouped(vectors: DataFrame) -> DataFrame:
    """One row per question: the original, at 0, and all of its variants, a handful by nature."""
    table = vectors.where(F.col("idx") >= 0).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "embedding"))).alias("all")
    )
    return table.select(
        "question_id",
        F.get(F.filter("all", lambda x: x["idx"] == 0), F.lit(0))["embedding"].alias("original"),
        F.filter("all", lambda x: x["idx"] > 0).alias("variants"),
    )


def variant_equivalence(vectors: DataFrame) -> DataFrame:
    """Cosine of every variant to its original."""
    rows = _grouped(vectors).where("original IS NOT NULL")
    return rows.select("question_id", "original", F.explode("variants").alias("v")).select(
        "question_id", F.col("v.idx").alias("idx"), cosine(F.col("original"), F.col("v.embedding")).alias("cosine")
    )


def _pairs(variants: Column) -> Column:
    """Cosines of all variant pairs of one question."""
    return F.flatten(
        F.transform(
            variants,
            lambda x: F.transform(
                F.filter(variants, lambda y: y["idx"] > x["idx"]),
                lambda y: F.struct(
                    x["idx"].alias("idx_a"), y["idx"].alias("idx_b"), cosine(x["embedding"], y["embedding"]).alias("cosine")
                ),
            ),
        )
    )


def variant_diversity(vectors: DataFrame) -> DataFrame:
    """Cosine of every pair of variants of a question."""
    rows = _grouped(vectors).select("question_id", F.explode(_pairs(F.col("variants"))).alias("p"))
    return rows.select("question_id", "p.idx_a", "p.idx_b", "p.cosine")


def variant_gate(
    vectors: DataFrame, floor: float = config.EQUIVALENCE_FLOOR,
    too_similar: float = config.DIVERSITY_CEIL, too_divergent: float = config.DIVERSITY_FLOOR,
) -> DataFrame:
    """First failing reason per question, else ok. Every variant present is judged, however many there are."""
    rows = _grouped(vectors)
    closeness = F.transform("variants", lambda v: cosine(F.col("original"), v["embedding"]))
    spread = F.transform(_pairs(F.col("variants")), lambda p: p["cosine"])
    rows = rows.select(
        "question_id", F.array_min(closeness).alias("min_equivalence"),
        F.array_max(spread).alias("max_pair"), F.array_min(spread).alias("min_pair"),
    )
    reason = (
        F.when(F.col("min_equivalence") < floor, "equivalence_below_floor")
        .when(F.col("max_pair") > too_similar, "pair_too_similar")
        .when(F.col("min_pair") < too_divergent, "pair_too_divergent")
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok")


def fallback_variants(questions: DataFrame, verdicts: DataFrame, k: int = config.K_VARIANTS) -> DataFrame:
    """k copies of the original text, marked not validated, for questions that failed."""
    failed = verdicts.where(~F.col("passed")).select("question_id")
    return (
        questions.join(failed, "question_id", "left_semi")
        .select("question_id", "text", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("idx"))
        .withColumn("axis", F.lit(config.FALLBACK_AXIS))
        .withColumn("validated", F.lit(False))
    )


def with_hash(questions: DataFrame) -> DataFrame:
    return questions.withColumn("question_hash", question_hash(F.col("text")))


def cache_lookup(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Per distinct text: how many questions share it, whether it is cached, and who asks first.

    Equal texts collapse before the join, so one popular text is one row.
    """
    texts = with_hash(questions).groupBy("question_hash").agg(
        F.count(F.lit(1)).alias("n_questions"), F.min("question_id").alias("first_question")
    )
    known = cache.select("question_hash").distinct().withColumn("_hit", F.lit(True))
    return texts.join(known, "question_hash", "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")


def insert_absent(cache: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """What a cache holds after an insert where the first write wins."""
    payload = [c for c in cache.columns if c != key]
    return cache.select(key, *payload).unionByName(absent_rows(cache, rows, key, order))


def absent_rows(cache: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows an insert adds to a cache: keys it lacks, once each, by lowest `order`. A cache appends only these."""
    payload = [c for c in cache.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *payload)).alias("_f"))
    return first.join(cache.select(key), key, "left_anti").select(key, *[F.col(f"_f.{c}").alias(c) for c in payload])


def variant_texts(questions: DataFrame, cache: DataFrame, k: int = config.K_VARIANTS) -> DataFrame:
    """Text shown for every variant index; 0 is the original, a missing one of the first k is a placeholder, and
    cached texts beyond k are shown as well.

    `cache`: question_hash and paraphrases, an array of structs with `text`.
    """
    joined = with_hash(questions).join(cache, "question_hash", "left")
    rows = joined.select("question_id", "text", "paraphrases", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(k), F.size("paraphrases")))).alias("idx"))
    cached = F.try_element_at("paraphrases", F.greatest("idx", F.lit(1)))["text"]
    return rows.select(
        "question_id", "idx",
        F.when(F.col("idx") == 0, F.col("text")).otherwise(F.coalesce(cached, F.lit(config.VARIANT_PLACEHOLDER))).alias("shown"),
    )
