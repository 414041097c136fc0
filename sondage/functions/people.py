"""Demographic recodes, trait draws and persona prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.hashing import uniform
from sondage.functions.scalars import lookup


def education_level(schl: Column) -> Column:
    """NULL for codes outside the code book."""
    out = F.when(schl < 1, F.lit(None).cast("string"))
    for upto, level in config.EDUCATION_UPTO:
        out = out.when(schl <= upto, level)
    return out


def education_rank(schl: Column) -> Column:
    return lookup(education_level(schl), config.EDUCATION_RANK)


def demographic(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}")
    return {
        "age": c("AGEP").cast("int"),
        "sex": F.when(c("SEX") == 2, "female").otherwise("male"),
        "education": F.coalesce(education_level(c("SCHL")), F.lit("less_than_hs")),
        "income": c("PINCP").cast("bigint"),
        "state": lookup(c("ST"), config.STATES, "??"),
        "race": lookup(c("RAC1P"), config.RACE, "other"),
        "marital": lookup(c("MAR"), config.MARITAL, "never_married"),
    }


def draw_trait(trait: str, person: Column, seed: int, styles: dict | None = None) -> Column:
    """Inverse-CDF draw; weights are normalised and empty levels never drawn."""
    levels = [(k, w) for k, w in (styles or config.TRAITS)[trait].items() if w > 0]
    total = sum(w for _, w in levels)
    u = uniform(seed, person, trait)
    cumulative, out = 0.0, None
    for level, weight in levels[:-1]:
        cumulative += weight / total
        out = F.when(u < cumulative, level) if out is None else out.when(u < cumulative, level)
    last = F.lit(levels[-1][0])
    return last if out is None else out.otherwise(last)


def traits(person: Column, seed: int, styles: dict | None = None) -> dict[str, Column]:
    return {t: draw_trait(t, person, seed, styles) for t in (styles or config.TRAITS)}


def income_band(income: Column) -> Column:
    out = F.when(income.isNull(), config.PROMPT_INCOME_NONE)
    for below, name in config.PROMPT_INCOME:
        out = out.when(income < below, name)
    return out.otherwise(config.PROMPT_INCOME_TOP)


def persona_prompt() -> Column:
    """Three paragraphs from the columns of `demographic` and `traits`."""
    who = F.concat(
        F.lit("You are a "), F.col("age"), F.lit("-year-old "),
        F.coalesce(lookup(F.col("race"), config.PROMPT_RACE), F.col("race")),
        F.when(F.col("sex") == "female", " woman").otherwise(" man"),
        F.lit(" living in "), F.col("state"), F.lit(". You "),
        F.coalesce(lookup(F.col("education"), config.PROMPT_EDUCATION), F.col("education")),
        F.lit(" and are "),
        F.coalesce(lookup(F.col("marital"), config.PROMPT_MARITAL), F.col("marital")),
        F.lit(". You are in the "), income_band(F.col("income")), F.lit(" bracket."),
    )
    phrases = [F.nullif(lookup(F.col(t), words), F.lit("")) for t, words in config.PROMPT_TRAITS.items()]
    return F.concat_ws("\n\n", who, F.concat_ws(" ", *phrases), F.lit(config.PROMPT_FRAMING))
