"""Deterministic hashing: identities, uniform draws and picks from short lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage import config


def question_hash(text: Column, version: str = config.HASH_VERSION) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}|"), text), 256)


def draw_bits(*parts: Column | str | int) -> Column:
    """First 32 bits of md5 over the parts joined by '|', as a bigint."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Deterministic draw in (0, 1), independent of partitioning and task retries."""
    return (draw_bits(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal by Box-Muller over two keyed uniforms."""
    u1, u2 = uniform(*parts, "g1"), uniform(*parts, "g2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def pick(options: Sequence[str], *parts: Column | str | int) -> Column:
    """One element of a short fixed list, chosen by the keyed hash."""
    chosen = F.pmod(draw_bits(*parts), F.lit(len(options))).cast("int") + F.lit(1)
    return F.element_at(F.array(*[F.lit(o) for o in options]), chosen)


def audience_hash(
    age_min: Column, age_max: Column, genders: Column, income_min: Column, income_max: Column,
    education_min: Column, states: Column, n: int, seed: int, version: str = config.HASH_VERSION,
    country: Column | None = None, tags: Column | None = None, styles: dict | None = None,
) -> Column:
    """Stable identity of an audience with its country and behavioural tags, its style table, the pool size and the seed.

    Anything missing is marked as such, so that no field can slide into another's place.
    """
    weights = ";".join(
        f"{trait}:" + ",".join(f"{level}={weight}" for level, weight in sorted(levels.items()))
        for trait, levels in sorted((styles or config.TRAITS).items())
    )
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    joined = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(F.array_sort(c), ",", "null"), F.lit("]")), F.lit("null"))
    country = F.lit(config.DEFAULT_COUNTRY) if country is None else country
    tags = F.array().cast("array<string>") if tags is None else tags
    return F.sha2(
        F.concat_ws(
            "|", text(age_min), text(age_max), joined(genders), text(income_min), text(income_max),
            text(education_min), joined(states), text(country), joined(tags), F.lit(weights), F.lit(str(n)), F.lit(str(seed)), F.lit(version),
        ),
        256,
    )
