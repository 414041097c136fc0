"""Column expressions shared by the operators: payloads, severities, text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage import config


def payload_scalar(payload: Column, field: str = "response_value") -> Column:
    """Numeric answer held in a payload: an object's field, or the bare payload."""
    is_object = F.trim(payload).startswith("{")
    raw = F.when(is_object, F.get_json_object(payload, f"$.{field}")).otherwise(payload)
    return raw.try_cast("double")


def lookup(code: Column, table: dict, default: str | None = None) -> Column:
    """CASE over a small fixed table; stays inside code generation."""
    out = None
    for key, value in table.items():
        hit = code == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def severity_rank(severity: Column) -> Column:
    ranks = {name: i for i, name in enumerate(config.SEVERITIES)}
    return F.coalesce(lookup(severity, ranks), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in config.SEVERITIES]), rank + 1)


def shift_severity(score: Column, effect: Column, high: float, medium: float) -> Column:
    """Both measures large -> high, either one notable -> medium, any shift -> low."""
    size = F.coalesce(F.abs(effect), F.lit(0.0))
    return (
        F.when((score >= high) & (size >= config.COHENS_D_HIGH), "high")
        .when((score >= medium) | (size >= config.COHENS_D_MED), "medium")
        .when(score > 0, "low")
        .otherwise("none")
    )


def redundancy_severity(pearson: Column) -> Column:
    return (
        F.when(F.abs(pearson) >= config.PEARSON_HIGH, "high")
        .when(F.abs(pearson) >= config.PEARSON_MED, "medium")
        .otherwise("none")
    )


def discrimination_severity(a: Column) -> Column:
    return F.when(a < config.A_POOR, "high").when(a < config.A_STRONG, "medium").otherwise("none")


def discrimination_label(a: Column) -> Column:
    return F.when(a < config.A_POOR, "poor").when(a < config.A_STRONG, "moderate").otherwise("strong")


def quota_severity(pct: Column) -> Column:
    return (
        F.when(pct < config.QUOTA_INFEASIBLE_PCT, "high")
        .when(pct < config.QUOTA_MARGINAL_PCT, "medium")
        .otherwise("none")
    )


def fixed2(x: Column) -> Column:
    """Two-decimal text of a non-negative number, halves up."""
    return F.format_string("%.2f", F.floor(x * 100 + F.lit(0.500000001)) / F.lit(100.0))


def fixed1(x: Column) -> Column:
    return F.format_string("%.1f", F.floor(x * 10 + F.lit(0.500000001)) / F.lit(10.0))


def signed2(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise("+"), fixed2(F.abs(x)))


def call_cost(
    tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column,
    price_in: Column, price_out: Column, price_write: Column, price_read: Column,
) -> Column:
    """USD of one call; a model missing from the price list costs nothing."""
    fresh = F.greatest(F.lit(0), tokens_in - cache_read - cache_write)
    total = fresh * price_in + cache_read * price_read + cache_write * price_write + tokens_out * price_out
    return F.coalesce(total / F.lit(1_000_000.0), F.lit(0.0))
