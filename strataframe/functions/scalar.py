"""Scalar column expressions. Everything here stays inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_number(sample_id: Column) -> Column:
    """First run of digits in an id as a number; null when there is none."""
    return F.regexp_extract(sample_id, r"(\d+)", 1).try_cast("bigint")


def year_index(sample_id: Column, samples_per_year: int) -> Column:
    """Which year of the id numbering a sample falls in."""
    return F.call_function("div", sample_number(sample_id), F.lit(samples_per_year).cast("bigint"))


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Zone-less timestamp, so that no session time zone shifts it."""
    return F.to_timestamp_ntz(text, F.lit(fmt)) if fmt else F.to_timestamp_ntz(text)


def calendar(ts: Column) -> dict[str, Column]:
    """Month, hour and ordinal day (1..366) of a timestamp."""
    return {"month": F.month(ts), "hour": F.hour(ts), "day": F.dayofyear(ts)}


def in_time_slots(ts: Column, hours, minute: int = 0) -> Column:
    return F.hour(ts).isin(list(hours)) & (F.minute(ts) == minute)


def cyclic_features(lat: Column, lon: Column, hour: Column, day: Column) -> dict[str, Column]:
    """Latitude scaled to [-1, 1]; longitude, hour and day on the unit circle."""
    features = {"lat_unit": lat / F.lit(90.0)}
    for name, value, period in (("lon", lon, 360.0), ("hour", hour, 24.0), ("day", day, 366.0)):
        angle = F.lit(2.0) * F.pi() * value / F.lit(period)
        features[f"{name}_cos"] = F.cos(angle)
        features[f"{name}_sin"] = F.sin(angle)
    return features


def clip_lower(value: Column, bound: float) -> Column:
    """At least `bound`; null stays null (`greatest` alone would return the bound)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(bound))))


def override_when(condition: Column, replacement: Column, value: Column) -> Column:
    return F.when(condition, replacement).otherwise(value)


def run_tag(path: Column) -> Column:
    """Experiment tag (three digits and a letter) out of a path; null when there is none."""
    return F.nullif(F.regexp_extract(path, r"exp\d{3}[abc]", 0), F.lit(""))


def decode_id(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")
