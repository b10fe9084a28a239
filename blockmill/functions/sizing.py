"""Rule C0: the sizes in force for an upload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_TARGET = 5500
DEFAULT_MAX = 6000


def resolve(target: int | None, overlap: int | None, maximum: int | None) -> tuple[int, int, int]:
    """(target, overlap, max) in force; None counts as 0."""
    size = target if target and target > 0 else DEFAULT_TARGET
    limit = max(maximum if maximum and maximum > 0 else DEFAULT_MAX, size)
    return size, min(max(overlap or 0, 0), size - 1), limit


def resolved_target(target: Column) -> Column:
    return F.when(target > 0, target.cast("int")).otherwise(F.lit(DEFAULT_TARGET))


def resolved_max(target: Column, maximum: Column) -> Column:
    asked = F.when(maximum > 0, maximum.cast("int")).otherwise(F.lit(DEFAULT_MAX))
    return F.greatest(asked, resolved_target(target))


def resolved_overlap(target: Column, overlap: Column) -> Column:
    asked = F.when(overlap > 0, overlap.cast("int")).otherwise(F.lit(0))
    return F.least(asked, resolved_target(target) - F.lit(1))
