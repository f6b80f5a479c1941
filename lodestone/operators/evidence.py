"""Conservative reconciliation: how two records agree, dimension by dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGREE, ABSENT, CONFLICT = "agree", "absent", "conflict"


def equal_dimension(a: Column, b: Column) -> Column:
    """agree or conflict where both sides have a value, else absent."""
    return F.when(a.isNull() | b.isNull(), ABSENT).when(a == b, AGREE).otherwise(CONFLICT)


def overlap_dimension(a: Column, b: Column) -> Column:
    """The same for lists: agree where they share an element, absent where one is null or empty."""
    return F.when(F.coalesce(F.size(a) <= 0, F.lit(True)) | F.coalesce(F.size(b) <= 0, F.lit(True)), ABSENT).when(F.arrays_overlap(a, b), AGREE).otherwise(CONFLICT)


def title_dimension(a: Column, b: Column, a_named: Column, b_named: Column) -> Column:
    """Title keys that agree or not; absent where one is empty or only a file's name."""
    return F.when(a_named & b_named, equal_dimension(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))).otherwise(ABSENT)


def any_conflict(*dimensions: Column) -> Column:
    return F.exists(F.array(*dimensions), lambda d: d == CONFLICT)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
