"""Joins of intervals that overlap, by bins of places at several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in a bin of the lowest level, and how much wider the bins of each next level are.
WIDTH, FACTOR = 256, 4
#: Levels: the widest bin holds any interval of long places.
LEVELS = 28


def _width(level: Column) -> Column:
    return (F.lit(WIDTH).cast("decimal(38,0)") * F.pow(F.lit(float(FACTOR)), level).cast("decimal(38,0)")).cast("decimal(38,0)")


def _level(start: Column, end: Column) -> Column:
    """The lowest level whose bins are no narrower than the interval, so that it lies in two of them at most."""
    size = end.cast("decimal(38,0)") - start.cast("decimal(38,0)")
    widths = F.array(*[F.lit(WIDTH * FACTOR**k).cast("decimal(38,0)") for k in range(LEVELS)])
    return F.size(F.filter(widths, lambda w: w < size))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_at: tuple[str, str], right_at: tuple[str, str]) -> DataFrame:
    """Rows of left and right with equal `on` whose half-open intervals share a place, each pair once.

    left_at and right_at name the columns of start and end; other columns of both come along
    and need names of their own. An interval lies in one or two bins of its own level, which
    its length gives, and of each level above. A pair meets at the higher of its two levels,
    in the first bin that both lie in there; the exact test follows. So an interval sends at
    most two rows a level that the other side has, however long it is, and a long text's intervals are
    dealt over its bins rather than all met in one task. Empty and reversed intervals, and
    rows with a null key or place, meet nothing; repeated rows meet as often as they occur.
    """

    def leveled(df: DataFrame, at: tuple[str, str]) -> DataFrame:
        return df.where(F.col(at[0]) < F.col(at[1])).withColumn("_level", _level(F.col(at[0]), F.col(at[1])))

    def levels(df: DataFrame) -> list[int]:
        # at most LEVELS rows
        return sorted(r["_level"] for r in df.select("_level").distinct().collect())

    def binned(df: DataFrame, at: tuple[str, str], used: list[int], side: str) -> DataFrame:
        above = F.filter(F.array(*[F.lit(x) for x in used]).cast("array<int>"), lambda x: x >= F.col("_level"))
        rows = df.withColumn("_at", F.explode(F.array_distinct(F.concat(F.array("_level"), above))))
        bin_of = lambda place: F.floor(place.cast("decimal(38,0)") / _width(F.col("_at"))).cast("long")
        first, last = bin_of(F.col(at[0])), bin_of(F.col(at[1]) - 1)
        rows = rows.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))
        return rows.withColumnsRenamed({"_level": f"_level_{side}", "_first": f"_first_{side}"})

    left, right = leveled(left, left_at), leveled(right, right_at)
    a, b = binned(left, left_at, levels(right), "a"), binned(right, right_at, levels(left), "b")
    met = a.join(b, [*on, "_at", "_bin"]).where((F.col("_at") == F.greatest("_level_a", "_level_b")) & (F.col("_bin") == F.greatest("_first_a", "_first_b")))
    met = met.where((F.col(left_at[0]) < F.col(right_at[1])) & (F.col(right_at[0]) < F.col(left_at[1])))
    return met.drop("_at", "_bin", "_level_a", "_level_b", "_first_a", "_first_b")
