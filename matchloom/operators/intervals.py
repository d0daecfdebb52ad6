"""Joins by frame: points in intervals that may overlap, and the nearest row looking back and on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spells: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each row of ``points`` with each of ``spells`` (both bounds included) of its keys that holds it.

    A spell of length n is filed under the power of two at or above n, in bins of that width, of which it
    touches two at most, however long it is. A point looks into one bin for every width in use, of which
    there are 63 at most. So the join is by equality, and a bin holds spells of about its own width alone.
    Spells that overlap, nest or repeat are all found; such with a null bound, or that end before they
    start, hold nothing. Columns other than the keys must differ in name.
    """
    length = F.col(end) - F.col(start)
    filed = spells.filter(length >= 0).withColumn("_width", F.when(length == 0, 0).otherwise(F.length(F.bin(length))))
    # At most 63 numbers, whatever the table.
    widths = sorted(r[0] for r in filed.select("_width").distinct().collect())
    if not widths:
        return points.join(spells.limit(0), keys)
    bin_of = lambda c, w: F.expr(f"shiftright(cast({c} as bigint), {w})")
    filed = filed.withColumn("_bin", F.explode(F.sequence(bin_of(start, "_width"), bin_of(end, "_width"))))
    looks = F.array(*(F.struct(F.lit(w).alias("_width"), bin_of(at, w).alias("_bin")) for w in widths))
    asked = points.filter(F.col(at).isNotNull()).select("*", F.inline(looks))
    joined = asked.join(filed, [*keys, "_width", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return joined.drop("_width", "_bin")


def nearest(asked: DataFrame, known: DataFrame, keys: list[str], at: str, values: list[str], reach: int) -> DataFrame:
    """``asked`` (keys, ``at``) with the ``values`` of the nearest row of ``known`` within ``reach``, the earlier on a tie.

    Both tables go into one order by keys and frame; each row looks back to the last known one, and, in
    the opposite order, on to the next. A question is one row whatever the reach, and no row is compared with another.
    Several known rows of one frame should be alike; one of them is taken. Values are null where none is near.
    """
    none = [F.lit(None).cast(known.schema[v].dataType).alias(v) for v in values]
    rows = asked.select(*keys, at, *none, F.lit(True).alias("_asked")).unionByName(known.select(*keys, at, *values, F.lit(False).alias("_asked")))
    point = F.when(~F.col("_asked"), F.struct(F.col(at).alias("_at"), *values))
    # Rows before and up to the current one in both orders: such windows run in one pass.
    seen = lambda order: F.last(point, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_back", seen([F.col(at), F.col("_asked")])).withColumn("_on", seen([F.col(at).desc(), F.col("_asked")])).filter("_asked")
    back, on = F.col(at) - F.col("_back._at"), F.col("_on._at") - F.col(at)
    far = F.lit(reach + 1)
    best = F.when((F.coalesce(back, far) <= F.coalesce(on, far)) & (back <= reach), F.col("_back")).when(on <= reach, F.col("_on"))
    return both.withColumn("_best", best).select(*keys, at, *(F.col(f"_best.{v}").alias(v) for v in values))
