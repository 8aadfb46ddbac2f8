"""Joins on time that equality can't say: as of a moment, and within intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import broadcast_if_small

#: Rows of an interval table that every task may hold.
MOST_INTERVALS = 1 << 17


def asof_join(left: DataFrame, right: DataFrame, *values: str, direction: str = "backward", tolerance_seconds: float | None = None, at: str | None = None, chunk_seconds: int = 365 * 86400) -> DataFrame:
    """left (series_id, ts and more) with right's values at the latest ts at or before its own, of the same series.

    direction "forward" takes the first at or after. Stamps may lie anywhere. Beyond the tolerance the
    values are null, as where there is no such row; a null among right's values is a value like others. Of
    right rows of one series and ts, the one with the least values counts. at names a column for the
    right row's ts. Repeated rows of left stay, and so do its rows without a ts, which match nothing.

    Both sides are laid in one order of time in chunks, and what a chunk ends with is carried into the
    next ones, so a long series isn't one task and no row is copied.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    back = direction == "backward"
    named = at or "_at"
    found = F.struct(F.col("ts").alias("_at"), *values)
    right = right.filter(F.col("ts").isNotNull()).groupBy("series_id", "ts").agg(F.min(F.struct(*values)).alias("_v")).select("series_id", "ts", *[F.col(f"_v.{v}").alias(v) for v in values])
    one = left.select("series_id", "ts", F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_found"))
    both = one.unionByName(right.select("series_id", "ts", F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), found.alias("_found")))
    both = both.withColumn("_chunk", F.floor(F.unix_micros("ts") / (chunk_seconds * 1_000_000)))
    # In order of the search, right rows come first at equal times.
    when = F.col("ts").asc() if back else F.col("ts").desc()
    inside = Window.partitionBy("series_id", "_chunk").orderBy(when, F.col("_left").isNotNull())
    pick = F.max_by if back else F.min_by
    ends = both.filter(F.col("_found").isNotNull()).groupBy("series_id", "_chunk").agg(pick("_found", "ts").alias("_end"))
    chunks = both.select("series_id", "_chunk").distinct().join(ends, ["series_id", "_chunk"], "left")
    order = F.col("_chunk").asc() if back else F.col("_chunk").desc()
    carried = chunks.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy("series_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    near = both.withColumn("_near", F.last("_found", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_left").isNotNull())
    hit = near.join(carried, ["series_id", "_chunk"], "left").withColumn("_hit", F.coalesce("_near", "_carried"))
    if tolerance_seconds is not None:
        apart = F.abs(F.unix_micros("ts") - F.unix_micros("_hit._at"))
        hit = hit.withColumn("_hit", F.when(apart <= tolerance_seconds * 1_000_000, F.col("_hit")))
    hit = hit.withColumn("_hit", F.when(F.col("ts").isNotNull(), F.col("_hit")))
    return hit.select("_left.*", *[F.col(f"_hit.{v}").alias(v) for v in values], *([F.col("_hit._at").alias(named)] if at else []))


def _micros(c: str) -> Column:
    return F.unix_micros(c)


def interval_join(points: DataFrame, intervals: DataFrame, at: str = "ts", lo: str = "lo", hi: str = "hi", most: int = MOST_INTERVALS) -> DataFrame:
    """points joined to the intervals with lo <= at < hi, which may overlap and be of any lengths and number.

    An interval lies in at most two bins of the power of two next to its length, so both sides meet by
    equality of bins: a point has one for each power that occurs. Up to `most` intervals are broadcast,
    so points don't move. Empty intervals and rows with a null in at, lo or hi match nothing.
    """
    real = intervals.filter(F.col(lo) < F.col(hi))
    power = F.ceil(F.log2((_micros(hi) - _micros(lo)).cast("double"))).cast("int")
    powers = sorted(r["p"] for r in real.select(power.alias("p")).distinct().collect())  # at most 64
    if not powers:
        powers = [0]
    size = F.expr("shiftleft(1L, _power)")
    binned = real.withColumn("_power", power).withColumn("_bin", F.explode(F.sequence(F.floor(_micros(lo) / size), F.floor((_micros(hi) - 1) / size))))
    # The numbers of a broadcast table count its rows by bin.
    binned = broadcast_if_small(binned, most, "intervals")
    placed = points.withColumn("_power", F.explode(F.array(*[F.lit(p) for p in powers]))).withColumn("_bin", F.floor(_micros(at) / size))
    joined = placed.join(binned, ["_power", "_bin"])
    return joined.filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_power", "_bin")
