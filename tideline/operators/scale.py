"""Windows over few long series, cut in time so that one series isn't one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, build: Callable[[DataFrame], DataFrame], chunk_rows: int = 8760, halo_rows: int = 672, step_seconds: int = 3600) -> DataFrame:
    """build(df), but on chunks of time, each with the halo_rows steps before it.

    df must be dense; build may use windows by series_id and ts that look back at most halo_rows.
    Chunks pose as series of their own while build runs. Rows are copied at a rate of
    halo_rows / chunk_rows.
    """
    size, reach = chunk_rows * step_seconds, halo_rows * step_seconds
    at = F.unix_timestamp("ts")
    own = F.floor(at / size)
    copies = df.withColumn("_chunk", F.explode(F.sequence(own, F.floor((at + reach) / size))))
    built = build(copies.withColumn("series_id", F.struct("series_id", F.col("_chunk").alias("chunk"))).drop("_chunk"))
    return built.filter(F.floor(F.unix_timestamp("ts") / size) == F.col("series_id.chunk")).withColumn("series_id", F.col("series_id.series_id"))


def carry_in_fill(df: DataFrame, value: str = "x", chunk_rows: int = 8760, step_seconds: int = 3600) -> DataFrame:
    """As series.fill_gaps, but by chunks: within each, then from what neighbouring chunks carry over."""
    chunk = F.floor(F.unix_timestamp("ts") / (chunk_rows * step_seconds))
    c = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy("series_id", "_chunk").orderBy("ts")
    known = F.col(value).isNotNull()
    ends = c.groupBy("series_id", "_chunk").agg(F.max_by(value, F.when(known, F.col("ts"))).alias("_last"), F.min_by(value, F.when(known, F.col("ts"))).alias("_first"))
    across = Window.partitionBy("series_id").orderBy("_chunk")
    ends = ends.withColumns({
        "_before": F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_first", ignorenulls=True).over(across.rowsBetween(0, Window.unboundedFollowing)),
    }).drop("_last", "_first")
    near = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("_near", near).join(ends, ["series_id", "_chunk"]).withColumn(value, F.coalesce("_near", "_before", "_after")).drop("_chunk", "_near", "_before", "_after")


def fill_back(df: DataFrame, value: str, chunk_rows: int = 8760, step_seconds: int = 3600) -> DataFrame:
    """value, else the next one known: from the chunk, then from the first later chunk that has one."""
    c = df.withColumn("_chunk", F.floor(F.unix_timestamp("ts") / (chunk_rows * step_seconds)))
    inside = Window.partitionBy("series_id", "_chunk").orderBy("ts")
    ends = c.filter(F.col(value).isNotNull()).groupBy("series_id", "_chunk").agg(F.min_by(value, "ts").alias("_first"))
    across = Window.partitionBy("series_id").orderBy("_chunk")
    all_chunks = c.select("series_id", "_chunk").distinct().join(ends, ["series_id", "_chunk"], "left")
    after = all_chunks.withColumn("_after", F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))).drop("_first")
    near = F.first(value, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    return c.withColumn("_near", near).join(after, ["series_id", "_chunk"]).withColumn(value, F.coalesce("_near", "_after")).drop("_chunk", "_near", "_after")


def trailing_max(df: DataFrame, value: str, window: int, least: int, name: str, step_seconds: int = 3600) -> DataFrame:
    """name: the maximum of the last `window` rows, if `least` of them have a value.

    df must be dense. Time is cut into blocks of that many steps, each a partition of its own. A
    frame ends in one block and begins in the one before, so its maximum is the larger of a running
    maximum from either end, and each row is looked at a fixed number of times however long the window.
    """
    nth = F.floor(F.unix_timestamp("ts") / step_seconds)
    d = df.withColumn("_block", F.floor(nth / window)).withColumn("_place", nth - F.col("_block") * window)
    block = Window.partitionBy("series_id", "_block").orderBy("_place")
    head, tail = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"_head": F.max(value).over(head), "_seen": F.count(value).over(head)})
    # What a block gives to the next one's rows: a frame that ends at place k begins at k + 1 here.
    before = df.select("series_id", F.col(value), (F.floor(nth / window)).alias("_block"), (nth - F.floor(nth / window) * window).alias("_place"))
    before = before.withColumns({"_tail": F.max(value).over(tail), "_left": F.count(value).over(tail)})
    before = before.select("series_id", (F.col("_block") + 1).alias("_block"), (F.col("_place") - 1).alias("_place"), "_tail", "_left")
    # A series begins within its first block: a frame that begins before it has all of that block.
    whole = df.groupBy("series_id", (F.floor(nth / window) + 1).alias("_block")).agg(F.max(value).alias("_most"), F.count(value).alias("_all"))
    joined = d.join(before, ["series_id", "_block", "_place"], "left").join(whole, ["series_id", "_block"], "left")
    begun = F.col("_left").isNotNull() | (F.col("_place") == window - 1)
    tail_max, left = F.when(begun, F.col("_tail")).otherwise(F.col("_most")), F.coalesce(F.when(begun, F.col("_left")).otherwise(F.col("_all")), F.lit(0))
    return joined.withColumn(name, F.when(F.col("_seen") + left >= least, F.greatest("_head", tail_max))).drop("_block", "_place", "_head", "_seen", "_tail", "_left", "_most", "_all")
