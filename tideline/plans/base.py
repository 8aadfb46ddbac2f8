"""Inputs that the flows share, from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import staging
from ..operators import geo, series

BOX_LAT, BOX_LON, BOX_STEP = (47.0, 55.0), (5.5, 15.5), 0.25


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for what a query writes and reads again; staging.remove_staged removes it."""
    return staging.shared_folder(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour. Totals are rounded, since sums of doubles depend on their order."""
    return series.hourly_totals(table(spark, sf_dir, "events")).withColumn("x", F.round("x", 4))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly without the values of some hours."""
    hole = (F.hour("ts") * 7 + F.dayofmonth("ts")) % 11 == 0
    return hourly(spark, sf_dir).withColumn("x", F.when(~hole, F.col("x")))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clean_series(hourly(spark, sf_dir))


def with_temperature(df: DataFrame) -> DataFrame:
    """temp_c made from the hour and the value."""
    return df.withColumn("temp", F.round(F.sin(F.hour("ts") * 6.283185307179586 / 24) * 10 + 12 + F.pmod(F.floor("x"), F.lit(17)), 4))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by priority and day, dense and filled."""
    orders = table(spark, sf_dir, "orders")
    day = orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    return series.clean_series(day, "x", "1 day")


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places in the box, from customer keys."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((F.lit(47.0) + (k * 37 % 641) * 0.0125).alias("lat"), (F.lit(5.5) + (k * 101 % 641) * 0.015625).alias("lon")).distinct()


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field over the box for each event hour, made from the hour's total. source_file as yearly parts."""
    hours = hourly(spark, sf_dir).groupBy("ts").agg(F.round(F.sum("x"), 3).alias("v"))
    cells = geo.box_cells(spark, BOX_LAT, BOX_LON, BOX_STEP)
    return hours.crossJoin(cells).select("ts", "lat", "lon", (F.pmod(F.col("v"), F.lit(40.0)) - 10 + F.col("lat") * 0.5 - F.col("lon") * 0.25).alias("t2m"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites, with made-up places and shares."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("site_id"), (F.lit(35.0) + k * 0.8).alias("lat"), (F.lit(-10.0) + k * 1.5).alias("lon"), (k + 1).cast("double").alias("share"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("ts").distinct()


def presented(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, times and dates as text: comparable across engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)
