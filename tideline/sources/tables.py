"""Wide CSV and long Parquet sources, seams between yearly files, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import broadcast_if_small


def read_wide_csv(spark: SparkSession, path: str, columns: dict[str, str], ts_column: str = "utc_timestamp") -> DataFrame:
    """ts (UTC) and the named columns, renamed, as doubles; other columns of the file aren't read.

    The header gives positions, so the schema is built from it, not inferred from the data.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if c == ts_column else T.DoubleType() if c in columns else T.StringType()) for c in header])
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(F.to_timestamp(ts_column).alias("ts"), *[F.col(c).alias(new) for c, new in columns.items()])


def unpivot_columns(df: DataFrame, keys: list[str], columns: dict[str, str], name: str = "series_id", value: str = "x") -> DataFrame:
    """Long form: a row for each key and column; columns maps a column to the name it gets."""
    wide = df.select(*keys, *[F.col(c).alias(new) for c, new in columns.items()])
    return wide.unpivot(keys, list(columns.values()), name, value)


def read_weather(spark: SparkSession, path: str, kind: str, kinds: tuple[str, ...] = ("box", "land", "population")) -> DataFrame:
    """ts and temp_c of one weighting from a file with a column for each."""
    if kind not in kinds:
        raise ValueError(f"kind must be one of {kinds}")
    wide = read_wide_csv(spark, path, {k: k for k in kinds}, "timestamp")
    return unpivot_columns(wide, ["ts"], {k: k for k in kinds}, "kind", "temp_c").filter(F.col("kind") == kind).select("ts", "temp_c")


#: Files whose first slices every task may hold.
MOST_FILES = 1 << 17
#: Dimensions a field may have besides time and place: ensemble member, version, level and the like.
EXTRA_DIMENSIONS = ("number", "expver", "step", "surface", "level", "realization", "height")


def read_grid(spark: SparkSession, paths: list[str] | str, extra: tuple[str, ...] = EXTRA_DIMENSIONS) -> DataFrame:
    """ts, lat, lon, t2m in Celsius and source_file, from long Parquet in Kelvin.

    The time column may be called time or valid_time; latitude and longitude are degrees. Of any
    extra dimension a file has, its first (lowest) slice is taken; slices of a file are few. These
    lowest values, a row a file, are staged and broadcast up to MOST_FILES, so no field is moved.
    """
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    times = [F.col(c) for c in ("valid_time", "time") if c in df.columns]
    file = F.col("source_file") if "source_file" in df.columns else F.col("_metadata.file_name")
    dims = [c for c in extra if c in df.columns]
    if dims:
        first = df.groupBy(file.alias("_file")).agg(*[F.min(c).alias(f"_{c}") for c in dims])
        rows = df.withColumn("_file", file).join(broadcast_if_small(first, MOST_FILES, "first-slices"), "_file")
        for c in dims:
            rows = rows.filter(F.col(c).eqNullSafe(F.col(f"_{c}")))
        df, file = rows, F.col("_file")
    return df.select(F.coalesce(*times).cast("timestamp").alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), (F.col("t2m") - 273.15).alias("t2m"), file.alias("source_file"))


def drop_seam_duplicates(df: DataFrame, key: list[str], order: Column | str = "source_file") -> DataFrame:
    """One row a key: that of the first file. A window, since which row dropDuplicates keeps isn't fixed."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_nth", first).filter("_nth = 1").drop("_nth")


def file_overlaps(df: DataFrame, at: str = "ts", file: str = "source_file") -> list[tuple]:
    """The spans of time that more than one file covers, merged, in order; from each file's first and last time, a row a file."""
    ranges = sorted((r["lo"], r["hi"]) for r in df.groupBy(file).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).collect() if r["lo"] is not None)
    shared: list[tuple] = []
    reach = None
    for lo, hi in ranges:
        if reach is not None and lo <= reach:
            end = min(hi, reach)
            shared[-1:] = [(shared[-1][0], max(shared[-1][1], end))] if shared and lo <= shared[-1][1] else [*shared[-1:], (lo, end)]
        reach = hi if reach is None else max(reach, hi)
    return shared


def drop_seam_rows(df: DataFrame, key: list[str], at: str = "ts", file: str = "source_file") -> DataFrame:
    """As drop_seam_duplicates, for files that hold a key once: only rows at times which several files cover are shuffled.

    Rows without a time are dealt like those.
    """
    shared = file_overlaps(df, at, file)
    inside = F.col(at).isNull()
    for lo, hi in shared:
        inside = inside | F.col(at).between(F.lit(lo), F.lit(hi))
    return df.filter(~inside).unionByName(drop_seam_duplicates(df.filter(inside), key, file))


def write_sorted_extract(df: DataFrame, name: str, path: str, buckets: int = 8) -> DataFrame:
    """df as table `name` below path, in buckets of series_id, each sorted by series_id and ts; the table.

    What groups or windows by series reads it without an exchange. A bucket is one file, written by one task.
    """
    spark = df.sparkSession
    df.repartition(buckets, "series_id").write.mode("overwrite").bucketBy(buckets, "series_id").sortBy("series_id", "ts").option("path", path).saveAsTable(name)
    return spark.table(name)


def seam_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """n_rows, n_keys and n_duplicates of a table."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def write_extract(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a cleaned table by year of ts."""
    df.withColumn("year", F.year("ts")).write.mode("overwrite").partitionBy("year").option("header", True).format(format).save(path)


def write_scores(df: DataFrame, path: str, **tags: str) -> None:
    """Write a small score table as CSV, tagged with constant columns such as the weather mode."""
    df.withColumns({k: F.lit(v) for k, v in tags.items()}).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def wide_predictions(pred: DataFrame, actual: DataFrame, models: list[str]) -> DataFrame:
    """series_id, ts, actual and a column for each named model. Naming models spares a pass to find them."""
    wide = pred.groupBy("series_id", "ts").pivot("model", models).agg(F.first("pred"))
    return actual.select("series_id", "ts", F.col("y").alias("actual")).join(wide, ["series_id", "ts"], "left")
