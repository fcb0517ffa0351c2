"""Delimited tables and named sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstie.operators.tables import union_by_name


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one delimited file (reads its first line only)."""
    return spark.read.option("header", True).csv(path).columns


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   overrides: dict[str, str] | None = None) -> DataFrame:
    """Typed scan. With ``schema`` nothing is inferred; else types are inferred and
    ``overrides`` (name -> type) replaces single ones, values that do not fit becoming missing."""
    if schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path)
    if not overrides:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    inferred = spark.read.option("header", True).option("inferSchema", True).csv(path).schema
    types = {f.name: f.dataType.simpleString() for f in inferred} | overrides
    fixed = T.StructType([T.StructField(n, T.StringType() if n in overrides else inferred[n].dataType) for n in types])
    raw = spark.read.schema(fixed).option("header", True).csv(path)
    return raw.withColumns({n: F.col(f"`{n}`").try_cast(t) for n, t in overrides.items()})


def read_strings(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(list(paths))


def read_dir_strings(spark: SparkSession, directory: str) -> DataFrame:
    """Every delimited file of a directory as text columns, stacked by column name.

    First lines are found in tasks (``first_lines``); files with the same first line are
    one group and each group is one scan. The driver sees file names, as it does in listing
    any folder, and parses one header per group. Files without a line add nothing; a folder
    without files, or with empty ones only, gives a table without columns and rows.
    """
    groups = (first_lines(spark, directory).groupBy("first_line")
              .agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("first_line").collect())
    by_header: dict[tuple[str, ...], list[str]] = {}
    for group in groups:
        by_header.setdefault(tuple(header(spark, group.paths[0])), []).extend(group.paths)
    if not by_header:
        return spark.createDataFrame([], T.StructType([]))
    return union_by_name(*[read_strings(spark, paths, cols) for cols, paths in by_header.items()])


def first_lines(spark: SparkSession, directory: str, names: str = "*.csv") -> DataFrame:
    """``path`` and ``first_line`` of every file with a line that is not blank.

    Two passes over the first blocks of the files as text. The first keeps one number per
    file, the place of its first line; the second lets through the lines at these places.
    No task sorts or holds lines, and what is shuffled or sent grows with the number of
    files only. Both passes share one listing and so one division into tasks.
    """
    lines = spark.read.option("pathGlobFilter", names).text(directory).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where((F.col("block") == 0) & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
    places = lines.groupBy("path").agg(F.min("at").alias("at"))
    return lines.join(F.broadcast(places), ["path", "at"]).select("path", F.col("value").alias("first_line"))


def read_csv_pruned(spark: SparkSession, path: str, keep: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Scan keeping only ``keep`` (name -> type); the reader never parses the others into rows."""
    names = list(columns) if columns is not None else header(spark, path)
    schema = ", ".join(f"`{n}` {keep.get(n, 'string')}" for n in names)
    return spark.read.schema(schema).option("header", True).csv(path).select(*[F.col(f"`{k}`") for k in keep])


def read_sheet(spark: SparkSession, directory: str, sheet: str, schema=None) -> DataFrame:
    """A worksheet exported as ``<directory>/<sheet>.csv``."""
    return read_table_csv(spark, f"{directory}/{sheet}.csv", schema)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sheet(df: DataFrame, directory: str, sheet: str) -> None:
    write_table_csv(df, f"{directory}/{sheet}.csv")
