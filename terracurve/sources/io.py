"""Scans, sinks and resumable writes."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Columns of a cluster CSV before its dates, as files have them.
META = ["AOI", "Cluster_ID", "Cluster_Label", "Feature_Type", "Pixel_ID", "Confidence_Score"]


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet file or folder; the filter and the columns reach the reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def scan_boxed(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str] | None = None) -> DataFrame:
    """Features whose stored bounding box meets ``box`` (x0, y0, x1, y1): comparisons that prune row groups."""
    x0, y0, x1, y1 = box
    return scan(spark, path, columns, (F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))


def scan_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern as one table, columns by name: a column that a file lacks is null there. ``file`` is the file's name, which gives the order of files."""
    return spark.read.option("mergeSchema", "true").parquet(pattern).select("*", F.col("_metadata.file_name").alias("file"))


def scan_stems(spark: SparkSession, path: str, key: str = "aoi") -> DataFrame:
    """A folder of files with the file's stem, up to a double underscore, as a column."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    df = spark.read.parquet(path)
    return df.select("*", F.element_at(F.split(stem, "__"), 1).alias(key))


def cluster_schema(dates: Iterable[str]) -> StructType:
    kinds = {"Cluster_ID": IntegerType(), "Pixel_ID": IntegerType(), "Confidence_Score": DoubleType()}
    return StructType([StructField(c, kinds.get(c, StringType())) for c in META] + [StructField(d, DoubleType()) for d in dates])


def scan_clusters(spark: SparkSession, path: str, dates: Iterable[str]) -> DataFrame:
    return spark.read.schema(cluster_schema(dates)).option("header", True).csv(path)


def scan_csv(spark: SparkSession, path: str, schema: StructType, bad: str = "bad_record") -> DataFrame:
    """Rows of CSV files with a header, by a schema. A line that doesn't fit it keeps what could be read, and ``bad`` holds the line; else that is null.

    The reader parses the selected columns only; ``bad`` depends on all of them here, so that which lines are bad doesn't depend on the query.
    """
    kept = StructType([*schema.fields, StructField(bad, StringType())])
    df = spark.read.schema(kept).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    never = F.xxhash64(*(F.col(f"`{c}`") for c in schema.fieldNames())).bitwiseAND(F.lit(0)) == 1
    return df.withColumn(bad, F.when(never, F.lit("")).otherwise(F.col(bad)))


def extent(features: DataFrame) -> DataFrame:
    return features.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def complete_tiles(bands: DataFrame, first, last, n: int) -> DataFrame:
    """Tiles with n dates in the closed range."""
    own = bands.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return own.groupBy("tile").agg(F.count_distinct("date").alias("n_dates")).where(F.col("n_dates") == n)


def latest_runs(runs: DataFrame) -> DataFrame:
    """slug, run, path: the last run of each slug by name, its sieved result if there is one, else the raw one."""
    by = runs.groupBy("slug").agg(F.max("run").alias("run"))
    return runs.join(by, ["slug", "run"]).groupBy("slug", "run").agg(F.coalesce(F.max("sieved"), F.max("raw")).alias("path"))


def to_fetch(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Listed objects (name, size) that aren't there with the same size."""
    return remote.join(local.select("name", "size"), ["name", "size"], "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables of results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_named(df: DataFrame, path: str) -> None:
    """One Parquet file under a name of its own, for tables of one task's size: written beside and moved."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(aside)
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in store.listStatus(jvm.Path(aside)) if s.getPath().getName().startswith("part-"))
    store.delete(jvm.Path(path), False)
    if not store.rename(part, jvm.Path(path)):
        raise OSError(f"{path} couldn't be written")
    store.delete(jvm.Path(aside), True)


def write_tiles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("tile").parquet(path)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document, through Spark, so that ``path`` may be in any store."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_vectors(features: DataFrame, path: str) -> None:
    """Features with their vertices and bounding boxes, neighbours together, so that ``scan_boxed`` skips row groups."""
    features.sort("xmin", "ymin").write.mode("overwrite").parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns but those."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """The columns whose names begin so."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.startswith(prefix)))


def matches_glob(name: Column, pattern: str) -> Column:
    """``*`` stands for any characters, ``?`` for one."""
    return name.rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + r"\z")


def stem(path: Column) -> Column:
    """The file's name without folder, ending, and what follows a double underscore."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.element_at(F.split(name, "__"), 1)


def with_files(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs (slug, ...) and the file (path) of the same stem; both must exist."""
    return runs.withColumn("stem", stem(F.col("slug"))).join(files.select(stem(F.col("path")).alias("stem"), "path"), "stem")


def _if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_missing(spark: SparkSession, df: DataFrame, path: str, *keys: str) -> int:
    """Appends the rows whose keys aren't in ``path`` yet, one for each key; returns how many. They are computed once, and counted from what was written."""
    there = _if_there(spark, path)
    df = df.dropDuplicates(list(keys))
    if there is not None:
        df = df.join(there.select(*keys).distinct(), list(keys), "left_anti")
    before = 0 if there is None else there.count()
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def cached(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The table at ``path``, made by ``make()`` if it isn't there or is to be refreshed."""
    there = None if refresh else _if_there(spark, path)
    if there is not None:
        return there
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _state(spark: SparkSession, source: str) -> str:
    """Changes when a file of ``source`` is added, removed, or written again; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", "modificationTime")
    return str(files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first())


def cached_while(spark: SparkSession, path: str, make, *sources: str) -> DataFrame:
    """The table under ``path`` as long as the files of all ``sources`` are those it was made from; else it is made again.

    Each version has a folder of its own, so that readers of an older one aren't disturbed, and none is used before it is whole.
    """
    state = hashlib.sha256("|".join(_state(spark, s) for s in sources).encode()).hexdigest()[:24]
    version = f"{path}/{state}"
    there = _if_there(spark, f"{version}/rows")
    if there is None or _if_there(spark, f"{version}/done") is None:
        make().write.mode("overwrite").parquet(f"{version}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{version}/done")
    return spark.read.parquet(f"{version}/rows")


def write_raster(df: DataFrame, path: str, side: int, description: dict) -> None:
    """Pixels (row, col, bands) in blocks of ``side`` by ``side``, each in a partition of its own, with what describes the raster beside them."""
    block = lambda c: F.expr(f"{c} div {side}").cast("int")
    blocks = df.withColumn("block_row", block("row")).withColumn("block_col", block("col"))
    blocks.repartition("block_row", "block_col").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("block_row", "block_col").parquet(f"{path}/blocks")
    write_json(df.sparkSession, description | {"side": side, "bands": [c for c in df.columns if c not in ("row", "col")]}, f"{path}/description")


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    """Pixels, and the description. ``window``: first and last row, first and last column; only its blocks are read."""
    told = read_json(spark, f"{path}/description")
    df = spark.read.parquet(f"{path}/blocks")
    if window is not None:
        for c, a, b in (("row", *window[:2]), ("col", *window[2:])):
            df = df.where(F.col(f"block_{c}").between(a // told["side"], b // told["side"]) & F.col(c).between(a, b))
    return df.drop("block_row", "block_col"), told


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
