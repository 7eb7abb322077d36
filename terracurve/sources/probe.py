"""Which tiles can be used, and reads that survive files that can't.

A file cut off by a killed run is listed like any other and fails when it is read. So the listing, which reads
no contents, is joined to the files whose rows a tolerant read has shown: what is listed and shows nothing is broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TILE = r"/tile=([^/]+)/"


def listing(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file, size of the files under ``path``; their contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select(F.col("path").alias("file"), F.col("length").alias("size"))


def readable(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the files that can be read, and ``file``, where they come from; others are passed over."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"))


def _plain(file):
    """A path without the slashes by which listings and rows spell the root of a store differently."""
    return F.regexp_replace(F.url_decode(file), "^([a-z]+):/+", "$1:/")


def probed(spark: SparkSession, path: str, tiles: DataFrame, schema: StructType, first: str, last: str, dates: int) -> DataFrame:
    """tile, n_dates, status of each of ``tiles`` (tile: string), whose files lie in tile=.../: absent; broken, if any of its files
    shows no row; short, if it has other than ``dates`` dates from ``first`` to ``last``; else complete."""
    rows = readable(spark, path, schema)
    inside = F.when(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col("date"))
    shown = rows.select(_plain(F.col("file")).alias("file"), inside.alias("date")).distinct()
    files = listing(spark, path).select(_plain(F.col("file")).alias("file"))
    met = files.join(shown.withColumn("shown", F.lit(True)), "file", "left")
    by = met.groupBy(F.regexp_extract("file", _TILE, 1).alias("tile")).agg(F.count_distinct("date").alias("n_dates"), F.bool_and(F.col("shown").isNotNull()).alias("whole"))
    df = tiles.select("tile").distinct().join(by, "tile", "left")
    status = F.when(F.col("whole").isNull(), "absent").when(~F.col("whole"), "broken").when(F.col("n_dates") != dates, "short").otherwise("complete")
    return df.select("tile", F.coalesce("n_dates", F.lit(0)).alias("n_dates"), status.alias("status"))


def tolerant(spark: SparkSession, sources: dict[str, str], schema: StructType) -> DataFrame:
    """Rows of all sources (name: path) that exist and can be read, with ``source``; the others add none."""
    parts = [spark.createDataFrame([], schema).withColumn("source", F.lit(None).cast("string"))]
    for name, path in sources.items():
        try:
            df = readable(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        parts.append(df.drop("file").withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def cut_off(spark: SparkSession, file: str, size: int = 40) -> None:
    """Leaves the first bytes of a file, as a killed writer does; for trials of the above."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    head = spark.read.format("binaryFile").load(file).select(F.substring("content", 1, size).alias("c")).first()["c"]
    out = store.create(path, True)
    out.write(bytearray(head))
    out.close()
