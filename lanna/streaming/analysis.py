"""The same analysis over streams: stateless tokens, and counts of terms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.operators.analyzers import native_terms


def source(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream of Parquet rows; a single file is watched by its folder and name."""
    schema = schema or spark.read.parquet(path).schema
    status = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = status.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(status).isDirectory()
    reader = spark.readStream.schema(schema)
    if folder:
        return reader.parquet(path)
    parent, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)


def analyzed_stream(stream: DataFrame, text: str, how: Callable[[Column], Column], into: str = "tokens") -> DataFrame:
    """Tokens of every row: no state, so no watermark; memory is bounded by the batch."""
    return stream.withColumn(into, how(F.col(text)))


def counted_stream(spark: SparkSession, path: str) -> DataFrame:
    """Counts of terms over all rows that a stream has now; runs to its end and gives the table, which lies in the warehouse."""
    terms = source(spark, path).select(F.explode(native_terms(F.col("text"))).alias("term")).groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))
    name = f"terms_{uuid.uuid4().hex}"
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")

    def keep(counts: DataFrame, number: int) -> None:
        counts.write.mode("overwrite").parquet(f"{base}/{name}/{number}")

    run = terms.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/{name}_state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress
    for folder in (name, f"{name}_state"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if last is None:
        return spark.createDataFrame([], "term string, n long")
    return spark.read.schema("term string, n long").parquet(f"{base}/{name}/{last['batchId']}")


def reloading(stream: DataFrame, load: Callable[[], object], apply: Callable[[DataFrame, object], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Micro-batches through a function whose lexicon is loaded anew for each, so that edits of it take effect."""

    def batch(df: DataFrame, number: int) -> None:
        sink(apply(df, load()), number)

    return stream.writeStream.foreachBatch(batch)
