"""Chunked execution: an aggregate kept up to date while a table arrives in files.

A query over more data than fits at once is a sum of partial results.  Spark
spills and pipelines within a batch; across batches Structured Streaming
carries the partial aggregates as state, with its checkpoint in the shared
folder, so a restart goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from brindle.plans.reports import REPORTS
from brindle.sources import catalog

#: Reports that are one aggregate over the lines, joined to tables that stand still: those that a stream can carry.
CHUNKED = ("q01", "q03", "q05", "q06", "q07", "q08", "q09", "q10", "q12", "q14", "q19", "mb1", "mb2", "mb3", "mb4", "mb5", "mb6", "mb7")


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """The Parquet files of a folder as a stream, so many a chunk."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def running(stream: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Keyed aggregates of all chunks so far; sums, counts, minima and maxima, which merge in any order."""
    return stream.groupBy(*by).agg(*(c.alias(n) for n, c in sums.items()))


def drain(result: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Work off what has arrived into the in-memory table `name`, then stop; a report's few rows, as they are at the end."""
    query = result.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def report(spark: SparkSession, name: str, folder: str, files: int = 1, **values: str) -> DataFrame:
    """A report whose lines are read so many files a chunk."""
    if name not in CHUNKED:
        raise ValueError(f"{name} is not one aggregate over the lines; {', '.join(CHUNKED)} are")
    own = REPORTS[name]
    full = catalog.load(spark, folder, own.views)
    kind, path, _ = catalog.locate(spark, folder, "lineitem")
    if kind == "tbl":
        raise ValueError(f"{path}: chunks are Parquet files; ingest first")
    lines = catalog.source(spark, folder, "lineitem")
    stream = arriving(spark, path, lines.schema, files)
    if kind == "prepared":
        stream.createOrReplaceTempView("lineitem")
    elif catalog.is_full(lines, "lineitem"):
        catalog.typed(stream, "lineitem").createOrReplaceTempView("lineitem")
    else:
        stream.createOrReplaceTempView("raw_lineitem")
        spark.sql(catalog.DERIVED["lineitem"]).createOrReplaceTempView("lineitem")
    out = own.over_views(spark, full, **values)
    return drain(out, f"{name}_{uuid.uuid4().hex}", f"{catalog.shared_folder(spark)}/chunks/{uuid.uuid4().hex}")
