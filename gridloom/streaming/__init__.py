"""Workbooks as a stream of files: each batch's issues are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as R
from ..sources import schema
from ..sources.xlsx import FILES, frames


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Workbook files (path, content) that arrive in a folder."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", FILES).load(folder).select("path", "content")


def stream_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the workbook files that arrive in a folder."""
    return stream_files(spark, folder).mapInPandas(frames("cells", folder), schema.CELLS)


def stream_issues(files: DataFrame, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the issues of each batch of workbook files, with their named ranges resolved. A workbook is whole in its batch, so no state is kept between batches."""

    def write(batch: DataFrame, number: int) -> None:
        a = R.analyze(batch.mapInPandas(frames("cells", folder), schema.CELLS), batch.mapInPandas(frames("named_ranges", folder), schema.NAMED_RANGES))
        # a batch that is run again after a failure replaces its own folder
        R.issues(a).write.mode("overwrite").parquet(f"{out}/batch={number}")
        a.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
