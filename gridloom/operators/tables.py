"""Intermediate tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where the session names none and all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written down and read again."""
    path = f"{shared_root(df.sparkSession)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` returned."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
