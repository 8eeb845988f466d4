"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder is set in local mode; on a cluster it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ontoloom-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again, so that their size is known to joins that follow."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ontoloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a result that the driver may hold in place of a written table.
FEW = 1000


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, evaluated once: few of them as a local table, more as cut() does."""
    rows = df.limit(FEW + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= FEW else cut(df)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() has made; nothing may read them any more. Others are left alone."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if urlparse(folder).path.rpartition("/")[2].startswith("cut-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
