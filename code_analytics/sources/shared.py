"""Tables between two steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where the session names none, a folder in the warehouse; on a cluster that must not lie on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")
    if not named and folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("tables between steps need spark.checkpoint.dir: the warehouse is a folder of one machine")
    return folder


_stored: list[str] = []


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written as a table (in folders by columns) and read again: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_stored() -> str:
    """The path of the table stored last."""
    return _stored[-1]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_so_far() -> int:
    return len(_stored)


def drop_stored(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this driver has stored since then; results that are not written yet need theirs."""
    while len(_stored) > since:
        delete(spark, _stored.pop())
