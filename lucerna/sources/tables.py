"""Tables as plain Parquet folders under a root (K1-K3, S12), and tables in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def write_tables(tables: dict[str, DataFrame], root: str, append: bool = False) -> None:
    """Each table anew, or its rows added as new files; a table that is written must not be read from the same root."""
    for name, df in tables.items():
        df.write.mode("append" if append else "overwrite").parquet(f"{root.rstrip('/')}/{name}")


def folder_between(spark: SparkSession) -> str:
    """The shared folder for tables in between: the one that spark.checkpoint.dir names, else one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lucerna"
    return f"{root.rstrip('/')}/lucerna"


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the folder for tables in between, or to path, and read again, for what several consumers read.

    What was shuffled for it isn't needed any more: Spark removes it with the plan, which the driver's JVM collects here and not at some later time.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{folder_between(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes what settle wrote to path, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
