"""The indexing queue as a stream (ST1-ST5): uploads arrive as files, units, digests, the search index and states follow batch by batch.

Every batch writes folders named by its number, so a batch that runs twice writes the same; states are a log of
which the latest counts. The index under `root`/index takes a segment a batch: what it held of the batch's assets before ends.
An asset that can't be read fails by itself, with its message, and takes its old units along; the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lucerna.functions import text as X
from lucerna.operators import parse, search_index
from lucerna.operators.context import asset_digests

ASSET = "asset_id string, session_id string, name string, extension string, text string, queued_at string"
#: Numbers of index segments from one batch to the next; those between are for deletions.
STEP = 1_000_000
#: Batches after which the index is written anew as one segment.
COMPACT = 50


def failure(assets: DataFrame) -> Column:
    """ST1: why an asset can't be indexed, null if it can: no text, or JSON that isn't any."""
    malformed = (F.lower("extension") == "json") & F.try_parse_json(F.col("text")).isNull()
    return F.when(F.coalesce(X.strip("text"), F.lit("")) == "", F.concat(F.lit("No text could be read from "), F.coalesce("name", F.lit("the file")), F.lit("."))).when(
        malformed, F.concat(F.coalesce("name", F.lit("The file")), F.lit(" is not valid JSON."))
    )


def last_versions(assets: DataFrame) -> DataFrame:
    """ST1: of an asset that waits several times in a batch, the one that came last."""
    last = Window.partitionBy("asset_id").orderBy(F.desc("queued_at"), F.desc("text"))
    return assets.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def units_of(assets: DataFrame) -> DataFrame:
    """ST3: the units of each asset's last version, none of one that fails."""
    latest = last_versions(assets)
    return parse.evidence_units(latest.where(failure(latest).isNull()))


def states_of(assets: DataFrame) -> DataFrame:
    """ST2: pending, processing, then ready, or failed with the reason. Assets are taken in the order of queued_at, then id: place."""
    order = Window.partitionBy("session_id").orderBy("queued_at", "asset_id")
    steps = F.array(
        F.struct(F.lit("pending").alias("status"), F.lit(0).alias("step")), F.struct(F.lit("processing").alias("status"), F.lit(1).alias("step")),
        F.struct(F.when(F.col("error_message").isNull(), "ready").otherwise("failed").alias("status"), F.lit(2).alias("step")),
    )
    told = assets.withColumn("error_message", failure(assets)).withColumn("place", F.row_number().over(order)).withColumn("s", F.explode(steps))
    message = F.when(F.col("s.status") == "failed", F.col("error_message"))
    return told.select("asset_id", "session_id", "queued_at", "s.status", "s.step", message.alias("error_message"), "place")


def latest_states(log: DataFrame) -> DataFrame:
    at = F.struct("queued_at", "step")
    return log.groupBy("asset_id").agg(F.max_by("session_id", at).alias("session_id"), F.max_by("status", at).alias("status"), F.max_by("error_message", at).alias("error_message"))


def start(spark: SparkSession, source: str, root: str, once: bool = True) -> StreamingQuery:
    """ST1, ST4, ST5: reads new JSON files of assets in `source` and keeps units, digests, states and the search index under `root`."""

    def batch(assets: DataFrame, number: int) -> None:
        assets = assets.persist()
        units = units_of(assets)
        for name, df in (("units", units), ("digests", asset_digests(units)), ("states", states_of(assets))):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        if number and number % COMPACT == 0:
            search_index.compacted(spark, f"{root}/index")
        written = spark.read.schema(units.schema).parquet(f"{root}/units/batch={number}")
        search_index.write_segment(f"{root}/index", number * STEP, written, assets.select("asset_id", F.lit(False).alias("deleted")))
        assets.unpersist()

    stream = spark.readStream.schema(ASSET).json(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2500 milliseconds")).start()


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """ST3: the units or digests of the last batch that held each asset, none if it has no text any more."""
    last = spark.read.parquet(f"{root}/states").groupBy("asset_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{root}/{name}").join(last, ["asset_id", "batch"], "left_semi").drop("batch")


def current_units(spark: SparkSession, root: str) -> DataFrame:
    return current(spark, root, "units")


def current_index(spark: SparkSession, root: str) -> search_index.Index:
    """ST5: the search index over the current units."""
    return search_index.load(spark, f"{root}/index")
