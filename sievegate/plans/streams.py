"""Queries that run the session operators as streams over the events table, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..streaming import sessions
from .common import table
from .decisions import _MCP

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return stream.withColumn("rank", rank).withColumn("seq", F.col("event_id"))


def _done(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives over all that is there, from files in the shared folder."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/seen").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


_BY_ID = _MCP.replace("order by ts, event_id", "order by event_id")


@query(f"{_BY_ID} select event_id, cast(prior_taint as int) as prior_taint, cast(taint as int) as taint from t")
def stream_running_taint(spark, sf_dir):
    rows = sessions.running_taint(_events(spark, sf_dir).select("event_id", "user_id", "seq", "rank"), "user_id", "seq", "rank")
    return _done(rows, "taint").select("event_id", "prior_taint", "taint")


@query("select event_id, count(*) over w as seen, count(*) filter (event_type = 'view') over w as denied from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def stream_server_history(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "seq", F.when(F.col("event_type") == "view", "deny").otherwise("allow").alias("verdict"))
    return _done(sessions.server_history(rows, "user_id", "seq", "verdict"), "history").select("event_id", "seen", "denied")
