"""Decayed edges as a stream: an extension beyond batch parity.

Chapters arrive in order as micro-batches of edge observations (k, a, b, weight, sentiment_e4). Each
batch joins the state table of live edges, and the new state is written under its own number, so a batch
that is run again after a failure reads the state it read before and writes the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkgraph.functions.numbers import TICKS, round_div

STATE = "a long, b long, weight_e4 long, sentiment_e4 long, k int"


def step(state: DataFrame, observed: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """The live edges after chapter k, from those before it and its observations: one full outer join."""
    both = state.select("a", "b", F.col("weight_e4").alias("w"), F.col("sentiment_e4").alias("s")).join(observed.select("a", "b", "weight", F.col("sentiment_e4").alias("n")), ["a", "b"], "full_outer")
    new = F.col("weight").isNotNull()
    w, s = F.coalesce("w", F.lit(0).cast("bigint")), F.coalesce("s", F.lit(0).cast("bigint"))
    fresh = F.col("weight") * TICKS
    kept = both.filter(new | (w * percent >= round(least * TICKS) * 100))
    weight = F.when(new & F.lit(k == 1), fresh).when(new, round_div(w * percent + fresh * (100 - percent), 100)).otherwise(round_div(w * percent, 100))
    sentiment = F.when(new & F.lit(k == 1), F.col("n")).when(new, round_div(s * percent + F.col("n") * (100 - percent), 100)).otherwise(round_div(s * percent, 100))
    return kept.select("a", "b", weight.alias("weight_e4"), sentiment.alias("sentiment_e4"), F.lit(k).alias("k"))


def run(spark: SparkSession, observations: DataFrame, folder: str, percent: int = 70, least: float = 0.5) -> StreamingQuery:
    """Start the stream. ``observations``: a streaming frame, one chapter a micro-batch; state and results go to ``folder``/k=N."""

    def handle(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{folder}/state-{number - 1}") if number else spark.createDataFrame([], STATE)
        step(before, batch, number + 1, percent, least).write.mode("overwrite").parquet(f"{folder}/state-{number}")

    return observations.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/progress").start()
