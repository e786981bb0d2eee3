"""The append-only feedback log as a stream: rates per rule, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import feedback_rates

SCHEMA = "ts string, title string, rule_id string, verdict string"


def read_log(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """JSONL files of a folder as they arrive; broken lines are dropped."""
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)
    return lines.where("rule_id is not null").withColumn("at", F.to_timestamp("ts"))


def rates(log: DataFrame) -> DataFrame:
    """Running counts and rates per rule (complete mode)."""
    return feedback_rates(log, "rule_id", "verdict")


def windowed(log: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Verdicts per rule and week; rows later than the watermark are left out (append mode)."""
    return log.withWatermark("at", late).groupBy(F.window("at", width), "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "dismiss").alias("dismissed"))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Run into an in-memory table by name; the checkpoint folder must be shared."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
