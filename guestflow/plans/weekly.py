"""E1 as the weekly job it is: complaints are logged by month and week, a run reads
back 60 days of the log and writes its own weeks of the pattern table.

Both tables are written with dynamic partition overwrite, so a run replaces exactly the
weeks it covers and may be repeated; what it reads is pruned by month."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R

LOG_SCHEMA = "message_id string, property_id string, topic string, sent_at timestamp_ntz, month string, week date"
PATTERN_SCHEMA = "property_id string, topic string, n_flagged bigint, max_in_window bigint, week date"


def _overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def complaint_log(spark: SparkSession, folder: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
    """Logged complaints in [since, until), from the months they can lie in."""
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log")
            .where(F.col("month").between(since.strftime("%Y-%m"), until.strftime("%Y-%m")))
            .where((F.col("sent_at") >= at(since)) & (F.col("sent_at") < at(until))))


def run_weeks(msgs: DataFrame, ai: DataFrame, folder: str, first: dt.date, end: dt.date, n: int = 3, days: int = 60) -> None:
    """The pattern job for the weeks from ``first`` to before ``end`` (both Mondays).

    ``msgs`` and ``ai`` need to hold the new weeks only; earlier complaints come from
    the log of earlier runs. Runs go forward in time."""
    if monday(first) != first or monday(end) != end:
        raise ValueError("weeks start on Mondays")
    spark = msgs.sparkSession
    low, high = dt.datetime.combine(first, dt.time()), dt.datetime.combine(end, dt.time())
    within = lambda c: (F.col(c) >= F.lit(str(low)).cast("timestamp_ntz")) & (F.col(c) < F.lit(str(high)).cast("timestamp_ntz"))
    new = R.inbound_complaints(msgs.where(within("sent_at")), ai.where(within("created_at")))  # an audit row is made as its message is processed
    week = F.date_trunc("week", F.col("sent_at")).cast("date")
    new = new.select("message_id", "property_id", R.complaint_topic("raw_content").alias("topic"), "sent_at",
                     F.date_format("sent_at", "yyyy-MM").alias("month"), week.alias("week"))
    _overwrite_partitions(new, f"{folder}/log", "month", "week")
    seen = complaint_log(spark, folder, low - dt.timedelta(days=days), high).select("message_id", "property_id", "topic", "sent_at")
    counted = R.rolling_count(seen, ["property_id", "topic"], "sent_at", days)
    flagged = counted.where(within("sent_at") & (F.col("rolling_count") >= n))
    found = (flagged.groupBy("property_id", "topic", week.alias("week"))
             .agg(F.count(F.lit(1)).alias("n_flagged"), F.max("rolling_count").alias("max_in_window")))
    _overwrite_partitions(found.select("property_id", "topic", "n_flagged", "max_in_window", "week"), f"{folder}/patterns", "week")


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern table: as ``recurring_complaints`` over the whole history."""
    return (spark.read.schema(PATTERN_SCHEMA).parquet(f"{folder}/patterns")
            .select("property_id", "topic", F.col("week").cast("timestamp_ntz").alias("week"), "n_flagged", "max_in_window"))
