"""Raw impressions out of a generic event log.

The impression log this engine works on has its conversions attributed already.  The log
of events has not: an impression (view or click) is attributed the user's first purchase
of at least ``min_value`` at or after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_seconds
from ..operators.running import HotKeys, Measure, running_by_key

LOG_START = "2024-01-01 00:00:00"
LOG_START_EPOCH = 1_704_067_200
IMPRESSION_TYPES = ("view", "click")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; wall-clock timestamps become UTC timestamps at ingest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def raw_impressions(
    events: DataFrame,
    *,
    min_value: float = 100.0,
    hot: HotKeys | None = None,
) -> DataFrame:
    """One row per view or click with its attributed conversion.

    Impressions and purchases come from one scan and one shuffle on the user.  "First
    purchase at or after" is a running minimum over the user's events in descending time
    (Spark evaluates a frame that ends at the current row in one pass; one that starts
    there costs a pass per row), so no row is multiplied as in a join on user and time.
    """
    purchase = (F.col("event_type") == "purchase") & (F.col("value") >= min_value)
    rows = (
        events.filter(F.col("event_type").isin(*IMPRESSION_TYPES) | purchase)
        .select(
            F.col("event_id").alias("impression_id"),
            F.col("user_id").alias("uid"),
            "ts",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(0)).alias("is_purchase"),
            F.when(F.col("event_type") == "click", F.lit(1)).otherwise(F.lit(0)).alias("click"),
            F.when(purchase, F.col("ts")).alias("purchase_ts"),
            F.when(F.col("event_type") == "click", F.col("ts")).alias("click_ts"),
        )
    )
    # At equal times the purchase still belongs to the impression, so it sorts after it.
    order = ["ts", "is_purchase", "impression_id"]
    rows = running_by_key(
        rows, "uid", order,
        [Measure("next_purchase_ts", "purchase_ts", "min", descending=True, inclusive=True),
         Measure("last_click_ts", "click_ts", "max")],
        hot=hot,
    )
    conversion = epoch_seconds(F.col("next_purchase_ts")) - LOG_START_EPOCH
    cat4 = F.col("k") % 7
    return rows.filter(F.col("is_purchase") == 0).select(
        "impression_id",
        "uid",
        (epoch_seconds(F.col("ts")) - LOG_START_EPOCH).alias("timestamp"),
        F.coalesce(conversion, F.lit(-1).cast("long")).alias("conversion_timestamp"),
        F.col("next_purchase_ts").isNotNull().cast("int").alias("conversion"),
        "click",
        (F.col("k") % 10).alias("campaign"),
        F.col("k").alias("cat1"),
        F.least(F.floor(F.col("value") / 25), F.lit(8)).cast("int").alias("cat2"),
        F.hour("ts").alias("cat3"),
        F.when(cat4 != 0, cat4).alias("cat4"),
        (epoch_seconds(F.col("ts")) - epoch_seconds(F.col("last_click_ts")))
        .cast("double").alias("time_since_last_click"),
    )
