"""The given tables seen as turnstile transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.fixed import DEFAULT_GATES

# Two of twelve users in every dozen pass a gate that is not on the list.
OTHER_GATE = "TK99RT99"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Old-format transactions: ``events`` with a gate and a direction."""
    gates = ", ".join(f"'{g}'" for g in [*DEFAULT_GATES, OTHER_GATE, OTHER_GATE])
    return table(spark, folder, "events").selectExpr(
        "event_id",
        f"coalesce(get(array({gates}), CAST(user_id % 12 AS INT)), '{OTHER_GATE}') "
        "AS tema_key",
        "ts AS transaction_date",
        "CASE WHEN event_type IN ('view', 'signup') THEN 'Entry' "
        "WHEN event_type IN ('purchase', 'error') THEN 'Exit' "
        "ELSE 'Denied' END AS transit_direction_description",
        "event_type AS transit_status_description",
        "CAST(user_id AS STRING) AS card_number",
    )


def new_format(spark: SparkSession, folder: str) -> DataFrame:
    """The same under the column names of the new export."""
    return transactions(spark, folder).select(
        F.col("tema_key").alias("name"),
        F.col("transaction_date").alias("operator"),
        F.col("transit_direction_description").alias("sap_transit_flag"),
        "card_number",
    )


def precounted(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and exits as numbers, one row per transaction."""
    way = F.col("transit_direction_description")
    return transactions(spark, folder).select(
        F.col("transaction_date").alias("ts"),
        (way == "Entry").cast("bigint").alias("entradas"),
        (way == "Exit").cast("bigint").alias("salidas"),
    )
