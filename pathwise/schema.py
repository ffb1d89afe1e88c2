"""The value order, tiers and checks that operators make on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten dimensions; the order has meaning.
DIMS = ("self_direction", "stimulation", "hedonism", "achievement", "power", "security", "conformity", "tradition", "benevolence", "universalism")

#: Confidence tiers of a vote, from the surest.
TIERS = ("unanimous", "strong", "bare_majority", "no_majority")


def dims_table(spark: SparkSession) -> DataFrame:
    """dim_index, dimension: ten rows."""
    return spark.createDataFrame(list(enumerate(DIMS)), "dim_index int, dimension string")


def assert_columns(df: DataFrame, required) -> DataFrame:
    """`df`, or ValueError with the names of the columns that it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, or ValueError with up to five keys that occur more than once."""
    twice = duplicate_keys(df, keys).limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return df
