"""Observation histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explain(live: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """All observations of every key: the live row, and the history without what the live row repeats.

    The newest content row of a live key is the live row itself, which has the later ``observed_at``. Of
    a deleted key that row comes tagged ``deleted``. Tombstones are never shown.
    """
    w = Window.partitionBy(*key).orderBy(F.desc("history_id"))
    content = history.where("NOT tombstone").withColumn("_r", F.row_number().over(w)).drop("history_id", "tombstone")
    alive = live.select(*key).withColumn("_alive", F.lit(True))
    told = content.join(alive, key, "left")
    past = told.where("NOT (_r = 1 AND _alive IS NOT NULL)").withColumn("deleted", F.col("_alive").isNull() & (F.col("_r") == 1))
    now = live.withColumn("deleted", F.lit(False))
    return now.unionByName(past.select(*now.columns))


def changes(history: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """History rows whose content differs from the row before of the same key (a first row differs)."""
    w = Window.partitionBy(*key).orderBy("history_id")
    row = F.struct(*content, "tombstone")
    return history.withColumn("_before", F.lag(row).over(w)).where(~row.eqNullSafe(F.col("_before"))).drop("_before")
