"""Daily sums and their running totals, kept up to date by changes instead of being summed anew.

A change is rows taken away and rows put in (an edited trade is both). They become signed sums by user and day; stored days
are read and written from a user's first touched day on, other users' days and earlier months stay as they are. Sums are
whole units, so adding and taking away leaves no trace in the last digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import complete, effective_date, gross_pnl, units
from ..sources.versions import MonthTable

#: The day of rows without one: before all others.
UNDATED = "0001-01-01"
_KEYS = ["user_id", "day"]


class DailySums:
    """A stored table of user_id, day, units (P&L in 1e-8), trades, running (units up to and with the day).

    day and where say which rows count and on which day; rows without a user aren't kept.
    """

    def __init__(self, spark: SparkSession, path: str, day: Column, where: Column):
        self.table = MonthTable(spark, path, _KEYS, F.col("day"))
        self._day, self._where = day, where

    def _sums(self, trades: DataFrame, sign: int) -> DataFrame:
        day = F.coalesce(self._day, F.lit(UNDATED).cast("date"))
        rows = trades.where(self._where & F.col("user_id").isNotNull()).select("user_id", day.alias("day"), units(F.when(complete(), gross_pnl()).otherwise(0.0)).alias("u"))
        return rows.groupBy(*_KEYS).agg((F.sum("u") * sign).cast("decimal(38,0)").alias("units"), (F.count("*") * sign).alias("trades"))

    def create(self, trades: DataFrame) -> int:
        w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.table.create(self._sums(trades, 1).withColumn("running", F.sum("units").over(w).cast("decimal(38,0)")))

    def change(self, removed: DataFrame, added: DataFrame) -> int:
        """The number of the version in which ``removed`` rows, as they were counted, are gone and ``added`` ones are in."""
        deltas = self._sums(removed, -1).unionByName(self._sums(added, 1)).groupBy(*_KEYS).agg(F.sum("units").cast("decimal(38,0)").alias("units"), F.sum("trades").alias("trades"))
        deltas = deltas.where("units <> 0 or trades <> 0").persist()
        try:
            first = deltas.groupBy("user_id").agg(F.min("day").alias("first"))
            start = first.agg(F.date_format(F.min("first"), "yyyy-MM")).first()[0]
            if start is None:
                return self.table.version()
            months = [m for m in self.table.state()["months"] if m >= start]
            later = self.table.read(months=months).join(first, "user_id").where("day >= first").select(*_KEYS, "units", "trades")
            days = later.unionByName(deltas).groupBy(*_KEYS).agg(F.sum("units").cast("decimal(38,0)").alias("units"), F.sum("trades").alias("trades"))
            before = self.table.read().join(first, "user_id").where("day < first").groupBy("user_id").agg(F.max_by("running", "day").alias("base"))
            w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            days = days.join(before, "user_id", "left").withColumn("running", (F.coalesce("base", F.lit(0)) + F.sum("units").over(w)).cast("decimal(38,0)")).drop("base").persist()
            try:
                return self.table.merge(days.where("trades > 0"), delete=days.where("trades <= 0").select(*_KEYS), within=months)
            finally:
                days.unpersist()
        finally:
            deltas.unpersist()

    def read(self) -> DataFrame:
        """user_id, day (NULL for undated rows), pnl, trades, running as money."""
        day = F.when(F.col("day") != F.lit(UNDATED).cast("date"), F.col("day"))
        return self.table.read().select("user_id", day.alias("day"), (F.col("units").cast("double") / 1e8).alias("pnl"), "trades", (F.col("running").cast("double") / 1e8).alias("running"))


def equity_days(spark: SparkSession, path: str) -> DailySums:
    """The equity curve's days: complete trades by entry."""
    return DailySums(spark, path, F.col("date"), complete())


def calendar_days(spark: SparkSession, path: str) -> DailySums:
    """The calendar's days: all trades by the day on which they count."""
    return DailySums(spark, path, effective_date(), F.lit(True))
