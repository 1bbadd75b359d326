"""Running sums and curves per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_exit_date, complete, gross_pnl, money_sum, units


def running(df: DataFrame, value: Column, order: list[str], day: str | None = None) -> DataFrame:
    """Exact running sum of value per user in the given order, as column ``running``.

    With ``day`` (the first of the order) in two steps: sums of days run over each user's days, and within a day over
    its rows. Then the largest window is a user's day, not a user, however busy the account. Rows without a day come
    first. Also the sum before each row, ``before``, NULL for a user's first row.
    """
    exact = units(value)
    if day is None:
        w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("running", F.sum(exact).over(w).cast("double") / 1e8)
    days = df.groupBy("user_id", day).agg(F.sum(exact).alias("_sum"))
    before = Window.partitionBy("user_id").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("user_id").alias("_user"), F.col(day).alias("_day"), F.sum("_sum").over(before).alias("_before"))
    rows = Window.partitionBy("user_id", day).orderBy(*order[1:])
    within, own = F.sum(exact).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(exact).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    both = df.join(days, F.col("user_id").eqNullSafe(F.col("_user")) & F.col(day).eqNullSafe(F.col("_day")))
    zero = F.coalesce(F.col("_before"), F.lit(0))
    some = F.col("_before").isNotNull() | F.col("_own").isNotNull()
    both = both.withColumns({"_within": within, "_own": own})
    sums = {"running": (zero + F.col("_within")).cast("double") / 1e8, "before": F.when(some, (zero + F.coalesce(F.col("_own"), F.lit(0))).cast("double") / 1e8)}
    return both.withColumns(sums).drop("_before", "_user", "_day", "_within", "_own")


def equity_curve(trades: DataFrame, pnl: Column | None = None) -> DataFrame:
    """Complete trades in order of entry (those without an entry date first) with the cumulative P&L, and the one before."""
    rows = trades.where(complete()).withColumn("pnl", gross_pnl() if pnl is None else pnl).select("user_id", "trade_id", "date", "pnl")
    return running(rows, F.col("pnl"), ["date", "trade_id"], day="date").withColumnsRenamed({"running": "equity", "before": "previous"})


def running_balance(periods: DataFrame) -> DataFrame:
    return running(periods, F.col("pnl"), ["period"]).withColumnRenamed("running", "running_balance")


def period_change(periods: DataFrame) -> DataFrame:
    """Each user's latest period beside the one before."""
    w = Window.partitionBy("user_id").orderBy("period")
    last = Window.partitionBy("user_id").orderBy(F.desc("period"))
    rows = periods.withColumns({"previous_pnl": F.lag("pnl").over(w), "_n": F.row_number().over(last)})
    return rows.where("_n = 1").select("user_id", "period", "pnl", "previous_pnl", (F.col("pnl") - F.col("previous_pnl")).alias("change"))


def account_curve(months: DataFrame, trades: DataFrame, as_of: Column) -> DataFrame:
    """Points of the account: month starts, month ends where the close is known, and today's if this month has a row."""
    w = Window.partitionBy("user_id").orderBy("month_start")
    now = F.trunc(as_of, "month")
    profit = trades.where(complete() & (F.trunc(any_exit_date(), "month") == now)).groupBy("user_id").agg(money_sum(gross_pnl()).alias("_now"))
    rows = months.withColumn("_last", F.lag("start_cap").over(w)).join(profit, "user_id", "left").withColumn("_now", F.coalesce("_now", F.lit(0.0)))
    point = lambda day, equity, pnl, kind: F.struct(day.alias("date"), equity.alias("equity"), pnl.alias("pnl"), F.lit(kind).alias("type"))
    start, close = F.col("start_cap"), F.col("close_cap")
    points = F.array(
        point(F.col("month_start"), start, F.coalesce(start - F.col("_last"), F.lit(0.0)), "month_start"),
        F.when(F.coalesce(close != 0, F.lit(False)), point(F.last_day("month_start"), close, close - start, "month_end")),
        F.when(F.col("month_start") == now, point(as_of, start + F.col("_now"), F.col("_now"), "current")),
    )
    return rows.select("user_id", F.explode(F.array_compact(points)).alias("p")).select("user_id", "p.*")
