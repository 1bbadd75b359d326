"""Calendar summaries by effective date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete, effective_date, gross_pnl, money_sum, month_start, week_start


def _with_pnl(trades: DataFrame, pnl: Column | None) -> DataFrame:
    return trades.withColumns({"day": effective_date(), "_pnl": F.when(complete(), gross_pnl() if pnl is None else pnl).otherwise(0.0)})


def daily(trades: DataFrame, pnl: Column | None = None, with_trades: bool = False) -> DataFrame:
    """Per user and day: all trades counted, complete ones summed. Lists of trades only on request: a busy day's list
    is one row."""
    more = [F.sort_array(F.collect_list("trade_id")).alias("trades")] if with_trades else []
    return _with_pnl(trades, pnl).groupBy("user_id", "day").agg(money_sum(F.col("_pnl")).alias("pnl"), F.count("*").alias("trade_count"), *more)


def monthly(trades: DataFrame, pnl: Column | None = None) -> DataFrame:
    return _with_pnl(trades, pnl).groupBy("user_id", month_start(F.col("day")).alias("month")).agg(money_sum(F.col("_pnl")).alias("pnl"), F.count("*").alias("trade_count"))


def totals(trades: DataFrame) -> DataFrame:
    """Per user and month, and per user and year (month NULL): P&L, trades, trading days or trading months."""
    days = daily(trades).withColumns({"month": month_start(F.col("day")), "year": F.year("day")})
    months = days.groupBy("user_id", "year", "month").agg(money_sum(F.col("pnl")).alias("pnl"), F.sum("trade_count").alias("trades"), F.count("*").alias("active"))
    both = months.rollup("user_id", "year", "month").agg(money_sum(F.col("pnl")).alias("pnl"), F.sum("trades").alias("trades"), F.max("active").alias("_days"), F.count("*").alias("_months"), F.grouping_id().alias("_g"))
    return both.where("_g < 2").select("user_id", "year", "month", "pnl", "trades", F.when(F.col("_g") == 0, F.col("_days")).otherwise(F.col("_months")).alias("active"))


def grid(trades: DataFrame, month: Column) -> DataFrame:
    """For each user six weeks from the Sunday on or before the month's first, days without trades as zeros."""
    start = week_start(F.trunc(month, "month"))
    days = trades.select("user_id").distinct().withColumn("day", F.explode(F.sequence(start, F.date_add(start, 41))))
    some = daily(trades.where(effective_date().between(start, F.date_add(start, 41))))
    return days.join(some, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"), (F.trunc("day", "month") == F.trunc(month, "month")).alias("in_month"))
