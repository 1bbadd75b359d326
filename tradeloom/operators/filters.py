"""Date ranges, presets and validation. Clocks are arguments: nothing reads the time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete, effective_date, given


def in_range(day: Column, start: Column, end: Column) -> Column:
    """Inclusive on both sides; a NULL side is open."""
    return (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def metrics_range(trades: DataFrame, start: Column, end: Column) -> DataFrame:
    """Trades whose effective date and entry date both lie in the range; for a user with none of these, the trades
    entered in the month of start (of end, if there is no start). No branch on the driver.

    Which users have any is one aggregation that leaves a row per user with one in the range; candidates of both kinds then
    meet it by a join, so no user's rows have to be together.
    """
    entered = F.col("date").isNotNull() & in_range(F.col("date"), start, end)
    inside = F.coalesce(in_range(effective_date(), start, end) & entered, F.lit(False))
    month = F.coalesce(F.trunc("date", "month") == F.trunc(F.coalesce(start, end), "month"), F.lit(False))
    rows = trades.withColumns({"_in": inside, "_month": month}).where("_in or _month")
    some = rows.where("_in").select(F.col("user_id").alias("_user")).distinct()
    both = rows.join(some, F.col("user_id").eqNullSafe(F.col("_user")) & ~F.col("_in"), "left_anti")
    return both.drop("_in", "_month")


def metrics_range_totals(trades: DataFrame, start: Column, end: Column, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per user over metrics_range(), without a window: both candidate sets are summed in one pass and the
    choice is made on the sums. aggregates: functions of a condition, name -> condition -> column."""
    entered = F.col("date").isNotNull() & in_range(F.col("date"), start, end)
    inside = F.coalesce(in_range(effective_date(), start, end) & entered, F.lit(False))
    month = F.coalesce(F.trunc("date", "month") == F.trunc(F.coalesce(start, end), "month"), F.lit(False))
    rows = trades.withColumns({"_in": inside, "_month": month}).where("_in or _month")
    sums = rows.groupBy("user_id").agg(F.max("_in").alias("_any"), *(make(F.col("_in")).alias(f"_in_{n}") for n, make in aggregates.items()), *(make(F.col("_month")).alias(f"_month_{n}") for n, make in aggregates.items()))
    return sums.select("user_id", *(F.when(F.col("_any"), F.col(f"_in_{n}")).otherwise(F.col(f"_month_{n}")).alias(n) for n in aggregates))


def presets(trades: DataFrame, as_of: Column) -> DataFrame:
    """Trades once for each preset range that their effective date lies in (at most six), with preset, start, end."""
    month, quarter, year = F.trunc(as_of, "month"), F.trunc(as_of, "quarter"), F.trunc(as_of, "year")
    ranges = {
        "This Month": (month, F.last_day(as_of)),
        "Last Month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "Last 3 Months": (F.add_months(month, -2), F.last_day(as_of)),
        "This Quarter": (quarter, F.date_sub(F.add_months(quarter, 3), 1)),
        "This Year": (year, F.date_sub(F.add_months(year, 12), 1)),
        "Last Year": (F.add_months(year, -12), F.date_sub(year, 1)),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("preset"), a.alias("start"), b.alias("end")) for n, (a, b) in ranges.items()))
    return trades.withColumn("_p", F.explode(F.filter(rows, lambda p: effective_date().between(p["start"], p["end"])))).select("*", "_p.*").drop("_p")


def search(trades: DataFrame, term: str, status: str | None = None) -> DataFrame:
    """Ticker or notes contain the term, in either case; optionally of one status."""
    t = F.lit(term.lower())
    hit = F.contains(F.lower("ticker"), t) | F.coalesce(F.contains(F.lower("notes"), t), F.lit(False))
    return trades.where(hit if status is None else hit & (F.col("status") == status))


def open_positions(trades: DataFrame) -> DataFrame:
    return trades.where((F.col("status") == "open") & (F.abs("shares") >= 1e-10))


def eligible(trades: DataFrame) -> DataFrame:
    return trades.where(complete())


def reasons(**rules: Column) -> Column:
    """Names of the rules that a row breaks; a rule that can't be told (NULL) counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items())))


def trade_faults() -> Column:
    closed = F.col("status") == "closed"
    return reasons(buy_price=closed | given("buy_price"), sell_price=~closed | given("sell_price"), risk=given("risk") | given("risk_dollars"))


def profile_faults(balance: Column, tolerance: Column) -> Column:
    """Values may be text; missing tolerance is fine (it gets the default)."""
    return reasons(account_balance=balance.try_cast("double") > 0, risk_tolerance=tolerance.isNull() | tolerance.try_cast("double").between(0, 100))


def fee_faults() -> Column:
    others = [
        "brokerage_max_usd", "exchange_transaction_charges_percentage", "ifsca_turnover_fees_percentage", "platform_fee_usd", "withdrawal_fee_usd",
        "amc_yearly_usd", "account_opening_fee_usd", "tracking_charges_usd", "profile_verification_fee_usd",
    ]
    return reasons(brokerage_percentage=F.col("brokerage_percentage").between(0, 10), **{n: F.coalesce(F.col(n), F.lit(0.0)) >= 0 for n in others})


def month_faults() -> Column:
    return reasons(month=F.length(F.trim("month")) > 0, start_cap=F.col("start_cap") > 0)
