"""Per-trade derivations as columns. Arguments are columns or their names; nothing here is a UDF.

A price of 0 counts as missing nearly everywhere (`given`); where only NULL is missing, the function says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def given(x: C) -> Column:
    """Neither NULL nor 0."""
    return F.coalesce(col(x) != 0, F.lit(False))


def units(x: Column) -> Column:
    """Money in whole units of 1e-8, as a decimal: sums of these are the same in any order of rows."""
    return F.floor(x * 1e8 + 0.5).cast("decimal(20,0)")


def money_sum(x: Column) -> Column:
    return F.sum(units(x)).cast("double") / 1e8


def complete() -> Column:
    """A closed trade with both prices."""
    return (F.col("status") == "closed") & given("sell_price") & given("buy_price")


def gross_pnl() -> Column:
    return F.when(given("buy_price") & given("sell_price"), (F.col("sell_price") - F.col("buy_price")) * F.col("shares")).otherwise(0.0)


def leg_parts(value: Column) -> dict[str, Column]:
    """Fee parts of one leg of a given value, for the fee columns of the row."""
    return {
        "brokerage": F.least(value * (F.col("brokerage_percentage") / 100), F.col("brokerage_max_usd")),
        "exchange_fee": value * (F.col("exchange_transaction_charges_percentage") / 100),
        "ifsca_fee": value * (F.col("ifsca_turnover_fees_percentage") / 100),
        "platform_fee": F.col("platform_fee_usd"),
    }


def leg_fees(value: Column) -> Column:
    p = leg_parts(value)
    return p["brokerage"] + p["exchange_fee"] + p["ifsca_fee"] + p["platform_fee"]


def buy_value() -> Column:
    return F.coalesce("buy_price", F.lit(0.0)) * F.col("shares")


def sell_value() -> Column:
    return F.coalesce("sell_price", F.lit(0.0)) * F.col("shares")


def has_sell_leg() -> Column:
    return (F.col("status") == "closed") & given("sell_price")


def trade_fees() -> Column:
    """Both legs, each with its own cap, of a sold trade; the buy leg alone of any other."""
    return leg_fees(buy_value()) + F.when(has_sell_leg(), leg_fees(sell_value())).otherwise(0.0)


def net_pnl() -> Column:
    return F.when(complete(), (F.col("sell_price") - F.col("buy_price")) * F.col("shares") - trade_fees()).otherwise(0.0)


def effective_date() -> Column:
    """The day on which a trade counts: a closed one's exit if known, else its entry."""
    return F.when(F.col("status") == "closed", F.coalesce("exit_date", "date")).otherwise(F.col("date"))


def any_exit_date() -> Column:
    """Exit date if there is one, whatever the status."""
    return F.coalesce("exit_date", "date")


def half_up(x: Column, digits: int) -> Column:
    """Rounding towards plus infinity at the half, as browsers do."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def normal_shares(x: C) -> Column:
    return F.when(F.abs(col(x)) < 1e-10, 0.0).otherwise(half_up(col(x), 4))


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def risk_display() -> Column:
    """Risk in dollars for lists: as given, or the percentage of the position's value."""
    return F.when(given("risk_dollars"), F.col("risk_dollars")).when(given("risk") & given("buy_price"), F.col("risk") / 100 * F.col("buy_price") * F.col("shares")).otherwise(0.0)


def filled_risk(balance: Column) -> tuple[Column, Column]:
    """(risk %, risk $), the missing one filled from the account balance if that is above 0."""
    ok = F.coalesce(balance > 0, F.lit(False))
    percent = F.when(ok & ~given("risk") & given("risk_dollars"), F.col("risk_dollars") / balance * 100).otherwise(F.col("risk"))
    dollars = F.when(ok & ~given("risk_dollars") & given("risk"), F.col("risk") / 100 * balance).otherwise(F.col("risk_dollars"))
    return percent, dollars


def sharpe_label(x: Column) -> Column:
    return F.when(x >= 2, "Excellent").when(x >= 1.5, "Very Good").when(x >= 1, "Good").when(x >= 0.5, "Fair").when(x >= 0, "Poor").otherwise("Very Poor")


def parsed_number(x: C) -> Column:
    """Text as a number: trimmed, without commas; blank or bad text is 0."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(col(x), r"^\s+|\s+$", ""), ",", "").try_cast("double"), F.lit(0.0))


def parsed_month(x: C, as_of: Column) -> Column:
    """`December 2024` as its first day; anything else is as_of. Names of months are told by case."""
    text = F.trim(col(x))
    names = "January|February|March|April|May|June|July|August|September|October|November|December"
    return F.coalesce(F.when(text.rlike(rf"^({names})\s+[0-9]{{4}}$"), F.try_to_date(F.regexp_replace(text, r"\s+", " "), "MMMM yyyy")), as_of)


def format_shares(x: C) -> Column:
    """Four decimals at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", normal_shares(x)), "0+$", ""), r"\.$", "")


def format_currency(x: C) -> Column:
    return F.concat(F.when(col(x) < 0, "-$").otherwise("$"), F.format_number(F.abs(col(x)), 2))


def format_percent(x: C) -> Column:
    return F.when(col(x).isNotNull(), F.concat(F.format_string("%.2f", col(x)), F.lit("%")))


def display_name(name: C, email: C) -> Column:
    return F.when(F.length(F.coalesce(col(name), F.lit(""))) > 0, col(name)).otherwise(F.split(col(email), "@")[0])


def html_to_text(x: C) -> Column:
    """Tags out, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(x), "<[^<]+?>", ""), r"[ \t\n\r\f\x0B]+", " "))
