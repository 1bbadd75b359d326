"""Explicit schemas of the journal's tables, and the defaults of missing settings."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "date": T.DateType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _fields(text: str) -> T.StructType:
    """Fields of `name kind, ...`; unlike DDL this needs no running session, so workers can import it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(", "))])


TRADES = _fields(
    "trade_id string, user_id long, date date, exit_date date, ticker string, buy_price double, sell_price double, shares double, risk double, risk_dollars double, account_balance double, notes string, status string, created_at timestamp, updated_at timestamp, pnl double"
)
PROFILES = _fields("user_id long, account_balance double, currency string, risk_tolerance double, created_at timestamp, updated_at timestamp")
FEES = _fields(
    "user_id long, brokerage_percentage double, brokerage_max_usd double, exchange_transaction_charges_percentage double, ifsca_turnover_fees_percentage double, platform_fee_usd double, withdrawal_fee_usd double, amc_yearly_usd double, account_opening_fee_usd double, tracking_charges_usd double, profile_verification_fee_usd double, created_at timestamp, updated_at timestamp"
)
MONTHLY_RETURNS = _fields("user_id long, month string, start_cap double, close_cap double, percentage_return double, dollar_return double, inr_return double, comments string, created_at timestamp, updated_at timestamp")
EXIT_REQUESTS = _fields("request_id string, user_id long, ticker string, shares_to_exit double, sell_price double, notes string, ts timestamp")

#: What a user without settings gets.
FEE_DEFAULTS = {"brokerage_percentage": 0.25, "brokerage_max_usd": 25.0, "exchange_transaction_charges_percentage": 0.12, "ifsca_turnover_fees_percentage": 0.0001, "platform_fee_usd": 0.0}
PROFILE_DEFAULTS = {"account_balance": 10000.0, "currency": "USD", "risk_tolerance": 2.0}
