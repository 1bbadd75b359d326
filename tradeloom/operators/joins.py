"""Lookups of user settings. One row per user: Spark broadcasts small ones and co-partitions large ones by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import given
from ..sources.schemas import FEE_DEFAULTS, PROFILE_DEFAULTS


def with_fees(trades: DataFrame, fees: DataFrame) -> DataFrame:
    """Trades with the five charged fees of their user, defaults where a user or a value is missing."""
    own = fees.select("user_id", *FEE_DEFAULTS)
    joined = trades.join(own, "user_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in FEE_DEFAULTS.items()})


def with_balance(trades: DataFrame, profiles: DataFrame, name: str = "balance") -> DataFrame:
    """Trades with the balance to size risk by: as given, else the profile's, else the default."""
    own = profiles.select("user_id", F.col("account_balance").alias("_profile_balance"))
    balance: Column = F.when(given("account_balance"), F.col("account_balance")).otherwise(F.coalesce("_profile_balance", F.lit(PROFILE_DEFAULTS["account_balance"])))
    return trades.join(own, "user_id", "left").withColumn(name, balance).drop("_profile_balance")


def rate_as_of(requests: DataFrame, rates: DataFrame, max_age_seconds: int = 300) -> DataFrame:
    """requests (currency, ts, ...) with the last rate fetched at or before ts, unless it is older than max_age_seconds.

    An as-of join by union and one window over each currency's times; both sides meet sorted, no pair is formed.
    """
    from pyspark.sql import Window

    columns = requests.columns
    right = rates.select(F.col("currency"), F.col("fetched_at").alias("_at"), F.lit(0).alias("_side"), F.col("rate_per_usdt").alias("_rate"), F.col("fetched_at").alias("_fetched"))
    left = requests.withColumns({"_at": F.col("ts"), "_side": F.lit(1)})
    both = left.unionByName(right, allowMissingColumns=True)
    # a currency's times are cut into spans of max_age, so that one currency is many partitions; the rate of the
    # span before is close enough to be seen from the next, so each rate is in two spans
    span = F.floor(F.unix_timestamp("_at") / max_age_seconds)
    both = both.withColumn("_span", F.when(F.col("_side") == 1, F.array(span)).otherwise(F.array(span, span + 1))).withColumn("_span", F.explode("_span"))
    w = Window.partitionBy("currency", "_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_rate", "_fetched")), ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.unix_timestamp("ts") - F.unix_timestamp("_last._fetched") < max_age_seconds
    return found.select(*columns, F.when(fresh, F.col("_last._rate")).alias("rate"))


def parsed_rates(responses: DataFrame) -> DataFrame:
    """(currency, rate_per_usdt, fetched_at) of rate responses (body, fetched_at): JSON with four rates under ``tether``.

    A body without one of them, or with a rate of 0, is no valid response and gives no rows.
    """
    kinds = ("usd", "inr", "eur", "sgd")
    rates = F.from_json("body", "tether struct<usd: double, inr: double, eur: double, sgd: double>")["tether"]
    rows = responses.select("fetched_at", rates.alias("r"))
    valid = F.lit(True)
    for k in kinds:
        valid = valid & F.coalesce(F.col(f"r.{k}") != 0, F.lit(False))
    each = F.explode(F.array(*(F.struct(F.lit(k.upper()).alias("currency"), F.col(f"r.{k}").alias("rate_per_usdt")) for k in kinds)))
    return rows.where(valid).select(each.alias("x"), "fetched_at").select("x.*", "fetched_at")
