"""Recipient tables of campaigns, and usage counts. One aggregation for all users, instead of a query for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money_sum
from .metrics import ratio


def weekly_pnl() -> Column:
    """P&L in the weekly summary: here only NULL is missing, a price of 0 isn't."""
    known = F.col("buy_price").isNotNull() & F.col("sell_price").isNotNull() & F.col("shares").isNotNull()
    return F.when((F.col("status") == "closed") & known, (F.col("sell_price") - F.col("buy_price")) * F.col("shares")).otherwise(0.0)


def in_week(trades: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Trades entered since ``days`` before as_of; later ones than as_of count too."""
    return trades.where(F.col("date") >= F.date_sub(as_of, days))


def weekly_summary(trades: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Per user over the last days by entry date: open trades count in totals and rates. avg_trade_size is mean P&L."""
    rows = in_week(trades, as_of, days).withColumn("_p", weekly_pnl())
    win, loss = F.col("_p") > 0, F.col("_p") < 0
    sums = rows.groupBy("user_id").agg(
        F.count("*").alias("total_trades"), money_sum(F.col("_p")).alias("profit_loss"), F.max("_p").alias("best_trade"), F.min("_p").alias("worst_trade"), F.count_if(win).alias("winning_trades_count"),
        F.count_if(loss).alias("losing_trades_count"), F.countDistinct("date").alias("trading_days"), money_sum(F.when(win, F.col("_p"))).alias("_won"), money_sum(F.when(loss, -F.col("_p"))).alias("_lost"),
    )
    both = (F.col("winning_trades_count") > 0) & (F.col("losing_trades_count") > 0)
    rr = F.when(both, (F.col("_won") / F.col("winning_trades_count")) / (F.col("_lost") / F.col("losing_trades_count"))).otherwise(0.0)
    return sums.withColumns({"win_rate": F.col("winning_trades_count") / F.col("total_trades") * 100, "avg_trade_size": F.col("profit_loss") / F.col("total_trades"), "risk_reward_ratio": rr}).drop("_won", "_lost")


def top_symbols(trades: DataFrame, n: int = 3) -> DataFrame:
    """Each user's most traded tickers: by count, then latest trade, then name. Counted before they are ranked."""
    counts = trades.groupBy("user_id", "ticker").agg(F.count("*").alias("trades"), F.max("date").alias("last"))
    w = Window.partitionBy("user_id").orderBy(F.desc("trades"), F.desc("last"), "ticker")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("user_id", "ticker", "trades", "place")


def weekly_eligible(users: DataFrame, as_of: Column, days: int = 7, active_only: bool = True) -> DataFrame:
    kept = users.where("email is not null and email <> ''")
    return kept.where(F.col("last_sign_in").cast("date") >= F.date_sub(as_of, days)) if active_only else kept


def weekly_recipients(users: DataFrame, trades: DataFrame, users_as_of: Column, as_of: Column) -> DataFrame:
    """Eligible users with a trade in the week, with their summary and their symbols as one text."""
    top = top_symbols(in_week(trades, as_of)).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "ticker", "trades"))), lambda x: F.concat_ws(":", x["ticker"], x["trades"])), ",").alias("symbols"))
    summary = weekly_summary(trades, as_of).join(top, "user_id")
    return weekly_eligible(users, users_as_of).join(summary, F.col("uid") == F.col("user_id")).drop("user_id")


def community(summaries: DataFrame) -> DataFrame:
    """Over per-user rows: mean trades, total P&L, users."""
    return summaries.agg(F.count("*").alias("users"), (F.sum("total_trades") / F.count("*")).alias("avg_trades"), F.coalesce(money_sum(F.col("profit_loss")), F.lit(0.0)).alias("total_pnl"))


def inactive_users(users: DataFrame, flags: DataFrame, now: Column, days: int = 7, again_after: int = 7) -> DataFrame:
    """Users with an address who haven't signed in for ``days`` (never: infinity), unless reminded lately; with their
    flags. flags: uid, reminder_email_sent_at, total_trades."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp("last_sign_in")
    away = F.when(F.col("last_sign_in").isNull(), F.lit(float("inf"))).otherwise(F.floor(seconds / 86400).cast("double"))
    rows = users.where("email is not null and email <> ''").withColumn("days_inactive", away)
    rows = rows.where(F.col("last_sign_in").isNull() | (F.col("last_sign_in") < now - F.expr(f"interval {days} days")))
    rows = rows.join(flags, "uid", "left").withColumn("total_trades", F.coalesce("total_trades", F.lit(0)))
    return rows.where(F.col("reminder_email_sent_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("reminder_email_sent_at") >= again_after * 86400))


def welcome_pending(users: DataFrame, flags: DataFrame, new: DataFrame) -> DataFrame:
    """Users who weren't welcomed, and new users in any case (columns uid, email)."""
    sent = flags.where("welcome_email_sent").select("uid")
    return users.select("uid", "email").join(sent, "uid", "left_anti").union(new.select("uid", "email")).distinct()


def _marked(flags: DataFrame, sent: DataFrame, values: dict[str, Column]) -> DataFrame:
    """flags with the values set for the uids in sent; new uids are added, other flags stay. Values are over sent's columns."""
    told = sent.groupBy("uid").agg(*(F.max(v).alias(f"_{c}") for c, v in values.items()), F.lit(True).alias("_sent"))
    rows = flags.join(told, "uid", "full")
    return rows.select("uid", *(F.when(F.col("_sent"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in flags.columns if c != "uid"))


def mark_sent(flags: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """After the weekly summary; last_summary_week is the day the week ends, as text."""
    return _marked(flags, sent, {"weekly_summary_sent": F.lit(True), "weekly_summary_sent_at": now, "last_summary_week": F.date_format(now, "yyyy-MM-dd")})


def mark_reminded(flags: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """After a reminder. sent: uid, days_inactive."""
    return _marked(flags, sent, {"reminder_email_sent": F.lit(True), "reminder_email_sent_at": now, "last_reminder_days_inactive": F.col("days_inactive")})


def mark_welcomed(flags: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """After the welcome mail. sent: uid, email."""
    return _marked(flags, sent, {"welcome_email_sent": F.lit(True), "welcome_email_sent_at": now, "email": F.col("email")})


def usage_counts(events: DataFrame) -> DataFrame:
    """Events by category (if there is one), action and label, with distinct users."""
    keys = [c for c in ("event_category", "action", "event_label") if c in events.columns]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), money_sum(F.col("value")).alias("total_value"))


def page_views(events: DataFrame, action: str = "view", top: int | None = None) -> DataFrame:
    """Views and visitors by page (event_label), most seen first; ``top`` keeps so many."""
    rows = events.where(F.col("action") == action).groupBy("event_label").agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors"))
    return rows if top is None else rows.orderBy(F.desc("views"), "event_label").limit(top)


def form_rates(events: DataFrame, done: str = "signup", failed: str = "error") -> DataFrame:
    """By form (event_label): submissions, errors and the share of successes in percent (0 without any)."""
    rows = events.where(F.col("action").isin(done, failed)).groupBy("event_label").agg(F.count_if(F.col("action") == done).alias("submitted"), F.count_if(F.col("action") == failed).alias("errors"))
    return rows.withColumn("success_rate", F.col("submitted") / (F.col("submitted") + F.col("errors")) * 100)


def navigation(events: DataFrame) -> DataFrame:
    """How often one action follows another of the same user.

    Within a user's day by a window; a day's first action follows the last of the user's day before, and days are few.
    """
    rows = events.withColumn("_day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "_day").orderBy("ts", "action")
    inside = rows.select(F.lag("action").over(w).alias("from_action"), F.col("action").alias("to_action")).where("from_action is not null")
    key = F.struct("ts", "action")
    days = rows.groupBy("user_id", "_day").agg(F.min_by("action", key).alias("to_action"), F.max_by("action", key).alias("_last"))
    across = days.select(F.lag("_last").over(Window.partitionBy("user_id").orderBy("_day")).alias("from_action"), "to_action").where("from_action is not null")
    return inside.union(across).groupBy("from_action", "to_action").agg(F.count("*").alias("n"))
