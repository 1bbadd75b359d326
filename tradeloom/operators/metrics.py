"""Aggregates per user. Each is one groupBy with partial aggregation; a busy user costs no more than his rows.

There are three expectancies and two profit factors on purpose: each view of the journal has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_exit_date, complete, given, gross_pnl, money_sum, month_start, net_pnl, trade_fees, week_start


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or otherwise where b isn't above 0."""
    return F.when(b > 0, a / b).otherwise(otherwise)


def win_loss_sums(pnl: Column, where: Column | None = None) -> dict[str, Column]:
    """Counts and sums over pnl; rows outside where don't count."""
    on = F.lit(True) if where is None else where
    return {
        "n": F.count_if(on),
        "total": F.coalesce(money_sum(F.when(on, pnl)), F.lit(0.0)),
        "wins": F.count_if(on & (pnl > 0)),
        "losses": F.count_if(on & (pnl < 0)),
        "won": F.coalesce(money_sum(F.when(on & (pnl > 0), pnl)), F.lit(0.0)),
        "lost": F.coalesce(-money_sum(F.when(on & (pnl < 0), pnl)), F.lit(0.0)),
    }


def gross_metrics(sums: DataFrame) -> DataFrame:
    """From win_loss_sums() per user: expectancy by the share of losers; no losers: profit factor is the gross profit."""
    win, avg_win, avg_loss = ratio(F.col("wins"), F.col("n")) * 100, ratio(F.col("won"), F.col("wins")), ratio(F.col("lost"), F.col("losses"))
    factor = F.when(F.col("losses") == 0, F.col("won")).otherwise(ratio(F.col("won"), F.col("lost")))
    return sums.select(
        "user_id", F.col("total").alias("net_pnl"), (win / 100 * avg_win - ratio(F.col("losses"), F.col("n")) * avg_loss).alias("trade_expectancy"), factor.alias("profit_factor"),
        win.alias("win_percentage"), avg_win.alias("avg_win"), avg_loss.alias("avg_loss"), F.col("n").alias("total_trades"), F.col("wins").alias("winning_trades"), F.col("losses").alias("losing_trades"),
    )


def metrics_gross(trades: DataFrame) -> DataFrame:
    """Every user with a trade; zeros where none is complete."""
    return gross_metrics(trades.groupBy("user_id").agg(*(c.alias(n) for n, c in win_loss_sums(gross_pnl(), complete()).items())))


def metrics_net(feed: DataFrame) -> DataFrame:
    """Net of fees (columns of with_fees()): expectancy is the mean; no losers: profit factor 0."""
    sums = feed.where(complete()).withColumns({"_net": net_pnl(), "_fees": trade_fees()}).groupBy("user_id").agg(*(c.alias(n) for n, c in win_loss_sums(F.col("_net")).items()), money_sum(F.col("_fees")).alias("fees"))
    return sums.select(
        "user_id", F.col("total").alias("net_pnl"), F.col("fees").alias("total_fees"), (ratio(F.col("wins"), F.col("n")) * 100).alias("win_percentage"), ratio(F.col("won"), F.col("wins")).alias("avg_win"),
        ratio(F.col("lost"), F.col("losses")).alias("avg_loss"), ratio(F.col("won"), F.col("lost")).alias("profit_factor"), (F.col("total") / F.col("n")).alias("trade_expectancy"),
        F.col("n").alias("total_trades"), F.col("wins").alias("winning_trades"), F.col("losses").alias("losing_trades"),
    )


def win_loss(trades: DataFrame) -> DataFrame:
    df = trades.where(complete()).groupBy("user_id").agg(F.count_if(gross_pnl() > 0).alias("wins"), F.count_if(gross_pnl() < 0).alias("losses"))
    return df.withColumn("ratio", F.when(F.col("losses") > 0, F.format_string("%.2f", F.col("wins") / F.col("losses"))).otherwise("N/A"))


def trades_stats(trades: DataFrame) -> DataFrame:
    """Win rate over all closed trades; incomplete ones don't win."""
    closed = F.col("status") == "closed"
    sums = trades.groupBy("user_id").agg(F.count("*").alias("total_trades"), F.count_if(closed).alias("closed_trades"), F.count_if(~closed).alias("open_trades"), F.coalesce(money_sum(F.when(complete(), gross_pnl())), F.lit(0.0)).alias("total_pnl"), F.count_if(complete() & (gross_pnl() > 0)).alias("_wins"))
    return sums.withColumn("win_rate", ratio(F.col("_wins"), F.col("closed_trades")) * 100).drop("_wins")


def export_summary(trades: DataFrame) -> DataFrame:
    """The statistics beside an export. green_days and red_days count trades, as there."""
    closed = F.col("status") == "closed"
    parts = win_loss_sums(gross_pnl(), closed)
    sums = trades.groupBy("user_id").agg(*(c.alias(n) for n, c in parts.items()), F.count("*").alias("rows"), F.coalesce(money_sum(F.when(given("risk"), F.col("risk"))), F.lit(0.0)).alias("risks"))
    win, loss, avg_win, avg_loss = ratio(F.col("wins"), F.col("n")), ratio(F.col("losses"), F.col("n")), ratio(F.col("won"), F.col("wins")), ratio(F.col("lost"), F.col("losses"))
    return sums.select(
        "user_id", F.col("total").alias("total_pnl"), win.alias("win_rate"), loss.alias("loss_rate"), avg_win.alias("avg_win"), avg_loss.alias("avg_loss"), ratio(F.col("total"), F.col("n")).alias("avg_reward"),
        (F.col("risks") / F.col("rows")).alias("avg_risk"), ratio(avg_win, avg_loss).alias("avg_rr"), (win * avg_win - loss * avg_loss).alias("expectancy"), F.col("wins").alias("green_days"), F.col("losses").alias("red_days"),
    )


def journal_stats(trades: DataFrame) -> DataFrame:
    noted = F.length(F.trim(F.coalesce("notes", F.lit("")))) > 0
    sums = trades.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(noted).alias("with_notes"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "closed").alias("closed"))
    return sums.withColumn("notes_pct", F.col("with_notes") / F.col("total") * 100)


def period_pnl(net: bool) -> Column:
    """P&L in period statistics: a missing buy price is 0 gross, and makes the trade 0 net."""
    return net_pnl() if net else (F.coalesce("sell_price", F.lit(0.0)) - F.coalesce("buy_price", F.lit(0.0))) * F.col("shares")


def period_stats(trades: DataFrame, weekly: bool = True, net: bool = False) -> DataFrame:
    """Closed, sold trades by Sunday week or month of exit (else entry); expectancy takes all but winners as losers."""
    day = any_exit_date()
    rows = trades.where((F.col("status") == "closed") & given("sell_price")).withColumns({"period": week_start(day) if weekly else month_start(day), "_p": period_pnl(net)})
    return _period_rows(rows.groupBy("user_id", "period").agg(*(c.alias(n) for n, c in win_loss_sums(F.col("_p")).items())))


def _period_rows(sums: DataFrame, *more: str) -> DataFrame:
    rate, avg_win, avg_loss = ratio(F.col("wins"), F.col("n")) * 100, ratio(F.col("won"), F.col("wins")), ratio(F.col("lost"), F.col("losses"))
    return sums.select("user_id", "period", F.col("total").alias("pnl"), rate.alias("win_rate"), (rate / 100 * avg_win - (100 - rate) / 100 * avg_loss).alias("expectancy"), F.col("n").alias("trades"), *more)


def period_choice(trades: DataFrame, limit_days: int = 90, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Period statistics, weekly or monthly: weekly if the span is limit_days or less.

    With start and end (days): the span is theirs, the same for all users, and trades that were closed in between count.
    Else over all time, by each user's span: the entry dates of the first and last trade in order of exit. Both
    bucketings start from the same rows; the choice is a join on the user.
    """
    rows = trades.where((F.col("status") == "closed") & given("sell_price")).withColumn("_day", any_exit_date())
    if start is not None and end is not None:
        chosen = rows.where((F.col("_day") >= start) & (F.col("_day") <= end)).withColumn("span_days", F.datediff(end, start))
    else:
        key = F.struct("_day", "trade_id")
        span = rows.groupBy("user_id").agg(F.datediff(F.max_by("date", key), F.min_by("date", key)).alias("span_days"))
        chosen = rows.join(span, "user_id")
    chosen = chosen.withColumn("weekly", F.col("span_days") <= limit_days)
    chosen = chosen.withColumns({"period": F.when(F.col("weekly"), week_start(F.col("_day"))).otherwise(month_start(F.col("_day"))), "_p": period_pnl(False)})
    sums = chosen.groupBy("user_id", "period").agg(*(c.alias(n) for n, c in win_loss_sums(F.col("_p")).items()), F.max("weekly").alias("weekly"), F.max("span_days").alias("span_days"))
    return _period_rows(sums, "span_days", "weekly")


def monthly_totals(months: DataFrame) -> DataFrame:
    return months.groupBy("user_id").agg(F.coalesce(money_sum(F.col("dollar_return")), F.lit(0.0)).alias("total_dollar"), F.coalesce(money_sum(F.col("percentage_return")) / F.count("percentage_return"), F.lit(0.0)).alias("avg_percentage"))


def sharpe(curve: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Yearly Sharpe ratio of each user's equity curve (user_id, equity, previous): returns of 0 don't count."""
    change = F.when(F.col("previous") != 0, (F.col("equity") - F.col("previous")) / F.abs("previous")).otherwise(0.0)
    r = curve.withColumn("_r", change).withColumn("_r", F.when(F.col("_r") != 0, F.col("_r")))
    sums = r.groupBy("user_id").agg(F.count("_r").alias("n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("dev"))
    return sums.select("user_id", F.when((F.col("n") > 1) & (F.col("dev") > 0), F.round((F.col("mean") - risk_free) / F.col("dev") * F.sqrt(F.lit(252.0)), 4)).otherwise(0.0).alias("sharpe_ratio"))
