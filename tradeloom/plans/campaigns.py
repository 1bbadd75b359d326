"""Queries of campaigns and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaigns as O
from ..sources.canonical import AS_OF_USERS, Journal
from .metrics import _m
from .registry import query

#: The clock of the weekly jobs: the given tables' last days have few trades, and a summary has no upper bound.
AS_OF_WEEK = "2001-06-09"
_users_now = lambda: F.lit(f"{AS_OF_USERS} 00:00:00").cast("timestamp")
_week_now = lambda: F.lit(AS_OF_WEEK).cast("date")
_P = "CASE WHEN status='closed' AND buy_price IS NOT NULL AND sell_price IS NOT NULL AND shares IS NOT NULL THEN (sell_price-buy_price)*shares ELSE 0.0::DOUBLE END"
_WEEK = f"wk AS (SELECT *, {_P} AS p FROM trades WHERE date >= DATE '{AS_OF_WEEK}' - 7)"
_SUMMARY = f"""{_WEEK}, ws AS (SELECT user_id, count(*) AS total_trades, {_m('p')} AS profit_loss, max(p) AS best_trade, min(p) AS worst_trade, count(*) FILTER (p>0) AS winning_trades_count, count(*) FILTER (p<0) AS losing_trades_count, count(DISTINCT date) AS trading_days, count(*) FILTER (p>0)/count(*)*100 AS win_rate, {_m('p')}/count(*) AS avg_trade_size, CASE WHEN count(*) FILTER (p>0)>0 AND count(*) FILTER (p<0)>0 THEN ({_m('CASE WHEN p>0 THEN p END')}/count(*) FILTER (p>0))/({_m('CASE WHEN p<0 THEN -p END')}/count(*) FILTER (p<0)) ELSE 0.0::DOUBLE END AS risk_reward_ratio FROM wk GROUP BY user_id)"""
_TOP = "tc AS (SELECT user_id, ticker, count(*) AS trades, max(date) AS last FROM wk GROUP BY user_id, ticker), top AS (SELECT user_id, ticker, trades, row_number() OVER (PARTITION BY user_id ORDER BY trades DESC, last DESC, ticker)::INTEGER AS place FROM tc QUALIFY place<=3)"


@query("agg_weekly_summary", "trades", f"WITH {_SUMMARY} SELECT * FROM ws")
def agg_weekly_summary(j: Journal):
    return O.weekly_summary(j.trades(), _week_now())


@query("lim_best_worst", "trades", f"WITH {_SUMMARY} SELECT user_id, best_trade, worst_trade FROM ws")
def lim_best_worst(j: Journal):
    return O.weekly_summary(j.trades(), _week_now()).select("user_id", "best_trade", "worst_trade")


@query("win_top_symbols", "trades", f"WITH {_WEEK}, {_TOP} SELECT * FROM top")
def win_top_symbols(j: Journal):
    return O.top_symbols(O.in_week(j.trades(), _week_now()))


@query("sel_weekly_eligible", "users", f"SELECT uid, email FROM users WHERE email IS NOT NULL AND email<>'' AND last_sign_in::DATE >= DATE '{AS_OF_USERS}' - 7")
def sel_weekly_eligible(j: Journal):
    return O.weekly_eligible(j.users(), F.lit(AS_OF_USERS).cast("date")).select("uid", "email")


@query("jn_weekly_users", "users trades", f"WITH {_SUMMARY} SELECT uid, email, total_trades, profit_loss, win_rate FROM users JOIN ws ON uid=user_id WHERE email IS NOT NULL AND email<>'' AND last_sign_in::DATE >= DATE '{AS_OF_USERS}' - 7")
def jn_weekly_users(j: Journal):
    users = O.weekly_eligible(j.users(), F.lit(AS_OF_USERS).cast("date"))
    return users.join(O.weekly_summary(j.trades(), _week_now()), F.col("uid") == F.col("user_id")).select("uid", "email", "total_trades", "profit_loss", "win_rate")


@query("agg_community", "trades", f"WITH {_SUMMARY} SELECT count(*) AS users, sum(total_trades)::DOUBLE/count(*) AS avg_trades, {_m('profit_loss')} AS total_pnl FROM ws")
def agg_community(j: Journal):
    return O.community(O.weekly_summary(j.trades(), _week_now()))


_FLAGS = f"flags AS (SELECT c_custkey AS uid, c_custkey%4=0 AS welcome_email_sent, CASE WHEN c_custkey%3=0 THEN TIMESTAMP '{AS_OF_USERS}' - to_days((c_custkey%20)::INTEGER) END AS reminder_email_sent_at, CASE WHEN c_custkey%2=0 THEN c_custkey%50 END AS total_trades FROM customer WHERE c_custkey%5<>0)"


def _flags(j: Journal):
    """Campaign flags, derived from the customers."""
    c = j.table("customer").where("c_custkey % 5 <> 0")
    sent = F.when(F.col("c_custkey") % 3 == 0, F.timestamp_seconds(F.unix_timestamp(_users_now()) - (F.col("c_custkey") % 20) * 86400))
    return c.select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 4 == 0).alias("welcome_email_sent"), sent.alias("reminder_email_sent_at"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 50).alias("total_trades"))


_INACTIVE = f"ina AS (SELECT uid, email, coalesce(total_trades,0) AS total_trades, CASE WHEN last_sign_in IS NULL THEN 'infinity'::DOUBLE ELSE floor((floor(epoch(TIMESTAMP '{AS_OF_USERS}'))-floor(epoch(last_sign_in)))/86400) END AS days_inactive, last_sign_in, reminder_email_sent_at FROM users LEFT JOIN flags USING (uid) WHERE email IS NOT NULL AND email<>'' AND (last_sign_in IS NULL OR last_sign_in < TIMESTAMP '{AS_OF_USERS}' - INTERVAL 7 DAY))"


@query("sel_inactive_users", "users", f"WITH {_FLAGS}, {_INACTIVE} SELECT uid, CASE WHEN isinf(days_inactive) THEN -1 ELSE days_inactive END::BIGINT AS days_inactive, email FROM ina WHERE reminder_email_sent_at IS NULL OR reminder_email_sent_at <= TIMESTAMP '{AS_OF_USERS}' - INTERVAL 7 DAY")
def sel_inactive_users(j: Journal):
    """days_inactive is -1 here for users who never signed in."""
    rows = O.inactive_users(_signed(j), _flags(j), _users_now())
    return rows.select("uid", F.when(F.col("days_inactive") == float("inf"), -1).otherwise(F.col("days_inactive").cast("long")).cast("long").alias("days_inactive"), "email")


def _signed(j: Journal):
    return j.users().withColumn("last_sign_in", F.col("last_sign_in").cast("timestamp"))


@query("jn_inactive_enrich", "users", f"WITH {_FLAGS}, {_INACTIVE} SELECT uid, total_trades::BIGINT AS total_trades, reminder_email_sent_at FROM ina")
def jn_inactive_enrich(j: Journal):
    return O.inactive_users(_signed(j), _flags(j), _users_now(), again_after=-(10**6)).select("uid", F.col("total_trades").cast("long").alias("total_trades"), F.col("reminder_email_sent_at").cast("timestamp_ntz").alias("reminder_email_sent_at"))


@query("jn_welcome_pending", "users", f"WITH {_FLAGS} SELECT DISTINCT uid, email FROM (SELECT uid, email FROM users WHERE uid NOT IN (SELECT uid FROM flags WHERE welcome_email_sent) UNION ALL SELECT uid, email FROM users WHERE uid%40=0)")
def jn_welcome_pending(j: Journal):
    users = j.users()
    return O.welcome_pending(users, _flags(j), users.where("uid % 40 = 0"))


@query("set_mark_sent", "users", f"WITH {_FLAGS} SELECT coalesce(f.uid, s.uid) AS uid, s.uid IS NOT NULL AS weekly_summary_sent, CASE WHEN s.uid IS NOT NULL THEN TIMESTAMP '{AS_OF_USERS}' END AS weekly_summary_sent_at, CASE WHEN s.uid IS NOT NULL THEN '{AS_OF_USERS}' WHEN f.uid%2=0 THEN '2024-01-24' END AS last_summary_week, welcome_email_sent FROM flags f FULL JOIN (SELECT uid FROM users WHERE uid%7=0) s ON f.uid=s.uid")
def set_mark_sent(j: Journal):
    """Every seventh user got the summary; the week's end is stored, and flags of other campaigns stay."""
    week = F.when(F.col("uid") % 2 == 0, "2024-01-24")
    flags = _flags(j).select("uid", F.lit(False).alias("weekly_summary_sent"), F.lit(None).cast("timestamp").alias("weekly_summary_sent_at"), week.alias("last_summary_week"), "welcome_email_sent")
    out = O.mark_sent(flags, j.users().where("uid % 7 = 0"), _users_now())
    return out.withColumns({"weekly_summary_sent": F.coalesce("weekly_summary_sent", F.lit(False)), "weekly_summary_sent_at": F.col("weekly_summary_sent_at").cast("timestamp_ntz")})


@query("set_mark_reminded", "users", f"WITH {_FLAGS}, {_INACTIVE}, s AS (SELECT uid, days_inactive FROM ina WHERE (reminder_email_sent_at IS NULL OR reminder_email_sent_at <= TIMESTAMP '{AS_OF_USERS}' - INTERVAL 7 DAY) AND NOT isinf(days_inactive)) SELECT coalesce(f.uid, s.uid) AS uid, s.uid IS NOT NULL AS reminder_email_sent, CASE WHEN s.uid IS NOT NULL THEN TIMESTAMP '{AS_OF_USERS}' ELSE reminder_email_sent_at END AS reminder_email_sent_at, s.days_inactive AS last_reminder_days_inactive, total_trades FROM flags f FULL JOIN s ON f.uid=s.uid")
def set_mark_reminded(j: Journal):
    """The users that a reminder goes to, and what is then stored of it; users who never signed in are left out here."""
    flags = _flags(j).select("uid", F.lit(False).alias("reminder_email_sent"), "reminder_email_sent_at", F.lit(None).cast("double").alias("last_reminder_days_inactive"), "total_trades")
    sent = O.inactive_users(_signed(j), _flags(j), _users_now()).where(F.col("days_inactive") < float("inf"))
    out = O.mark_reminded(flags, sent, _users_now())
    return out.withColumns({"reminder_email_sent": F.coalesce("reminder_email_sent", F.lit(False)), "reminder_email_sent_at": F.col("reminder_email_sent_at").cast("timestamp_ntz")})


@query("set_mark_welcomed", "users", f"WITH {_FLAGS}, s AS (SELECT DISTINCT uid, email FROM users WHERE uid NOT IN (SELECT uid FROM flags WHERE welcome_email_sent)) SELECT coalesce(f.uid, s.uid) AS uid, s.uid IS NOT NULL OR coalesce(welcome_email_sent, false) AS welcome_email_sent, CASE WHEN s.uid IS NOT NULL THEN TIMESTAMP '{AS_OF_USERS}' END AS welcome_email_sent_at, s.email AS email FROM flags f FULL JOIN s ON f.uid=s.uid")
def set_mark_welcomed(j: Journal):
    flags = _flags(j).select("uid", "welcome_email_sent", F.lit(None).cast("timestamp").alias("welcome_email_sent_at"), F.lit(None).cast("string").alias("email"))
    users = j.users()
    out = O.mark_welcomed(flags, O.welcome_pending(users, _flags(j), users.limit(0)), _users_now())
    return out.withColumn("welcome_email_sent_at", F.col("welcome_email_sent_at").cast("timestamp_ntz"))


@query("agg_usage_events", "usage_events", f"SELECT action, event_label, count(*) AS n, count(DISTINCT user_id) AS users, {_m('value')} AS total_value FROM usage_events GROUP BY action, event_label")
def agg_usage_events(j: Journal):
    return O.usage_counts(j.usage_events())


@query("win_navigation", "usage_events", "WITH l AS (SELECT action AS to_action, lag(action) OVER (PARTITION BY user_id ORDER BY ts, action) AS from_action FROM usage_events) SELECT from_action, to_action, count(*) AS n FROM l WHERE from_action IS NOT NULL GROUP BY ALL")
def win_navigation(j: Journal):
    return O.navigation(j.usage_events())


_CATEGORY = "CASE action WHEN 'purchase' THEN 'trading' WHEN 'view' THEN 'page' WHEN 'signup' THEN 'form' WHEN 'error' THEN 'form' ELSE 'feature' END"


@query("agg_usage_categories", "usage_events", f"SELECT {_CATEGORY} AS event_category, action, event_label, count(*) AS n, count(DISTINCT user_id) AS users, {_m('value')} AS total_value FROM usage_events GROUP BY ALL")
def agg_usage_categories(j: Journal):
    category = F.when(F.col("action") == "purchase", "trading").when(F.col("action") == "view", "page").when(F.col("action").isin("signup", "error"), "form").otherwise("feature")
    return O.usage_counts(j.usage_events().withColumn("event_category", category))


@query("agg_page_views", "usage_events", "SELECT event_label, count(*) AS views, count(DISTINCT user_id) AS visitors FROM usage_events WHERE action='view' GROUP BY event_label")
def agg_page_views(j: Journal):
    return O.page_views(j.usage_events())


@query("agg_form_rates", "usage_events", "SELECT event_label, count(*) FILTER (action='signup') AS submitted, count(*) FILTER (action='error') AS errors, submitted/(submitted+errors)*100 AS success_rate FROM usage_events WHERE action IN ('signup','error') GROUP BY event_label")
def agg_form_rates(j: Journal):
    """Sign-ups and errors stand in for a form's submissions and failures."""
    return O.form_rates(j.usage_events())
