"""Queries of filters, validation, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import filters as O
from ..sources.canonical import AS_OF, Journal
from .projections import BAL, COMPLETE, EFF, B, S
from .registry import query

START, END = "1997-03-10", "1997-09-20"
_day = lambda x: F.lit(x).cast("date")


@query("flt_date_range", "trades", f"SELECT trade_id, user_id, {EFF} AS effective_date FROM trades WHERE {EFF} BETWEEN DATE '{START}' AND DATE '{END}'")
def flt_date_range(j: Journal):
    return j.trades().where(O.in_range(K.effective_date(), _day(START), _day(END))).select("trade_id", "user_id", K.effective_date().alias("effective_date"))


_RANGED = f"m AS (SELECT *, coalesce({EFF} BETWEEN DATE '{START}' AND DATE '{END}' AND date BETWEEN DATE '{START}' AND DATE '{END}', false) AS inside FROM trades), r AS (SELECT *, bool_or(inside) OVER (PARTITION BY user_id) AS anyin FROM m), ranged AS (SELECT * FROM r WHERE inside OR (NOT anyin AND date_trunc('month', date) = DATE '1997-03-01'))"


@query("flt_metrics_range", "trades", f"WITH {_RANGED} SELECT trade_id, user_id, date FROM ranged")
def flt_metrics_range(j: Journal):
    return O.metrics_range(j.trades(), _day(START), _day(END)).select("trade_id", "user_id", "date")


@query(
    "flt_date_presets", "trades",
    f"WITH p(preset, a, b) AS (VALUES ('This Month', DATE '2001-08-01', DATE '2001-08-31'), ('Last Month', DATE '2001-07-01', DATE '2001-07-31'), ('Last 3 Months', DATE '2001-06-01', DATE '2001-08-31'), ('This Quarter', DATE '2001-07-01', DATE '2001-09-30'), ('This Year', DATE '2001-01-01', DATE '2001-12-31'), ('Last Year', DATE '2000-01-01', DATE '2000-12-31')) SELECT user_id, preset, count(*) AS trades, sum(CASE WHEN {COMPLETE} THEN 1 ELSE 0 END)::BIGINT AS complete_trades FROM trades, p WHERE {EFF} BETWEEN a AND b GROUP BY user_id, preset",
)
def flt_date_presets(j: Journal):
    return O.presets(j.trades(), _day(AS_OF)).groupBy("user_id", "preset").agg(F.count("*").alias("trades"), F.count_if(K.complete()).alias("complete_trades"))


@query("flt_status_search", "trades", "SELECT trade_id, ticker, notes FROM trades WHERE status='open' AND (contains(lower(ticker),'urgent') OR contains(lower(notes),'urgent'))")
def flt_status_search(j: Journal):
    return O.search(j.trades(), "Urgent", "open").select("trade_id", "ticker", "notes")


@query("flt_open_positions", "trades", "SELECT trade_id, user_id, ticker, shares, coalesce(buy_price,0.0::DOUBLE)*shares AS current_value FROM trades WHERE status='open' AND abs(shares)>=1e-10")
def flt_open_positions(j: Journal):
    return O.open_positions(j.trades()).select("trade_id", "user_id", "ticker", "shares", K.buy_value().alias("current_value"))


@query("flt_metric_eligible", "trades", f"SELECT trade_id, user_id FROM trades WHERE {COMPLETE}")
def flt_metric_eligible(j: Journal):
    return O.eligible(j.trades()).select("trade_id", "user_id")


def _faults(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{n}' END" for n, ok in rules) + ")"


@query("val_trade", "trades", f"SELECT trade_id, {_faults(('buy_price', f'status=$$closed$$ OR {B}'), ('sell_price', f'status<>$$closed$$ OR {S}'), ('risk', 'coalesce(risk<>0,false) OR coalesce(risk_dollars<>0,false)'))} AS faults FROM trades")
def val_trade(j: Journal):
    """Every trade with its faults; '' is a good one."""
    return j.trades().select("trade_id", F.array_join(O.trade_faults(), ",").alias("faults"))


@query("val_profile", "", f"WITH x AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey%11=0 THEN 'lots' ELSE c_acctbal::VARCHAR END AS b, CASE WHEN c_custkey%13=0 THEN '101' WHEN c_custkey%3=0 THEN '1.5' END AS t FROM customer) SELECT user_id, {_faults(('account_balance', 'try_cast(b AS DOUBLE)>0'), ('risk_tolerance', 't IS NULL OR try_cast(t AS DOUBLE) BETWEEN 0 AND 100'))} AS faults, coalesce(try_cast(t AS DOUBLE), 2.0) AS risk_tolerance, 'USD' AS currency FROM x")
def val_profile(j: Journal):
    raw = j.table("customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 11 == 0, "lots").otherwise(F.col("c_acctbal").cast("string")).alias("b"), F.when(F.col("c_custkey") % 13 == 0, "101").when(F.col("c_custkey") % 3 == 0, "1.5").alias("t"))
    return raw.select("user_id", F.array_join(O.profile_faults(F.col("b"), F.col("t")), ",").alias("faults"), F.coalesce(F.col("t").try_cast("double"), F.lit(2.0)).alias("risk_tolerance"), F.lit("USD").alias("currency"))


@query("val_fees", "fees_configs", f"SELECT user_id, {_faults(('brokerage_percentage', 'brokerage_percentage*25 BETWEEN 0 AND 10'), ('platform_fee_usd', 'platform_fee_usd-1>=0'))} AS faults FROM fees_configs")
def val_fees(j: Journal):
    zero = {n: F.lit(0.0) for n in ("withdrawal_fee_usd", "amc_yearly_usd", "account_opening_fee_usd", "tracking_charges_usd", "profile_verification_fee_usd")}
    odd = j.fees().withColumns({"brokerage_percentage": F.col("brokerage_percentage") * 25, "platform_fee_usd": F.col("platform_fee_usd") - 1, **zero})
    return odd.select("user_id", F.array_join(O.fee_faults(), ",").alias("faults"))


@query("val_month_return", "monthly_returns", f"SELECT user_id, month_start, {_faults(('month', 'user_id%6<>0'), ('start_cap', 'start_cap-200000>0'))} AS faults FROM monthly_returns")
def val_month_return(j: Journal):
    odd = j.monthly_returns().withColumns({"month": F.when(F.col("user_id") % 6 == 0, " ").otherwise(F.date_format("month_start", "MMMM yyyy")), "start_cap": F.col("start_cap") - 200000})
    return odd.select("user_id", "month_start", F.array_join(O.month_faults(), ",").alias("faults"))


@query("srt_trades", "trades", f"SELECT trade_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {EFF} DESC, trade_id)::INTEGER AS place FROM trades")
def srt_trades(j: Journal):
    """Each user's list, latest first; the place makes the order a column. Sorting stays within users."""
    from pyspark.sql import Window

    return j.trades().select("trade_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(K.effective_date().desc(), "trade_id")).alias("place"))


@query("srt_journal", "trades", "SELECT trade_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, trade_id)::INTEGER AS place FROM trades WHERE trim(coalesce(notes,''))<>''")
def srt_journal(j: Journal):
    from pyspark.sql import Window

    return j.trades().where("trim(coalesce(notes, '')) <> ''").select("trade_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date"), "trade_id")).alias("place"))


@query("srt_monthly", "monthly_returns", "SELECT user_id, strftime(month_start,'%Y-%m') AS month_key, row_number() OVER (PARTITION BY user_id ORDER BY month_start)::INTEGER AS place FROM monthly_returns")
def srt_monthly(j: Journal):
    from pyspark.sql import Window

    return j.monthly_returns().select("user_id", F.date_format("month_start", "yyyy-MM").alias("month_key"), F.row_number().over(Window.partitionBy("user_id").orderBy("month_start")).alias("place"))


@query("lim_users", "users", "SELECT uid, email FROM (SELECT * FROM users ORDER BY uid LIMIT 100) WHERE email IS NOT NULL AND email<>''")
def lim_users(j: Journal):
    """The first 100 users by id; those without an address drop out afterwards."""
    return j.users().orderBy("uid").limit(100).where("email is not null and email <> ''").select("uid", "email")


@query(
    "set_add_trades", "trades profiles",
    f"WITH {BAL}, x AS (SELECT *, CASE WHEN abs(shares)<1e-10 THEN 0.0::DOUBLE ELSE floor(shares*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE END AS s, CASE WHEN buy_price>0 THEN buy_price END AS b, CASE WHEN status='closed' THEN sell_price END AS c FROM bal) SELECT trade_id, user_id, upper(ticker) AS ticker, s AS shares, b AS buy_price, c AS sell_price, CASE WHEN balance>0 AND NOT coalesce(risk<>0,false) AND coalesce(risk_dollars<>0,false) THEN risk_dollars/balance*100 ELSE risk END AS risk, CASE WHEN balance>0 AND NOT coalesce(risk_dollars<>0,false) AND coalesce(risk<>0,false) THEN risk/100*balance ELSE risk_dollars END AS risk_dollars, status FROM x WHERE (status='closed' OR coalesce(b<>0,false)) AND (status<>'closed' OR coalesce(c<>0,false)) AND (coalesce(risk<>0,false) OR coalesce(risk_dollars<>0,false))",
)
def set_add_trades(j: Journal):
    from ..operators.ledger import intake

    return intake(j.trades(), j.profiles(), F.lit(AS_OF).cast("timestamp"))[0].select("trade_id", "user_id", "ticker", "shares", "buy_price", "sell_price", "risk", "risk_dollars", "status")
