"""Queries of per-trade derivations and user lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators.joins import parsed_rates, rate_as_of, with_balance, with_fees
from ..sources.canonical import AS_OF, Journal
from ..sources.schemas import TRADES
from ..sources.store import accepted, ingest, quarantined, shared_folder
from .registry import query

B, S = "coalesce(buy_price<>0,false)", "coalesce(sell_price<>0,false)"
GROSS = f"CASE WHEN {B} AND {S} THEN (sell_price-buy_price)*shares ELSE 0.0::DOUBLE END"
FEED = "feed AS (SELECT t.*, coalesce(brokerage_percentage,0.25::DOUBLE) bp, coalesce(brokerage_max_usd,25.0::DOUBLE) bm, coalesce(exchange_transaction_charges_percentage,0.12::DOUBLE) ex, coalesce(ifsca_turnover_fees_percentage,0.0001::DOUBLE) ifs, coalesce(platform_fee_usd,0.0::DOUBLE) pf FROM trades t LEFT JOIN fees_configs f ON t.user_id=f.user_id)"


def leg(value: str) -> str:
    return f"(least({value}*(bp/100),bm)+{value}*(ex/100)+{value}*(ifs/100)+pf)"


BUY_VALUE, SELL_VALUE = "(coalesce(buy_price,0.0::DOUBLE)*shares)", "(coalesce(sell_price,0.0::DOUBLE)*shares)"
FEES = f"({leg(BUY_VALUE)} + CASE WHEN status='closed' AND {S} THEN {leg(SELL_VALUE)} ELSE 0.0::DOUBLE END)"
COMPLETE = f"(status='closed' AND {S} AND {B})"
NET = f"CASE WHEN {COMPLETE} THEN (sell_price-buy_price)*shares - {FEES} ELSE 0.0::DOUBLE END"
EFF = "CASE WHEN status='closed' THEN coalesce(exit_date,date) ELSE date END"
FEED_WITH = f"WITH {FEED}"


@query("src_trades", "trades", "SELECT trade_id, user_id, strftime(date,'%Y-%m-%d') AS date, strftime(exit_date,'%Y-%m-%d') AS exit_date, ticker, buy_price, sell_price, shares, status FROM trades")
def src_trades(j: Journal):
    """Trades with ISO dates."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return j.trades().select("trade_id", "user_id", iso("date"), iso("exit_date"), "ticker", "buy_price", "sell_price", "shares", "status")


# Documents of all trades as JSON text; by their shares some are cut off, lack a field, hold a bad one or have more.
_DOCUMENTS = (
    "d AS (SELECT *, CASE WHEN shares=1 THEN 'not an object' WHEN shares=2 THEN 'ticker: missing' WHEN shares=3 THEN 'buy_price: not a double' WHEN shares=4 THEN 'date: not a date,status: unknown' END AS reasons FROM trades)"
)


def _documents(j: Journal):
    shares = F.col("shares")
    at = F.when(shares == 6, F.concat(F.col("date").cast("string"), F.lit("T10:30:00+00:00"))).when(shares == 4, "soon").otherwise(F.col("date").cast("string"))
    fields = F.struct(
        "trade_id", "user_id", at.alias("date"), F.col("exit_date").cast("string").alias("exit_date"), F.when(shares != 2, F.col("ticker")).alias("ticker"), F.when(shares == 3, "abc").otherwise(F.col("buy_price").cast("string")).alias("buy_price"),
        "sell_price", "shares", F.when(shares == 4, "pending").otherwise(F.col("status")).alias("status"), F.when(shares == 5, "red").alias("color"),
    )
    text = F.to_json(fields)
    folder = shared_folder(j.spark)
    j.trades().select(F.when(shares == 1, F.left(text, F.length(text) - 1)).otherwise(text).alias("value")).write.option("compression", "lz4").text(folder)
    return ingest(j.spark, folder, TRADES)


@query("src_trades_documents", "trades", f"WITH {_DOCUMENTS} SELECT trade_id, user_id, date, exit_date, ticker, buy_price, sell_price, shares, status, CASE WHEN shares=5 THEN 'red' END AS color FROM d WHERE reasons IS NULL")
def src_trades_documents(j: Journal):
    """Stored documents as trades: ISO text and numbers as text become days and numbers, unknown fields are kept."""
    return accepted(_documents(j)).select("trade_id", "user_id", "date", "exit_date", "ticker", "buy_price", "sell_price", "shares", "status", F.col("extra")["color"].alias("color"))


@query("src_trades_quarantine", "trades", f"WITH {_DOCUMENTS} SELECT CASE WHEN shares>1 THEN user_id END AS user_id, reasons, count(*) AS documents FROM d WHERE reasons IS NOT NULL GROUP BY ALL")
def src_trades_quarantine(j: Journal):
    """Documents that can't be stored, with the reasons."""
    return quarantined(_documents(j)).groupBy("user_id", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("documents"))


@query("src_users", "users", "SELECT uid, email, display_name, last_sign_in FROM users WHERE email IS NOT NULL AND email<>''")
def src_users(j: Journal):
    return j.users().where("email is not null and email <> ''")


@query("prj_gross_pnl", "trades", f"SELECT trade_id, {GROSS} AS gross_pnl FROM trades")
def prj_gross_pnl(j: Journal):
    return j.trades().select("trade_id", K.gross_pnl().alias("gross_pnl"))


@query("jn_fees", "trades fees_configs", f"{FEED_WITH} SELECT trade_id, user_id, bp AS brokerage_percentage, bm AS brokerage_max_usd, ex AS exchange_transaction_charges_percentage, ifs AS ifsca_turnover_fees_percentage, pf AS platform_fee_usd FROM feed")
def jn_fees(j: Journal):
    return with_fees(j.trades().select("trade_id", "user_id"), j.fees())


@query("prj_leg_fees", "trades fees_configs", f"{FEED_WITH} SELECT trade_id, {BUY_VALUE} AS trade_value, least({BUY_VALUE}*(bp/100),bm) AS brokerage, {BUY_VALUE}*(ex/100) AS exchange_fee, {BUY_VALUE}*(ifs/100) AS ifsca_fee, pf AS platform_fee, {leg(BUY_VALUE)} AS total_fees FROM feed")
def prj_leg_fees(j: Journal):
    parts = K.leg_parts(K.buy_value())
    return with_fees(j.trades(), j.fees()).select("trade_id", K.buy_value().alias("trade_value"), *(c.alias(n) for n, c in parts.items()), K.leg_fees(K.buy_value()).alias("total_fees"))


@query(
    "prj_trade_fees", "trades fees_configs",
    f"{FEED_WITH} SELECT trade_id, {leg(BUY_VALUE)} AS buy_fees, CASE WHEN status='closed' AND {S} THEN {leg(SELL_VALUE)} ELSE 0.0::DOUBLE END AS sell_fees, {FEES} AS total_fees, least({BUY_VALUE}*(bp/100),bm) AS buy_brokerage, CASE WHEN status='closed' AND {S} THEN least({SELL_VALUE}*(bp/100),bm) ELSE 0.0::DOUBLE END AS sell_brokerage, CASE WHEN status='closed' AND {S} THEN pf*2 ELSE pf END AS platform_fees FROM feed",
)
def prj_trade_fees(j: Journal):
    sold = K.has_sell_leg()
    return with_fees(j.trades(), j.fees()).select(
        "trade_id", K.leg_fees(K.buy_value()).alias("buy_fees"), F.when(sold, K.leg_fees(K.sell_value())).otherwise(0.0).alias("sell_fees"), K.trade_fees().alias("total_fees"),
        K.leg_parts(K.buy_value())["brokerage"].alias("buy_brokerage"), F.when(sold, K.leg_parts(K.sell_value())["brokerage"]).otherwise(0.0).alias("sell_brokerage"), F.when(sold, F.col("platform_fee_usd") * 2).otherwise(F.col("platform_fee_usd")).alias("platform_fees"),
    )


@query("prj_net_pnl", "trades fees_configs", f"{FEED_WITH} SELECT trade_id, {NET} AS net_pnl FROM feed")
def prj_net_pnl(j: Journal):
    return with_fees(j.trades(), j.fees()).select("trade_id", K.net_pnl().alias("net_pnl"))


@query(
    "prj_trade_detail", "trades",
    f"SELECT trade_id, CASE WHEN {B} THEN buy_price*shares ELSE 0.0::DOUBLE END AS dollar_value, CASE WHEN {B} AND {S} THEN (sell_price-buy_price)/buy_price*100 ELSE 0.0::DOUBLE END AS return_pct, CASE WHEN status='closed' AND risk_dollars>0 AND {GROSS}<>0 THEN abs({GROSS})/risk_dollars ELSE 0.0::DOUBLE END AS rr_ratio, date_diff('day', date, DATE '{AS_OF}')::INTEGER AS days_held FROM trades",
)
def prj_trade_detail(j: Journal):
    """Days held run to the clock, closed or not."""
    gross = K.gross_pnl()
    return j.trades().select(
        "trade_id", F.when(K.given("buy_price"), F.col("buy_price") * F.col("shares")).otherwise(0.0).alias("dollar_value"),
        F.when(K.given("buy_price") & K.given("sell_price"), (F.col("sell_price") - F.col("buy_price")) / F.col("buy_price") * 100).otherwise(0.0).alias("return_pct"),
        F.when((F.col("status") == "closed") & (F.col("risk_dollars") > 0) & (gross != 0), F.abs(gross) / F.col("risk_dollars")).otherwise(0.0).alias("rr_ratio"), F.datediff(F.lit(AS_OF).cast("date"), "date").alias("days_held"),
    )


@query("prj_risk_display", "trades", f"SELECT trade_id, CASE WHEN coalesce(risk_dollars<>0,false) THEN risk_dollars WHEN coalesce(risk<>0,false) AND {B} THEN risk/100*buy_price*shares ELSE 0.0::DOUBLE END AS risk_usd FROM trades")
def prj_risk_display(j: Journal):
    return j.trades().select("trade_id", K.risk_display().alias("risk_usd"))


BAL = "bal AS (SELECT t.*, CASE WHEN coalesce(t.account_balance<>0,false) THEN t.account_balance ELSE coalesce(p.account_balance, 10000.0::DOUBLE) END AS balance FROM trades t LEFT JOIN profiles p ON t.user_id=p.user_id)"


@query("jn_profile_balance", "trades profiles", f"WITH {BAL} SELECT trade_id, user_id, balance FROM bal")
def jn_profile_balance(j: Journal):
    return with_balance(j.trades(), j.profiles()).select("trade_id", "user_id", "balance")


@query("prj_risk_fill", "trades profiles", f"WITH {BAL} SELECT trade_id, CASE WHEN balance>0 AND NOT coalesce(risk<>0,false) AND coalesce(risk_dollars<>0,false) THEN risk_dollars/balance*100 ELSE risk END AS risk, CASE WHEN balance>0 AND NOT coalesce(risk_dollars<>0,false) AND coalesce(risk<>0,false) THEN risk/100*balance ELSE risk_dollars END AS risk_dollars FROM bal")
def prj_risk_fill(j: Journal):
    percent, dollars = K.filled_risk(F.col("balance"))
    return with_balance(j.trades(), j.profiles()).select("trade_id", percent.alias("risk"), dollars.alias("risk_dollars"))


@query("prj_pnl_status", "trades", f"SELECT trade_id, CASE WHEN NOT {COMPLETE} THEN 'open' WHEN {GROSS}>=0 THEN 'profit' ELSE 'loss' END AS pnl_status FROM trades")
def prj_pnl_status(j: Journal):
    return j.trades().select("trade_id", F.when(~K.complete(), "open").when(K.gross_pnl() >= 0, "profit").otherwise("loss").alias("pnl_status"))


@query("prj_shares_norm", "trades", "SELECT trade_id, CASE WHEN abs(shares/3)<1e-10 THEN 0.0::DOUBLE ELSE floor((shares/3)*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE END AS shares_norm FROM trades")
def prj_shares_norm(j: Journal):
    return j.trades().select("trade_id", K.normal_shares(F.col("shares") / 3).alias("shares_norm"))


@query(
    "prj_format", "trades",
    f"WITH x AS (SELECT trade_id, CASE WHEN abs(shares/3)<1e-10 THEN 0.0::DOUBLE ELSE floor((shares/3)*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE END AS s, floor({GROSS}) AS g, risk FROM trades) SELECT trade_id, regexp_replace(regexp_replace(printf('%.4f', s), '0+$', ''), '\\.$', '') AS shares_text, (CASE WHEN g<0 THEN '-$' ELSE '$' END) || format('{{:,.2f}}', abs(g)) AS pnl_text, printf('%.2f', round(risk)) || '%' AS risk_text FROM x",
)
def prj_format(j: Journal):
    return j.trades().select("trade_id", K.format_shares(F.col("shares") / 3).alias("shares_text"), K.format_currency(F.floor(K.gross_pnl()).cast("double")).alias("pnl_text"), K.format_percent(F.round("risk")).alias("risk_text"))


@query("prj_effective_date", "trades", f"SELECT trade_id, {EFF} AS effective_date FROM trades")
def prj_effective_date(j: Journal):
    return j.trades().select("trade_id", K.effective_date().alias("effective_date"))


@query("prj_position_size", "profiles", "SELECT user_id, account_balance*risk_tolerance/100 AS position_size FROM profiles")
def prj_position_size(j: Journal):
    return j.profiles().select("user_id", (F.col("account_balance") * F.col("risk_tolerance") / 100).alias("position_size"))


#: Currencies of risk, by user; rates per USDT of the events' clock.
CURRENCY = "CASE user_id%4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'INR' WHEN 2 THEN 'EUR' ELSE 'SGD' END"


@query(
    "prj_qty", "trades",
    f"WITH r(currency, rate) AS (VALUES ('INR', 83.5::DOUBLE), ('EUR', 0.92::DOUBLE), ('SGD', 1.34::DOUBLE)), x AS (SELECT trade_id, {CURRENCY} AS currency, risk_dollars, risk AS stop FROM trades), y AS (SELECT x.*, CASE WHEN x.currency='USDT' THEN risk_dollars WHEN r.rate>0 THEN risk_dollars/r.rate ELSE 0.0::DOUBLE END AS risk_usdt FROM x LEFT JOIN r ON x.currency=r.currency) SELECT trade_id, currency, risk_usdt, CASE WHEN risk_dollars>0 AND stop>0 THEN risk_usdt/stop ELSE 0.0::DOUBLE END AS qty FROM y",
)
def prj_qty(j: Journal):
    """Quantity from a risk in some currency and stop-loss points; 0 unless both are above 0."""
    rates = F.create_map(*(F.lit(x) for x in ("INR", 83.5, "EUR", 0.92, "SGD", 1.34)))
    df = j.trades().select("trade_id", F.expr(CURRENCY).alias("currency"), "risk_dollars", F.col("risk").alias("stop"))
    rate = F.try_element_at(rates, F.col("currency"))
    df = df.withColumn("risk_usdt", F.when(F.col("currency") == "USDT", F.col("risk_dollars")).when(rate > 0, F.col("risk_dollars") / rate).otherwise(0.0))
    return df.select("trade_id", "currency", "risk_usdt", F.when((F.col("risk_dollars") > 0) & (F.col("stop") > 0), F.col("risk_usdt") / F.col("stop")).otherwise(0.0).alias("qty"))


@query("prj_month_return", "monthly_returns", "SELECT user_id, month_start, CASE WHEN close_cap IS NOT NULL THEN (close_cap-start_cap)/start_cap*100 END AS percentage_return, CASE WHEN close_cap IS NOT NULL THEN close_cap-start_cap END AS dollar_return FROM monthly_returns")
def prj_month_return(j: Journal):
    return with_returns(j.monthly_returns()).select("user_id", "month_start", "percentage_return", "dollar_return")


def with_returns(months):
    """Months with both returns, computed where not given and the close is known."""
    given = lambda n: F.col(n) if n in months.columns else F.lit(None).cast("double")
    gain = F.col("close_cap") - F.col("start_cap")
    return months.withColumns({"percentage_return": F.coalesce(given("percentage_return"), gain / F.col("start_cap") * 100), "dollar_return": F.coalesce(given("dollar_return"), gain)})


@query("prj_month_key", "monthly_returns", "SELECT user_id, month_start, CASE WHEN user_id%7=0 THEN 'Month ' || user_id::VARCHAR ELSE strftime(month_start,'%Y-%m') END AS month_key FROM monthly_returns")
def prj_month_key(j: Journal):
    """`December 2024` as 2024-12; other text stays."""
    named = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("Month "), F.col("user_id").cast("string"))).otherwise(F.date_format("month_start", "MMMM yyyy"))
    return j.monthly_returns().withColumn("m", named).select("user_id", "month_start", F.coalesce(F.date_format(F.try_to_date("m", "MMMM yyyy"), "yyyy-MM"), "m").alias("month_key"))


@query("prj_sharpe_label", "monthly_returns", "WITH x AS (SELECT user_id, month_start, CASE WHEN close_cap IS NOT NULL THEN (close_cap-start_cap)/start_cap END AS r FROM monthly_returns) SELECT user_id, month_start, CASE WHEN r>=2 THEN 'Excellent' WHEN r>=1.5 THEN 'Very Good' WHEN r>=1 THEN 'Good' WHEN r>=0.5 THEN 'Fair' WHEN r>=0 THEN 'Poor' ELSE 'Very Poor' END AS label FROM x")
def prj_sharpe_label(j: Journal):
    return j.monthly_returns().select("user_id", "month_start", K.sharpe_label((F.col("close_cap") - F.col("start_cap")) / F.col("start_cap")).alias("label"))


@query("prj_display_name", "users", "SELECT uid, CASE WHEN coalesce(display_name,'')<>'' THEN display_name ELSE split_part(email,'@',1) END AS name FROM users")
def prj_display_name(j: Journal):
    return j.users().select("uid", K.display_name("display_name", "email").alias("name"))


@query("prj_exit_preview", "trades", "WITH f(label, part) AS (VALUES ('1/3', 1.0::DOUBLE/3), ('1/2', 0.5::DOUBLE), ('full', 1.0::DOUBLE)) SELECT trade_id, label, floor(shares*part*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE AS exit_shares, (buy_price*1.05::DOUBLE-buy_price)*(floor(shares*part*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE) AS estimated_pnl FROM trades, f WHERE status='open' AND abs(shares)>=1e-10")
def prj_exit_preview(j: Journal):
    """Shares and estimated profit of a third, half and full exit of each open position, at a price 5 % up."""
    parts = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(v).alias("part")) for n, v in (("1/3", 1.0 / 3), ("1/2", 0.5), ("full", 1.0))))
    rows = j.trades().where((F.col("status") == "open") & (F.abs("shares") >= 1e-10)).select("trade_id", "buy_price", "shares", F.explode(parts).alias("p"))
    exit_ = K.half_up(F.col("shares") * F.col("p.part"), 4)
    return rows.select("trade_id", "p.label", exit_.alias("exit_shares"), ((F.col("buy_price") * 1.05 - F.col("buy_price")) * exit_).alias("estimated_pnl"))


@query("prj_fee_preview", "fees_configs", "SELECT user_id, least(1000.0::DOUBLE*(brokerage_percentage/100), brokerage_max_usd) AS brokerage, 1000.0::DOUBLE*(exchange_transaction_charges_percentage/100) AS exchange_fee, 1000.0::DOUBLE*(ifsca_turnover_fees_percentage/100) AS ifsca_fee, platform_fee_usd AS platform_fee, least(1000.0::DOUBLE*(brokerage_percentage/100), brokerage_max_usd)+1000.0::DOUBLE*(exchange_transaction_charges_percentage/100)+1000.0::DOUBLE*(ifsca_turnover_fees_percentage/100)+platform_fee_usd AS total_fees FROM fees_configs")
def prj_fee_preview(j: Journal):
    value = F.lit(1000.0)
    return j.fees().select("user_id", *(c.alias(n) for n, c in K.leg_parts(value).items()), K.leg_fees(value).alias("total_fees"))


@query("prj_html_to_text", "", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^<]+?>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages")
def prj_html_to_text(j: Journal):
    return j.table("pages").select("page_id", K.html_to_text("html").alias("text"))


@query("prj_parse_number", "trades", "SELECT trade_id, CASE WHEN user_id%5=0 THEN 0.0::DOUBLE ELSE floor(shares*1000) END AS parsed FROM trades")
def prj_parse_number(j: Journal):
    """Numbers written with commas and blanks, and some that are none."""
    text = F.when(F.col("user_id") % 5 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit("  "), F.format_number(F.floor(F.col("shares") * 1000), 0), F.lit(" ")))
    return j.trades().withColumn("raw", text).select("trade_id", K.parsed_number("raw").alias("parsed"))


@query("prj_parse_month", "trades", f"SELECT trade_id, CASE WHEN user_id%5=0 THEN DATE '{AS_OF}' ELSE cast(date_trunc('month', date) AS DATE) END AS month_date FROM trades")
def prj_parse_month(j: Journal):
    text = F.when(F.col("user_id") % 5 == 0, F.lower(F.date_format("date", "MMMM yyyy"))).otherwise(F.date_format("date", "MMMM  yyyy"))
    return j.trades().withColumn("raw", text).select("trade_id", K.parsed_month("raw", F.lit(AS_OF).cast("date")).alias("month_date"))


@query(
    "jn_fx_rate", "usage_events",
    "WITH q AS (SELECT user_id, ts, action, value, CASE user_id%3 WHEN 0 THEN 'INR' WHEN 1 THEN 'EUR' ELSE 'SGD' END AS currency FROM usage_events WHERE action<>'error'), r AS (SELECT CASE user_id%3 WHEN 0 THEN 'INR' WHEN 1 THEN 'EUR' ELSE 'SGD' END AS currency, ts AS fetched_at, min(value) AS rate_per_usdt FROM usage_events WHERE action='error' GROUP BY ALL) SELECT q.user_id, q.ts, q.action, q.currency, CASE WHEN floor(epoch(q.ts))::BIGINT - floor(epoch(r.fetched_at))::BIGINT < 3600 THEN r.rate_per_usdt END AS rate FROM q ASOF LEFT JOIN r ON q.currency=r.currency AND q.ts>=r.fetched_at",
)
def jn_fx_rate(j: Journal):
    """Last rate at each event's time, if no older than an hour; error events stand in for fetched rates."""
    events = j.usage_events().withColumn("currency", F.when(F.col("user_id") % 3 == 0, "INR").when(F.col("user_id") % 3 == 1, "EUR").otherwise("SGD")).withColumn("ts", F.col("ts").cast("timestamp"))
    rates = events.where("action = 'error'").groupBy("currency", F.col("ts").alias("fetched_at")).agg(F.min("value").alias("rate_per_usdt"))
    asked = events.where("action <> 'error'").select("user_id", "ts", "action", "currency")
    return rate_as_of(asked, rates, 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "jn_fx_responses", "usage_events",
    "SELECT currency, CASE currency WHEN 'USD' THEN 1.0::DOUBLE WHEN 'INR' THEN value WHEN 'EUR' THEN 0.9::DOUBLE ELSE 1.3::DOUBLE END AS rate_per_usdt, ts AS fetched_at FROM usage_events, (VALUES ('USD'), ('INR'), ('EUR'), ('SGD')) c(currency) WHERE action='error' AND value<>0 AND user_id%5>=2",
)
def jn_fx_responses(j: Journal):
    """Rates of JSON responses; those without one of the four rates, with a rate of 0, or that are no JSON give none."""
    one = F.lit(1.0)
    tether = F.struct(one.alias("usd"), F.col("value").alias("inr"), F.lit(0.9).alias("eur"), F.when(F.col("user_id") % 5 != 0, F.lit(1.3)).alias("sgd"))
    body = F.when(F.col("user_id") % 5 == 1, "no json").otherwise(F.to_json(F.struct(tether.alias("tether"))))
    responses = j.usage_events().where("action = 'error'").select(body.alias("body"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return parsed_rates(responses).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
