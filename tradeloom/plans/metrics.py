"""Queries of metrics, periods, calendars and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import calendar as CAL
from ..operators import curves as CUR
from ..operators import metrics as M
from ..operators.filters import metrics_range_totals
from ..operators.joins import with_fees
from ..operators.upkeep import calendar_days, equity_days
from ..sources.canonical import AS_OF, Journal
from ..sources.store import shared_folder
from .filters import _RANGED, END, START
from .projections import COMPLETE, EFF, FEED, FEES, GROSS, NET, S, with_returns
from .registry import query

_m = lambda x: f"coalesce(CAST(sum(CAST(floor(({x})*1e8::DOUBLE+0.5::DOUBLE) AS DECIMAL(20,0))) AS DOUBLE)/1e8::DOUBLE, 0.0::DOUBLE)"


def _sums(pnl: str, where: str = "true") -> str:
    return (
        f"count(*) FILTER ({where}) AS n, {_m(f'CASE WHEN {where} THEN {pnl} END')} AS total, count(*) FILTER ({where} AND {pnl}>0) AS wins, count(*) FILTER ({where} AND {pnl}<0) AS losses, "
        f"{_m(f'CASE WHEN {where} AND {pnl}>0 THEN {pnl} END')} AS won, -{_m(f'CASE WHEN {where} AND {pnl}<0 THEN {pnl} END')} AS lost"
    )


def _r(a: str, b: str) -> str:
    return f"CASE WHEN {b}>0 THEN {a}/{b} ELSE 0.0::DOUBLE END"


_GROSS_OUT = f"total AS net_pnl, ({_r('wins', 'n')})*100/100*({_r('won', 'wins')}) - ({_r('losses', 'n')})*({_r('lost', 'losses')}) AS trade_expectancy, CASE WHEN losses=0 THEN won ELSE {_r('won', 'lost')} END AS profit_factor, ({_r('wins', 'n')})*100 AS win_percentage, {_r('won', 'wins')} AS avg_win, {_r('lost', 'losses')} AS avg_loss, n AS total_trades, wins AS winning_trades, losses AS losing_trades"


@query("agg_metrics_gross", "trades", f"WITH a AS (SELECT user_id, {_sums(GROSS, COMPLETE)} FROM trades GROUP BY user_id) SELECT user_id, {_GROSS_OUT} FROM a")
def agg_metrics_gross(j: Journal):
    return M.metrics_gross(j.trades())


@query("agg_metrics_range", "trades", f"WITH {_RANGED}, a AS (SELECT user_id, {_sums(GROSS, COMPLETE)} FROM ranged GROUP BY user_id) SELECT user_id, {_GROSS_OUT} FROM a")
def agg_metrics_range(j: Journal):
    """Metrics over a range with the fallback to a month, in one aggregation."""
    parts = lambda name: lambda on: M.win_loss_sums(K.gross_pnl(), on & K.complete())[name]
    day = lambda x: F.lit(x).cast("date")
    return M.gross_metrics(metrics_range_totals(j.trades(), day(START), day(END), {n: parts(n) for n in ("n", "total", "wins", "losses", "won", "lost")}))


@query(
    "agg_metrics_net", "trades fees_configs",
    f"WITH {FEED}, a AS (SELECT user_id, {_sums(NET)}, {_m(FEES)} AS fees FROM feed WHERE {COMPLETE} GROUP BY user_id) SELECT user_id, total AS net_pnl, fees AS total_fees, ({_r('wins', 'n')})*100 AS win_percentage, {_r('won', 'wins')} AS avg_win, {_r('lost', 'losses')} AS avg_loss, {_r('won', 'lost')} AS profit_factor, total/n AS trade_expectancy, n AS total_trades, wins AS winning_trades, losses AS losing_trades FROM a",
)
def agg_metrics_net(j: Journal):
    return M.metrics_net(with_fees(j.trades(), j.fees()))


@query("agg_win_loss", "trades", f"SELECT user_id, count(*) FILTER ({GROSS}>0) AS wins, count(*) FILTER ({GROSS}<0) AS losses, CASE WHEN losses>0 THEN printf('%.2f', floor(wins::DOUBLE/losses*100+0.5)/100) ELSE 'N/A' END AS ratio FROM trades WHERE {COMPLETE} GROUP BY user_id")
def agg_win_loss(j: Journal):
    return M.win_loss(j.trades())


@query("agg_trades_stats", "trades", f"SELECT user_id, count(*) AS total_trades, count(*) FILTER (status='closed') AS closed_trades, count(*) FILTER (status='open') AS open_trades, {_m(f'CASE WHEN {COMPLETE} THEN {GROSS} END')} AS total_pnl, CASE WHEN closed_trades>0 THEN (count(*) FILTER ({COMPLETE} AND {GROSS}>0))/closed_trades ELSE 0.0::DOUBLE END*100 AS win_rate FROM trades GROUP BY user_id")
def agg_trades_stats(j: Journal):
    return M.trades_stats(j.trades())


EXPORT_SUMMARY = (
    f"""WITH a AS (SELECT user_id, {_sums(GROSS, "status='closed'")}, count(*) AS rows, {_m("CASE WHEN coalesce(risk<>0,false) THEN risk END")} AS risks FROM trades GROUP BY user_id) SELECT user_id, total AS total_pnl, {_r('wins', 'n')} AS win_rate, {_r('losses', 'n')} AS loss_rate, {_r('won', 'wins')} AS avg_win, {_r('lost', 'losses')} AS avg_loss, {_r('total', 'n')} AS avg_reward, risks/rows AS avg_risk, CASE WHEN losses>0 AND lost>0 THEN ({_r('won', 'wins')})/(lost/losses) ELSE 0.0::DOUBLE END AS avg_rr, ({_r('wins', 'n')})*({_r('won', 'wins')})-({_r('losses', 'n')})*({_r('lost', 'losses')}) AS expectancy, wins AS green_days, losses AS red_days FROM a"""
)


@query("agg_export_summary", "trades", EXPORT_SUMMARY)
def agg_export_summary(j: Journal):
    return M.export_summary(j.trades())


@query("agg_journal_stats", "trades", "SELECT user_id, count(*) AS total, count(*) FILTER (trim(coalesce(notes,''))<>'') AS with_notes, count(*) FILTER (status='open') AS open, count(*) FILTER (status='closed') AS closed, with_notes/total*100 AS notes_pct FROM trades GROUP BY user_id")
def agg_journal_stats(j: Journal):
    return M.journal_stats(j.trades())


_DAY = "coalesce(exit_date,date)"
_WEEK = f"cast({_DAY} - dayofweek({_DAY})::INTEGER AS DATE)"
_PP = "((coalesce(sell_price,0.0::DOUBLE)-coalesce(buy_price,0.0::DOUBLE))*shares)"
_RATE = f"({_r('wins', 'n')})*100"
_PERIOD = f"total AS pnl, {_RATE} AS win_rate, {_RATE}/100*({_r('won', 'wins')})-(100-{_RATE})/100*({_r('lost', 'losses')}) AS expectancy, n AS trades"


def _periods(bucket: str, pnl: str, source: str = "trades") -> str:
    return f"a AS (SELECT user_id, {bucket} AS period, {_sums(pnl)} FROM {source} WHERE status='closed' AND {S} GROUP BY user_id, period), periods AS (SELECT user_id, period, {_PERIOD} FROM a)"


@query("agg_period_stats", "trades", f"WITH {_periods(_WEEK, _PP)} SELECT * FROM periods")
def agg_period_stats(j: Journal):
    return M.period_stats(j.trades())


@query("agg_period_stats_net", "trades fees_configs", f"WITH {FEED}, {_periods(f'''cast(date_trunc('month', {_DAY}) AS DATE)''', NET, 'feed')} SELECT * FROM periods")
def agg_period_stats_net(j: Journal):
    return M.period_stats(with_fees(j.trades(), j.fees()), weekly=False, net=True)


@query(
    "agg_period_choice", "trades",
    f"WITH s AS (SELECT *, {_DAY} AS d FROM trades WHERE status='closed' AND {S}), sp AS (SELECT user_id, date_diff('day', (list(date ORDER BY d, trade_id))[1], (list(date ORDER BY d, trade_id))[-1])::INTEGER AS span_days FROM s GROUP BY user_id), c AS (SELECT s.*, span_days FROM s JOIN sp USING (user_id)), {_periods(f'''CASE WHEN span_days<=90 THEN {_WEEK} ELSE cast(date_trunc('month', {_DAY}) AS DATE) END''', _PP, 'c')} SELECT periods.*, span_days, span_days<=90 AS weekly FROM periods JOIN sp USING (user_id)",
)
def agg_period_choice(j: Journal):
    return M.period_choice(j.trades())


@query(
    "agg_period_choice_range", "trades",
    f"WITH c AS (SELECT * FROM trades WHERE {_DAY} BETWEEN DATE '1997-02-10' AND DATE '1997-05-10'), {_periods(_WEEK, _PP, 'c')}, d AS (SELECT * FROM trades WHERE {_DAY} BETWEEN DATE '1997-02-10' AND DATE '1997-05-12'), "
    + _periods(f"cast(date_trunc('month', {_DAY}) AS DATE)", _PP, "d").replace("a AS (", "a2 AS (").replace("periods AS (", "periods2 AS (").replace("FROM a)", "FROM a2)")
    + " SELECT *, 89 AS span_days, true AS weekly FROM periods UNION ALL SELECT *, 91, false FROM periods2",
)
def agg_period_choice_range(j: Journal):
    """Two ranges given: one of 89 days, by weeks, and one of 91, by months."""
    day = lambda d: F.lit(d).cast("date")
    return M.period_choice(j.trades(), start=day("1997-02-10"), end=day("1997-05-10")).union(M.period_choice(j.trades(), start=day("1997-02-10"), end=day("1997-05-12")))


_CAL = f"cal AS (SELECT trade_id, user_id, {EFF} AS day, CASE WHEN {COMPLETE} THEN {GROSS} ELSE 0.0::DOUBLE END AS p FROM trades), daily AS (SELECT user_id, day, {_m('p')} AS pnl, count(*) AS trade_count FROM cal GROUP BY user_id, day)"


@query("agg_calendar_daily", "trades", f"WITH {_CAL} SELECT * FROM daily")
def agg_calendar_daily(j: Journal):
    return CAL.daily(j.trades())


@query("agg_calendar_monthly", "trades", f"WITH {_CAL} SELECT user_id, cast(date_trunc('month', day) AS DATE) AS month, {_m('p')} AS pnl, count(*) AS trade_count FROM cal GROUP BY user_id, month")
def agg_calendar_monthly(j: Journal):
    return CAL.monthly(j.trades())


@query(
    "agg_calendar_totals", "trades",
    f"WITH {_CAL}, mm AS (SELECT user_id, year(day)::INTEGER AS year, cast(date_trunc('month', day) AS DATE) AS month, {_m('pnl')} AS pnl, sum(trade_count)::BIGINT AS trades, count(*) AS active FROM daily GROUP BY ALL) SELECT * FROM mm UNION ALL SELECT user_id, year, NULL, {_m('pnl')}, sum(trades)::BIGINT, count(*) FROM mm GROUP BY user_id, year",
)
def agg_calendar_totals(j: Journal):
    return CAL.totals(j.trades())


@query(
    "agg_calendar_grid", "trades",
    f"WITH {_CAL}, g AS (SELECT user_id, cast(DATE '1997-04-27' + i::INTEGER AS DATE) AS day FROM (SELECT DISTINCT user_id FROM trades), range(42) r(i)) SELECT user_id, day, coalesce(pnl, 0.0::DOUBLE) AS pnl, coalesce(trade_count, 0)::BIGINT AS trade_count, month(day)=5 AS in_month FROM g LEFT JOIN daily USING (user_id, day)",
)
def agg_calendar_grid(j: Journal):
    return CAL.grid(j.trades(), F.lit("1997-05-15").cast("date"))


@query("agg_monthly_totals", "monthly_returns", f"WITH r AS (SELECT user_id, CASE WHEN close_cap IS NOT NULL THEN close_cap-start_cap END AS d, CASE WHEN close_cap IS NOT NULL THEN (close_cap-start_cap)/start_cap*100 END AS p FROM monthly_returns) SELECT user_id, {_m('d')} AS total_dollar, CASE WHEN count(p)>0 THEN {_m('p')}/count(p) ELSE 0.0::DOUBLE END AS avg_percentage FROM r GROUP BY user_id")
def agg_monthly_totals(j: Journal):
    return M.monthly_totals(with_returns(j.monthly_returns()))


_CURVE = f"curve AS (SELECT user_id, trade_id, date, pnl, CAST(sum(CAST(floor(pnl*1e8::DOUBLE+0.5::DOUBLE) AS DECIMAL(20,0))) OVER w AS DOUBLE)/1e8::DOUBLE AS equity FROM (SELECT *, {GROSS} AS pnl FROM trades WHERE {COMPLETE}) WINDOW w AS (PARTITION BY user_id ORDER BY date, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), lagged AS (SELECT *, lag(equity) OVER (PARTITION BY user_id ORDER BY date, trade_id) AS previous FROM curve)"


@query("win_equity_curve", "trades", f"WITH {_CURVE} SELECT user_id, trade_id, date, pnl, equity FROM curve")
def win_equity_curve(j: Journal):
    return CUR.equity_curve(j.trades()).drop("previous")


@query("win_sharpe_returns", "trades", f"WITH {_CURVE} SELECT user_id, trade_id, CASE WHEN previous<>0 THEN (equity-previous)/abs(previous) ELSE 0.0::DOUBLE END AS r FROM lagged")
def win_sharpe_returns(j: Journal):
    return CUR.equity_curve(j.trades()).select("user_id", "trade_id", F.when(F.col("previous") != 0, (F.col("equity") - F.col("previous")) / F.abs("previous")).otherwise(0.0).alias("r"))


@query("agg_sharpe", "trades", f"WITH {_CURVE}, x AS (SELECT user_id, CASE WHEN previous<>0 AND equity<>previous THEN (equity-previous)/abs(previous) END AS r FROM lagged) SELECT user_id, CASE WHEN count(r)>1 AND stddev_samp(r)>0 THEN round(avg(r)/stddev_samp(r)*sqrt(252.0::DOUBLE), 4) ELSE 0.0::DOUBLE END AS sharpe_ratio FROM x GROUP BY user_id")
def agg_sharpe(j: Journal):
    return M.sharpe(CUR.equity_curve(j.trades()))


@query("win_running_balance", "trades", f"WITH {_periods(_WEEK, _PP)} SELECT *, CAST(sum(CAST(floor(pnl*1e8::DOUBLE+0.5::DOUBLE) AS DECIMAL(20,0))) OVER (PARTITION BY user_id ORDER BY period) AS DOUBLE)/1e8::DOUBLE AS running_balance FROM periods")
def win_running_balance(j: Journal):
    return CUR.running_balance(M.period_stats(j.trades()))


@query("win_period_change", "trades", f"WITH {_periods(_WEEK, _PP)}, l AS (SELECT *, lag(pnl) OVER (PARTITION BY user_id ORDER BY period) AS previous_pnl, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS k FROM periods) SELECT user_id, period, pnl, previous_pnl, pnl-previous_pnl AS change FROM l WHERE k=1")
def win_period_change(j: Journal):
    return CUR.period_change(M.period_stats(j.trades()))


@query(
    "win_account_curve", "trades monthly_returns",
    f"WITH t AS (SELECT user_id, {_m(GROSS)} AS now FROM trades WHERE {COMPLETE} AND date_trunc('month', {_DAY})=DATE '2001-08-01' GROUP BY user_id), l AS (SELECT m.*, lag(start_cap) OVER (PARTITION BY m.user_id ORDER BY month_start) AS last, coalesce(now, 0.0::DOUBLE) AS now FROM monthly_returns m LEFT JOIN t ON m.user_id=t.user_id) SELECT user_id, month_start AS date, start_cap AS equity, coalesce(start_cap-last, 0.0::DOUBLE) AS pnl, 'month_start' AS type FROM l UNION ALL SELECT user_id, last_day(month_start), close_cap, close_cap-start_cap, 'month_end' FROM l WHERE coalesce(close_cap<>0,false) UNION ALL SELECT user_id, DATE '{AS_OF}', start_cap+now, now, 'current' FROM l WHERE month_start=DATE '2001-08-01'",
)
def win_account_curve(j: Journal):
    return CUR.account_curve(j.monthly_returns(), j.trades(), F.lit(AS_OF).cast("date"))


_CHANGED = (
    "c AS (SELECT trade_id, user_id, date, exit_date, buy_price, CASE WHEN shares=10 THEN buy_price+1 ELSE sell_price END AS sell_price, shares, CASE WHEN shares=10 THEN 'closed' ELSE status END AS status FROM trades WHERE shares<>9 AND user_id%4=0 "
    "UNION ALL SELECT trade_id, user_id, date, exit_date, buy_price, sell_price, shares, status FROM trades WHERE user_id%4<>0 UNION ALL SELECT 'new-' || trade_id, user_id, date, exit_date, buy_price, sell_price, shares, status FROM trades WHERE shares=11 AND user_id%4=0)"
)
_DAYS = lambda day, where: f"WITH {_CHANGED}, d AS (SELECT user_id, {day} AS day, sum(floor(CASE WHEN {COMPLETE} THEN (sell_price-buy_price)*shares ELSE 0.0::DOUBLE END*100000000.0::DOUBLE+0.5::DOUBLE)::DECIMAL(38,0)) AS u, count(*) AS trades FROM c WHERE {where} GROUP BY ALL) SELECT user_id, day, u::DOUBLE/100000000.0::DOUBLE AS pnl, trades, (sum(u) OVER (PARTITION BY user_id ORDER BY day))::DOUBLE/100000000.0::DOUBLE AS running FROM d"


def _kept_days(j: Journal, make):
    """Daily sums of all trades; then a quarter of the users delete trades, edit some and add some."""
    days = make(j.spark, shared_folder(j.spark))
    t = j.trades().select("trade_id", "user_id", "date", "exit_date", "buy_price", "sell_price", "shares", "status")
    days.create(t)
    some = t.where("user_id % 4 = 0")
    edited = some.where("shares = 10").withColumns({"sell_price": F.col("buy_price") + 1, "status": F.lit("closed")})
    days.change(some.where("shares in (9, 10)"), edited.unionByName(some.where("shares = 11")))
    return days.read()


@query("win_equity_days", "trades", _DAYS("date", COMPLETE))
def win_equity_days(j: Journal):
    """The equity curve by day, kept up to date by changes."""
    return _kept_days(j, equity_days)


@query("agg_calendar_kept", "trades", _DAYS(EFF, "true"))
def agg_calendar_kept(j: Journal):
    """The calendar's days with a running total, kept up to date by changes."""
    return _kept_days(j, calendar_days)
