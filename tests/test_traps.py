"""Small frames with results worked out by hand, one for each rule that is easy to get wrong."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tradeloom.functions import columns as K
from tradeloom.operators import calendar, campaigns, curves, filters, joins, ledger, metrics
from tradeloom.sources import schemas, store, tracker

D = date


def trades(spark, *rows):
    base = dict.fromkeys(schemas.TRADES.names)
    filled = [base | {"trade_id": f"t{i}", "user_id": 1, "status": "closed", "ticker": "AAPL", "shares": 1.0, "date": D(2024, 1, 15)} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([Row(**r) for r in filled], schemas.TRADES).select(schemas.TRADES.names)


def one(df):
    return df.collect()[0]


def value(spark, df, column):
    return one(df.select(column.alias("v"))).v


def test_gross_pnl_and_missing_prices(spark):
    t = trades(spark, {"buy_price": 150.0, "sell_price": 165.0, "shares": 100.0}, {"buy_price": 0.0, "sell_price": 5.0}, {"sell_price": 5.0}, {"buy_price": 5.0, "sell_price": 0.0})
    assert [r.v for r in t.orderBy("trade_id").select(K.gross_pnl().alias("v")).collect()] == [1500.0, 0.0, 0.0, 0.0]


def test_fees_cap_each_leg(spark):
    t = trades(spark, {"buy_price": 200.0, "sell_price": 200.0, "shares": 100.0}, {"buy_price": 200.0, "shares": 100.0, "status": "open"}, {"buy_price": 10.0, "shares": 100.0, "status": "open"})
    fed = joins.with_fees(t, spark.createDataFrame([], schemas.FEES)).orderBy("trade_id")
    both, buy, small = (r.v for r in fed.select(K.trade_fees().alias("v")).collect())
    assert math.isclose(buy, 25 + 24 + 0.02) and math.isclose(both, 2 * buy) and math.isclose(small, 3.701)
    assert [round(r.v, 6) for r in fed.select(K.net_pnl().alias("v")).collect()] == [round(-both, 6), 0.0, 0.0]


def test_effective_date_and_any_exit_date(spark):
    t = trades(spark, {"exit_date": D(2024, 2, 1)}, {"exit_date": D(2024, 2, 1), "status": "open"}, {})
    got = t.orderBy("trade_id").select(K.effective_date().alias("a"), K.any_exit_date().alias("b")).collect()
    assert [(r.a.month, r.b.month) for r in got] == [(2, 2), (1, 2), (1, 1)]


def test_three_expectancies_and_two_profit_factors(spark):
    won = {"buy_price": 10.0, "sell_price": 12.0}
    even = {"buy_price": 10.0, "sell_price": 10.0}
    t = trades(spark, won, even)
    fed = joins.with_fees(t, spark.createDataFrame([(1, *[0.0] * 10, None, None)], schemas.FEES))
    gross, net, period = one(metrics.metrics_gross(t)), one(metrics.metrics_net(fed)), one(metrics.period_stats(t))
    assert (gross.trade_expectancy, gross.profit_factor, gross.total_trades, gross.losing_trades) == (1.0, 2.0, 2, 0)
    assert (net.trade_expectancy, net.profit_factor) == (1.0, 0.0)
    lost = trades(spark, won, even, {"buy_price": 10.0, "sell_price": 9.0})
    assert math.isclose(one(metrics.metrics_gross(lost)).trade_expectancy, 2 / 3 - 1 / 3)
    assert abs(one(metrics.period_stats(lost)).expectancy - (2 / 3 - 2 / 3)) < 1e-9  # an even trade counts as lost here
    assert period.period == D(2024, 1, 14)  # the Sunday


def test_users_without_complete_trades_get_zeros(spark):
    r = one(metrics.metrics_gross(trades(spark, {"status": "open", "buy_price": 5.0})))
    assert r.asDict() | {"user_id": 0} == dict.fromkeys(r.asDict(), 0)


def test_win_rates_have_three_denominators(spark):
    t = trades(spark, {"buy_price": 1.0, "sell_price": 2.0}, {"sell_price": 2.0}, {"status": "open", "buy_price": 1.0}, {"buy_price": 0.0, "sell_price": 3.0})
    assert one(metrics.metrics_gross(t)).win_percentage == 100.0
    assert math.isclose(one(metrics.trades_stats(t)).win_rate, 100 / 3)
    week = one(campaigns.weekly_summary(t, F.lit("2024-01-16").cast("date")))
    assert (week.win_rate, week.best_trade, week.winning_trades_count) == (50.0, 3.0, 2)  # a price of 0 isn't missing here
    assert week.avg_trade_size == 1.0 and week.risk_reward_ratio == 0.0


def test_metrics_range_falls_back_to_the_month(spark):
    t = trades(spark, {"date": D(2024, 3, 1), "buy_price": 1.0, "sell_price": 2.0}, {"user_id": 2, "date": D(2024, 3, 15), "exit_date": D(2024, 5, 1)}, {"user_id": 3, "date": D(2024, 4, 10)})
    got = filters.metrics_range(t, F.lit("2024-03-10").cast("date"), F.lit("2024-03-20").cast("date"))
    assert {r.trade_id for r in got.collect()} == {"t0", "t1"}  # neither is inside; user 3 has nothing in March


@pytest.mark.parametrize("x,want", [(1e-12, 0.0), (0.123456, 0.1235), (-0.00005, 0.0), (2.00005, 2.0001)])
def test_share_rounding(spark, x, want):
    assert value(spark, spark.range(1), K.normal_shares(F.lit(x))) == want


def test_parsers(spark):
    as_of = F.lit("2025-09-01").cast("date")
    months = {"August 2025": D(2025, 8, 1), "august 2025": D(2025, 9, 1), "Foo 2025": D(2025, 9, 1), "March  2024": D(2024, 3, 1), "": D(2025, 9, 1)}
    for text, want in months.items():
        assert value(spark, spark.range(1), K.parsed_month(F.lit(text), as_of)) == want
    for text, want in {" 1,234.5 ": 1234.5, "": 0.0, "x": 0.0}.items():
        assert value(spark, spark.range(1), K.parsed_number(F.lit(text))) == want


def test_formats(spark):
    r = one(spark.range(1).select(K.format_shares(F.lit(2.5)).alias("a"), K.format_shares(F.lit(100.0)).alias("b"), K.format_currency(F.lit(-1234.5)).alias("c"), K.format_percent(F.lit(5.0)).alias("d"), K.html_to_text(F.lit("<p>a  <b>b</b>\n c</p>")).alias("e")))
    assert tuple(r) == ("2.5", "100", "-$1,234.50", "5.00%", "a b c")


TRACKER = """Pnl August_2025,1500.000000,,,,,,,,,,,,,,,,,,
Month,Ticker,Buy price,Sell price,shares,$ value,Risk,...
August 2025,aapl,150,165,100,15000,200,,,,,,,1500,7.5,Closed,,,,
August 2025,aapl,150,165,100,15000,200,,,,,,,1500,7.5,Closed,,,,
August 2025,TSLA,210.5,,10,2105,,,,,,,,0.00,0.00,Open,,,,
Foo 2025,MSFT,100,90,5,500,50,,,,,,,,,Closed,,,,
August 2025,NVDA,0,90,5,,,,,,,,,,,,,,,
a,b,1,2,3"""


def test_tracker_import(spark, tmp_path):
    from tradeloom.sources.tracker import read_lines

    (tmp_path / "t.csv").write_text(TRACKER)
    rows = ledger.parse_tracker(read_lines(spark, str(tmp_path / "t.csv"), 7), F.lit("2025-09-09").cast("date"))
    marked = ledger.mark_import(rows, trades(spark))
    assert tuple(one(ledger.import_report(marked)))[1:] == (3, 1)
    by = {r.ticker: r for r in marked.where("accepted").collect()}
    assert by["AAPL"].pnl == 1500.0 and by["TSLA"].risk_dollars is None and by["TSLA"].status == "open"
    assert by["MSFT"].date == D(2025, 9, 9) and by["MSFT"].pnl == -50.0
    stored = ledger.append(trades(spark), marked)
    again = ledger.import_report(ledger.mark_import(rows, stored))
    assert tuple(one(again))[1:] == (0, 4)


def exits(spark, *rows):
    return spark.createDataFrame([(f"r{i}", 1, "AAPL", s, 20.0, n, datetime(2024, 2, 1, 0, i)) for i, (s, n) in enumerate(rows)], schemas.EXIT_REQUESTS)


def test_exits_are_folded_in_order(spark):
    t = trades(spark, {"status": "open", "buy_price": 10.0, "shares": 9.0, "notes": "n", "risk": 2.0}, {"status": "open", "buy_price": 11.0, "shares": 4.0})
    after, told = ledger.apply_exits(t, exits(spark, (3.0, "a"), (7.0, None), (6.0, "b"), (4.0, None), (1.0, None)), F.lit("2024-02-01").cast("date"))
    assert [r.outcome for r in told.orderBy("request_id").collect()] == ["partial", "too many shares", "full", "full", "no open trade"]
    rows = {r.trade_id: r for r in after.collect()}
    assert rows["t0"].status == "closed" and rows["t0"].shares == 6.0 and rows["t0"].notes == "n | Exit: b"
    assert rows["t0/r0"].shares == 3.0 and rows["t0/r0"].notes == "n | Partial exit: a" and rows["t0/r0"].risk == 2.0
    assert rows["t1"].status == "closed" and rows["t1"].notes is None
    assert sum(r.shares for r in rows.values()) == 13.0
    stamped = t.withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "updated_at": F.lit("2021-01-01").cast("timestamp")})
    after = ledger.apply_exits(stamped, exits(spark, (3.0, "a"), (1.0, "c")), F.lit("2024-02-01").cast("date"), F.lit("2024-02-01").cast("timestamp"))[0]
    got = {r.trade_id: (r.shares, r.created_at.year, r.updated_at.year) for r in after.collect()}
    assert got == {"t0": (5.0, 2020, 2024), "t0/r0": (3.0, 2020, 2024), "t0/r1": (1.0, 2020, 2024), "t1": (4.0, 2020, 2021)}


def test_owner_delete_and_patch(spark):
    t = trades(spark, {"buy_price": 1.0, "sell_price": 2.0, "risk": 1.0}, {"user_id": 2})
    left, told = ledger.owner_delete(t, spark.createDataFrame([("t0", 2), ("t1", 2), ("t9", 2)], "trade_id string, user_id long"))
    assert {r.trade_id for r in left.collect()} == {"t0"}
    assert {r.trade_id: r.outcome for r in told.collect()} == {"t0": "forbidden", "t1": "deleted", "t9": "missing"}
    updates = spark.createDataFrame([("t0", 1, "msft", None), ("t1", 1, "x", None)], "trade_id string, seq int, ticker string, sell_price double")
    got = {r.trade_id: r for r in ledger.patch(t, updates, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (got["t0"].ticker, got["t0"].sell_price, got["t0"].risk_dollars, got["t0"].faults) == ("MSFT", 2.0, None, "")  # no profile fills a risk here
    assert (got["t1"].ticker, got["t1"].faults) == ("AAPL", "sell_price,risk")
    asked = spark.createDataFrame([("t0", 1, 2, 5000.0)], "trade_id string, seq int, asker long, account_balance double")
    stamped = t.withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    refused = {r.trade_id: r for r in ledger.patch(stamped, asked, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert refused["t0"].faults == "owner" and {r.updated_at.year for r in refused.values()} == {2020}
    own = {r.trade_id: r for r in ledger.patch(stamped, asked.withColumn("asker", F.lit(1)), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (own["t0"].faults, own["t0"].risk_dollars, own["t0"].updated_at.year, own["t1"].updated_at.year) == ("", 50.0, 2024, 2020)
    edits = t.select("trade_id", F.lit("AAPL").alias("ticker"), F.lit(9.0).alias("buy_price"))
    assert [(r.ticker, r.buy_price) for r in ledger.changed_fields(edits, t).orderBy("trade_id").collect()] == [(None, 9.0), (None, 9.0)]


def test_curves_and_calendar_agree(spark):
    t = trades(spark, {"buy_price": 1.0, "sell_price": 3.0}, {"buy_price": 2.0, "sell_price": 1.0}, {"date": D(2024, 1, 10), "buy_price": 5.0, "sell_price": 6.0, "exit_date": D(2024, 2, 2)}, {"status": "open"})
    curve = curves.equity_curve(t).orderBy("date", "trade_id").collect()
    assert [r.equity for r in curve] == [1.0, 3.0, 2.0] and curve[-1].equity == one(metrics.metrics_gross(t)).net_pnl
    assert sum(r.pnl for r in calendar.daily(t).collect()) == sum(r.pnl for r in calendar.monthly(t).collect()) == 2.0
    year = [r for r in calendar.totals(t).collect() if r.month is None]
    assert [(r.year, r.pnl, r.trades, r.active) for r in year] == [(2024, 2.0, 4, 2)]
    assert calendar.grid(t, F.lit("2024-01-20").cast("date")).count() == 42
    assert one(metrics.sharpe(curves.equity_curve(t).limit(1))).sharpe_ratio == 0.0


def test_rates_expire(spark):
    at = lambda m: datetime(2024, 1, 1, 10, m)
    rates = spark.createDataFrame([("EUR", 0.9, at(0)), ("EUR", 0.8, at(3))], "currency string, rate_per_usdt double, fetched_at timestamp")
    asked = spark.createDataFrame([(1, "EUR", at(2)), (2, "EUR", at(3)), (3, "EUR", at(7)), (4, "EUR", at(8)), (5, "INR", at(3))], "id int, currency string, ts timestamp")
    assert {r.id: r.rate for r in joins.rate_as_of(asked, rates).collect()} == {1: 0.9, 2: 0.8, 3: 0.8, 4: None, 5: None}


def test_validation_reasons(spark):
    t = trades(spark, {"status": "open"}, {"sell_price": 0.0, "risk": 1.0})
    assert [list(r.v) for r in t.orderBy("trade_id").select(filters.trade_faults().alias("v")).collect()] == [["buy_price", "risk"], ["sell_price"]]


def test_empty_tables(spark):
    t = trades(spark)
    for df in (metrics.metrics_gross(t), metrics.period_choice(t), curves.equity_curve(t), calendar.totals(t), campaigns.weekly_summary(t, F.current_date()), ledger.apply_exits(t, exits(spark), F.current_date())[0]):
        assert df.count() == 0


def test_curve_keeps_trades_without_entry_date(spark):
    t = trades(spark, {"buy_price": 1.0, "sell_price": 3.0}, {"date": None, "buy_price": 2.0, "sell_price": 1.0}, {"date": D(2024, 1, 10), "buy_price": 5.0, "sell_price": 6.0})
    assert [(r.date, r.equity, r.previous) for r in curves.equity_curve(t).orderBy("date").collect()] == [(None, -1.0, None), (D(2024, 1, 10), 0.0, -1.0), (t.first().date, 2.0, 0.0)]


def test_rate_responses_need_all_four_rates(spark):
    bodies = ['{"tether": {"usd": 1.0, "inr": 83.5, "eur": 0.9, "sgd": 1.3}}', '{"tether": {"usd": 1.0, "inr": 83.5, "eur": 0.9}}', '{"tether": {"usd": 0, "inr": 83.5, "eur": 0.9, "sgd": 1.3}}', "no json", None]
    rows = spark.createDataFrame([(b, datetime(2024, 1, 1, 10, i)) for i, b in enumerate(bodies)], "body string, fetched_at timestamp")
    assert {(r.currency, r.rate_per_usdt, r.fetched_at.minute) for r in joins.parsed_rates(rows).collect()} == {("USD", 1.0, 0), ("INR", 83.5, 0), ("EUR", 0.9, 0), ("SGD", 1.3, 0)}


def test_stored_documents_and_lossy_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"trade_id": "a", "user_id": 1, "date": "2024-01-15T00:00:00", "exit_date": "2024-02-01", "shares": 2, "created_at": "2024-01-15T10:00:00Z", "status": "open"}\n{"trade_id": "b", "date": "soon"}\n')
    got = {r.trade_id: r for r in store.read_documents(spark, str(tmp_path / "a.json"), schemas.TRADES).collect()}
    assert (got["a"].date, got["a"].exit_date, got["a"].created_at.hour, got["a"].notes) == (D(2024, 1, 15), D(2024, 2, 1), 10, None)
    assert (got["b"].date, got["b"].created_at) == (None, None)
    t = trades(spark, {"date": D(2024, 1, 15), "buy_price": 10.0, "sell_price": 12.0, "shares": 3.0, "status": "closed", "exit_date": D(2024, 1, 20), "risk": 2.0, "notes": "n"})
    tracker.write_export(tracker.export_lines(t), str(tmp_path / "out"))
    lines = tracker.read_export(spark, str(tmp_path / "out"))
    back = one(ledger.parse_tracker(lines, F.lit("2025-01-01").cast("date")))
    assert (back.date, back.buy_price, back.sell_price, back.shares, back.pnl, back.status) == (D(2024, 1, 1), 10.0, 12.0, 3.0, 6.0, "closed")  # the day and the exit's day are lost
    assert back.notes == "Imported from CSV - January 2024" and back.risk_dollars == 2.0  # a percentage comes back as dollars
