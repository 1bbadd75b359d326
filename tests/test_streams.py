"""Streams over several files: late and out-of-order rows, bounded state, restarts."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeloom import plans
from tradeloom.operators import calendar, filters, joins
from tradeloom.sources import schemas
from tradeloom.sources.versions import MonthTable
from tradeloom.streaming import twins
from tradeloom.streaming.exits import ROCKSDB, exit_apply
from tradeloom.streaming.imports import import_lines, new_rows, stored_trades
from tradeloom.streaming.rates import RateProcessor, running_rates
from tradeloom.streaming.windows import Lateness, keep_windows

DELAY = timedelta(days=30)


def trades(spark, *rows):
    """(trade_id, user_id, date, profit) as closed trades without an exit date."""
    base = dict.fromkeys(schemas.TRADES.names)
    return spark.createDataFrame([tuple((base | {"trade_id": t, "user_id": u, "date": d, "ticker": "A", "buy_price": 100.0, "sell_price": 100.0 + p, "shares": 1.0, "status": "closed"}).values()) for t, u, d, p in rows], schemas.TRADES)


class Files:
    """A folder that gets one file at a time, and a stream that reads one file a batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        self.schema = None

    def add(self, df):
        self.schema = df.schema
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in/part={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/part=*")


@pytest.fixture
def files(spark, tmp_path):
    return Files(spark, tmp_path)


def daily(spark, files, table):
    query = keep_windows(twins.calendar_rows(files.stream()), twins.daily_sums, "ts", F.date_add(F.col("ts").cast("date"), 1).cast("timestamp"), DELAY, table, f"{files.path}/late", f"{files.path}/state")
    query.awaitTermination()
    return query


def calendar_table(spark, files):
    return MonthTable(spark, f"{files.path}/table", ["user_id", "day"], F.col("day"))


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def late_rows(spark, files, table):
    if not table.state()["marks"]["late"]:
        return None
    return spark.read.parquet(f"{files.path}/late")


def test_late_rows_inside_the_bound_change_a_stored_window(spark, files):
    table = calendar_table(spark, files)
    files.add(trades(spark, ("a", 1, date(2024, 1, 1), 5.0), ("b", 1, date(2024, 2, 1), 7.0)))
    files.add(trades(spark, ("c", 1, date(2024, 1, 10), 1.0), ("d", 1, date(2024, 1, 10), 2.0)))
    files.add(trades(spark, ("e", 1, date(2024, 1, 10), 4.0), ("f", 2, date(2024, 6, 1), 1.0)))
    files.add(trades(spark, ("g", 1, date(2024, 5, 20), 3.0)))
    files.add(trades(spark, ("h", 1, date(2024, 1, 10), 100.0), ("i", 1, date(2024, 6, 2), 1.0)))
    query = daily(spark, files, table)
    days = {(r.user_id, r.day): (r.pnl, r.trade_count) for r in table.read().collect()}
    assert days[1, date(2024, 1, 10)] == (7.0, 3) and days[1, date(2024, 5, 20)] == (3.0, 1)
    assert table.state()["marks"]["late"] == 1 and [r.trade_id for r in late_rows(spark, files, table).collect()] == ["h"]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert any(b < a for a, b in zip(sizes[:-1], sizes[1:], strict=True)) and sizes[-1] == 3 < len(days)  # only windows above the watermark are held
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_files_equals_the_batch_job_over_what_was_not_late(spark, files, seed):
    rng, table = random.Random(seed), calendar_table(spark, files)
    start = date(2024, 1, 1)
    rows = [(f"t{i}", rng.randint(1, 3), start + timedelta(days=max(0, i + rng.randint(-70, 20))), float(rng.randint(-9, 9))) for i in range(120)]
    for at in range(0, 60, 20):
        files.add(trades(spark, *rows[at : at + 20]))
    daily(spark, files, table)
    for at in range(60, 120, 20):  # a restart from the checkpoint
        files.add(trades(spark, *rows[at : at + 20]))
    query = daily(spark, files, table)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    newest = max(r[2] for r in rows)
    assert held == len({(u, d) for _, u, d, _ in rows if d + timedelta(days=1) > newest - DELAY})
    late = late_rows(spark, files, table)
    gone = set() if late is None else {r.trade_id for r in late.collect()}
    assert 0 < len(gone) == table.state()["marks"]["late"] < 60
    assert content(table.read()) == content(calendar.daily(trades(spark, *(r for r in rows if r[0] not in gone))).select("user_id", "day", "pnl", "trade_count"))


def test_complete_mode_gives_the_same_where_nothing_is_late(spark, files):
    table = calendar_table(spark, files)
    files.add(trades(spark, *((f"t{i}", i % 3, date(2024, 1, 1) + timedelta(days=i % 25), 1.5 * i) for i in range(40))))
    files.add(trades(spark, *((f"u{i}", i % 3, date(2024, 1, 1) + timedelta(days=i % 25), 0.25 * i) for i in range(40))))
    daily(spark, files, table)
    assert content(table.read()) == content(twins.run_available(twins.daily_calendar(files.stream()), "complete"))


def test_weekly_windows_are_kept_alike(spark, files):
    table = MonthTable(spark, f"{files.path}/table", ["user_id", "first_day"], F.col("first_day"))
    for k in range(3):
        files.add(trades(spark, *((f"{k}-{i}", i % 2, date(2024, 1, 1) + timedelta(days=k * 9 + i), float(i - 5)) for i in range(12))))
    keep_windows(twins.weekly_rows(files.stream()), twins.weekly_sums, "ts", F.date_add(F.col("ts").cast("date"), 1).cast("timestamp"), DELAY, table, f"{files.path}/late", f"{files.path}/state").awaitTermination()
    assert content(table.read()) == content(twins.run_available(twins.weekly_rolling(files.stream()), "complete"))


def test_weeks_are_made_of_stored_days(spark, files, monkeypatch):
    rng = random.Random(9)
    rows = [(f"t{i}", 1 + i % 3, date(2024, 1, 1) + timedelta(days=rng.randrange(25)), float(rng.randint(-9, 9))) for i in range(120)]
    for i in range(0, 120, 40):
        files.add(trades(spark, *rows[i : i + 40]))
    table = calendar_table(spark, files)
    keep_windows(twins.weekly_rows(files.stream()), twins.entry_day_sums, "ts", F.date_add(F.col("ts").cast("date"), 1).cast("timestamp"), DELAY, table, f"{files.path}/late", f"{files.path}/state").awaitTermination()
    assert table.read().count() == len({r[1:3] for r in rows})  # a row for a day, not for each of its seven weeks
    weeks = twins.weeks_of_days(table.read())
    assert content(weeks) == content(twins.weekly_sums(twins.weekly_rows(trades(spark, *rows))).select(weeks.columns))
    seen = []
    monkeypatch.setattr(plans.streams, "_kept", lambda j, rows, sums, keys, day: seen.append((sums, keys)) or table.read())
    plans.QUERIES["st_weekly_rolling"](spark, "/root/testdata/sf0.001")
    assert seen == [(twins.entry_day_sums, ["user_id", "day"])]


def test_a_batch_that_is_run_again_changes_nothing(spark, files):
    """The table holds batch 0, the checkpoint doesn't: a new run begins with batch 0 and leaves it."""
    table = calendar_table(spark, files)
    files.add(trades(spark, ("a", 1, date(2024, 1, 1), 5.0)))
    daily(spark, files, table)
    version = table.version()
    again = keep_windows(twins.calendar_rows(files.stream()), twins.daily_sums, "ts", F.date_add(F.col("ts").cast("date"), 1).cast("timestamp"), DELAY, table, f"{files.path}/late", f"{files.path}/other-state")
    again.awaitTermination()
    assert table.version() == version and content(table.read()) == [(1, date(2024, 1, 1), 5.0, 1)]


def test_lateness_follows_the_batches():
    marks, delay = {}, timedelta(days=1)
    limits = []
    for newest in (10 * 86_400_000_000, None, 5 * 86_400_000_000, 20 * 86_400_000_000, None, None):
        lateness = Lateness(marks, delay)
        limits.append(None if lateness.limit is None else lateness.limit // 86_400_000_000)
        marks = lateness.after(newest)
    assert limits == [None, None, 9, 9, 9, 19]


def events(spark, *rows):
    return spark.createDataFrame([(u, datetime(2024, 1, d, h, m)) for u, d, h, m in rows], "user_id long, ts timestamp")


def test_sessions_come_out_once_and_late_events_join_them(spark, files):
    files.add(events(spark, (1, 1, 10, 0), (1, 1, 11, 0), (2, 1, 10, 0)))
    files.add(events(spark, (1, 1, 10, 30), (2, 1, 9, 45)))  # in the wrong order: one joins two sessions of user 1
    files.add(events(spark, (1, 4, 8, 0)))  # closes the first day
    files.add(events(spark, (5, 4, 8, 0)))
    files.add(events(spark, (1, 1, 10, 40), (1, 4, 8, 20), (3, 4, 8, 0)))  # too late for the first day
    files.add(events(spark, (9, 9, 0, 0)))
    out = twins.run_available(twins.usage_sessions(files.stream()), "append")
    got = sorted((r.user_id, r.started.day, r.started.hour, r.started.minute, r.ended.hour, r.ended.minute, r.n) for r in out.collect())
    assert got == [(1, 1, 10, 0, 11, 30, 3), (1, 4, 8, 0, 8, 50, 2), (2, 1, 9, 45, 10, 30, 2), (3, 4, 8, 0, 8, 30, 1), (5, 4, 8, 0, 8, 30, 1)]


def test_all_sessions_of_a_table_come_out(spark, tmp_path):
    at = lambda d, h, m, year=2024: datetime(year, 1, d, h, m)
    rows = [(1, at(1, 10, 0)), (1, at(1, 10, 30)), (1, at(1, 11, 1)), (2, at(1, 23, 50)), (2, at(2, 0, 5)), (None, at(2, 0, 5)), (3, at(5, 0, 0, 1965)), (3, at(5, 0, 1, 1965)), (2, None), (2, None), (None, None)]
    table = spark.createDataFrame([(i, ts, u, "view", 1.0, "{}") for i, (u, ts) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for n, part in (("all", table), ("none", table.where("false")), ("untimed", table.where("ts IS NULL"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
    out = {n: plans.QUERIES["st_usage_sessions"](spark, f"{tmp_path}/{n}") for n in ("all", "none", "untimed")}
    timed = [
        (1, at(1, 10, 0), at(1, 11, 0), 2), (1, at(1, 11, 1), at(1, 11, 31), 1), (2, at(1, 23, 50), at(2, 0, 35), 2),
        (3, at(5, 0, 0, 1965), at(5, 0, 31, 1965), 2), (None, at(2, 0, 5), at(2, 0, 35), 1),
    ]
    untimed = [(2, None, None, 2), (None, None, None, 1)]
    assert content(out["all"]) == sorted(timed + untimed, key=str)
    assert content(out["none"]) == [] and content(out["untimed"]) == sorted(untimed, key=str)


def tracker(spark, *rows):
    """(user, line, minute of arrival)"""
    found = [(u, f"{m:05d}-{i}", line, datetime(2024, 6, 1) + timedelta(minutes=m)) for i, (u, line, m) in enumerate(rows)]
    return spark.createDataFrame(found, "user_id long, line_no string, line string, arrived timestamp")


def imported(spark, files, table):
    now = F.lit("2024-07-01").cast("timestamp")
    query = import_lines(files.stream(), table, now.cast("date"), now, timedelta(minutes=30), f"{files.path}/state")
    query.awaitTermination()
    return query


AAPL, TSLA, MSFT = "August 2025,aapl,150,165,100,,200", "August 2025,TSLA,210.5,,10,,", "May 2025,MSFT,100,90,5,,50"


def stored_keys(table):
    return sorted((r.user_id, r.ticker, str(r.date), r.buy_price, r.shares) for r in table.read().collect())


def test_keys_come_in_once_over_batches_restarts_and_beyond_the_horizon(spark, files):
    table = stored_trades(spark, f"{files.path}/trades")
    table.create(spark.createDataFrame([("old", 1, "TSLA", date(2025, 8, 1), 210.5, 10.0)], "trade_id string, user_id long, ticker string, date date, buy_price double, shares double"))
    files.add(tracker(spark, (1, AAPL, 0), (1, "August 2025,AAPL,150,1,7,,", 1), (1, TSLA, 2), (2, TSLA, 2), (1, "a,b,1,2,3", 3)))
    files.add(tracker(spark, (1, AAPL, 10), (1, MSFT, 11)))  # a second upload soon after
    query = imported(spark, files, table)
    first = [(1, "AAPL", "2025-08-01", 150.0, 100.0), (1, "MSFT", "2025-05-01", 100.0, 5.0), (1, "TSLA", "2025-08-01", 210.5, 10.0), (2, "TSLA", "2025-08-01", 210.5, 10.0)]
    assert stored_keys(table) == first and table.state()["marks"]["import"]["imported"] == 3
    dropped = lambda q: sum(p["stateOperators"][0]["customMetrics"].get("numDroppedDuplicateRows", 0) for p in q.recentProgress if p["stateOperators"])
    assert dropped(query) == 1  # the state dropped the second upload, the table the rest
    files.add(tracker(spark, (2, "no comma", 9000)))  # a restart from the checkpoint; the watermark moves on
    imported(spark, files, table)
    files.add(tracker(spark, (1, AAPL, 9001), (3, MSFT, 9000), (1, "May 2025,MSFT,100,90,99,,50", 9000)))
    query = imported(spark, files, table)  # the state has forgotten, the table hasn't
    assert stored_keys(table) == sorted([*first, (3, "MSFT", "2025-05-01", 100.0, 5.0)]) and dropped(query) == 0
    assert table.state()["marks"]["import"]["imported"] == 4 and table.state()["marks"]["import"]["rows"] == 8
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert sizes[-1] <= 4  # lines of earlier days are forgotten
    assert len({r.trade_id for r in table.read().collect()}) == 5


def test_lines_that_are_no_trades_are_not_kept_in_the_state(spark, files, monkeypatch):
    table = stored_trades(spark, f"{files.path}/trades")
    table.create(spark.createDataFrame([], "trade_id string, user_id long, ticker string, date date, buy_price double"))
    files.add(tracker(spark, (1, AAPL, 0), *((1, x, 0) for x in ("Month,Ticker,a,b,c,d,e", "a,b,1,2,3", "no comma", "Pnl May,1,,,,,,,")), (1, TSLA, 0)))
    query = imported(spark, files, table)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [2]
    assert len(stored_keys(table)) == 2
    seen = []
    start = plans.streams.import_lines
    monkeypatch.setattr(plans.streams, "import_lines", lambda *given: seen.append(spark.conf.get("spark.sql.streaming.stateStore.providerClass")) or start(*given))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    plans.QUERIES["st_import_dedup"](spark, "/root/testdata/sf0.001")
    assert seen == [ROCKSDB] and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_an_import_reads_and_writes_only_its_months(spark, files):
    table = stored_trades(spark, f"{files.path}/trades")
    table.create(spark.createDataFrame([(f"t{m}", 1, "A", date(2025, m, 1), 1.0) for m in range(1, 8)], "trade_id string, user_id long, ticker string, date date, buy_price double"))
    before = table.state()["months"]
    files.add(tracker(spark, (1, MSFT, 0)))
    imported(spark, files, table)
    after = table.state()["months"]
    assert [m for m in after if after[m] != before.get(m)] == ["2025-05"]
    rows, months = new_rows(tracker(spark, (1, MSFT, 0), (1, AAPL, 0)), table, F.current_date())
    assert months == ["2025-05", "2025-08"] and [r.ticker for r in rows.collect()] == ["AAPL"]
    read = [f for f in table.read(months=months).inputFiles()]
    assert read and all("month=2025-05" in f for f in read)


def test_an_import_that_is_run_again_changes_nothing(spark, files):
    table = stored_trades(spark, f"{files.path}/trades")
    table.create(spark.createDataFrame([], "trade_id string, user_id long, ticker string, date date, buy_price double"))
    files.add(tracker(spark, (1, AAPL, 0), (1, TSLA, 0)))
    imported(spark, files, table)
    version = table.version()
    now = F.lit("2024-07-01").cast("timestamp")
    import_lines(files.stream(), table, now.cast("date"), now, timedelta(minutes=30), f"{files.path}/other").awaitTermination()
    assert table.version() == version and len(stored_keys(table)) == 2


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def messages(spark, *rows):
    """(user, ticker, kind, id, shares, day of January, hour)"""
    found = [(u, t, k, i, s, datetime(2024, 1, d, h)) for u, t, k, i, s, d, h in rows]
    return spark.createDataFrame(found, "user_id long, ticker string, kind string, id string, shares double, ts timestamp")


def outcomes(df):
    return sorted((r.request_id, r.outcome, r.lot_id, r.shares) for r in df.collect())


def test_exits_of_one_lot_over_several_files_in_the_wrong_order(spark, files, rocksdb):
    files.add(messages(spark, (1, "A", "lot", "b", 10.0, 1, 0), (1, "A", "exit", "e3", 3.0, 5, 3)))
    files.add(messages(spark, (1, "A", "exit", "e1", 6.0, 5, 1), (1, "A", "exit", "e2", 5.0, 5, 2), (2, "B", "exit", "f1", 1.0, 5, 1)))
    files.add(messages(spark, (1, "A", "lot", "a", 2.0, 5, 4), (1, "A", "exit", "e3", 3.0, 5, 3)))  # a lot opened later, an exit delivered twice
    files.add(messages(spark, (1, "A", "exit", "e4", 2.0, 5, 5), (1, "A", "exit", "e5", 1.0, 5, 6)))
    files.add(messages(spark, (9, "Z", "clock", "", 0.0, 20, 0)))
    files.add(messages(spark, (1, "A", "exit", "late", 1.0, 5, 7), (9, "Z", "clock", "", 0.0, 21, 0)))
    files.add(messages(spark, (1, "A", "exit", "later", 1.0, 5, 7), (9, "Z", "clock", "", 0.0, 22, 0)))
    got = outcomes(twins.run_available(exit_apply(files.stream()), "append"))
    assert [g for g in got if not g[0].startswith("late")] == [
        ("e1", "partial", "b", 6.0), ("e2", "too many shares", None, None), ("e3", "partial", "b", 3.0), ("e4", "full", "a", 2.0), ("e5", "full", "b", 1.0), ("f1", "no open trade", None, None),
    ]
    assert ("later", "no open trade", None, None) not in got  # from behind the watermark


def _folded(lots, exits):
    """Exits in order of time, each against the first lot that was open by then."""
    lots, out = {i: [s, at] for i, s, at in lots}, []
    for at, name, shares in sorted((at, n, s) for n, s, at in exits):
        lot = next((i for i in sorted(lots) if lots[i][1] <= at), None)
        if lot is None or shares > lots[lot][0]:
            out.append((name, "no open trade" if lot is None else "too many shares", None, None))
            continue
        rest = lots[lot][0] - shares
        full = abs(rest) < 1e-10
        out.append((name, "full" if full else "partial", lot, shares))
        if full:
            del lots[lot]
        else:
            lots[lot][0] = rest
    return sorted(out), lots


def test_random_exits_equal_a_fold_and_closed_positions_leave_no_state(spark, files, rocksdb):
    rng, rows, want, left = random.Random(6), [], [], 0
    for user in range(1, 5):
        lots = [(f"{user}-l{i}", float(rng.randint(1, 5)), rng.randint(0, 5)) for i in range(3)]
        exits = [(f"{user}-e{i}", float(rng.randint(1, 4)), rng.randint(6, 23)) for i in range(12)]
        done, rest = _folded(lots, exits)
        want += done
        left += len(rest)
        rows += [(user, "A", "lot", i, s, 2, at) for i, s, at in lots] + [(user, "A", "exit", n, s, 2, at) for n, s, at in exits]
    rng.shuffle(rows)
    for at in range(0, len(rows), 20):
        files.add(messages(spark, *rows[at : at + 20]))
    files.add(messages(spark, (9, "Z", "clock", "", 0.0, 25, 0)))
    query = exit_apply(files.stream()).writeStream.outputMode("append").format("parquet").option("path", f"{files.path}/out").option("checkpointLocation", f"{files.path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert outcomes(spark.read.parquet(f"{files.path}/out")) == sorted(want)
    states = spark.read.format("statestore").option("path", f"{files.path}/c").option("stateVarName", "lots").load()
    waiting = spark.read.format("statestore").option("path", f"{files.path}/c").option("stateVarName", "waiting").load()
    assert (states.count(), waiting.count()) == (left, 0)


def test_rates_for_requests_wait_for_late_rates(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(seconds=60 * m)
    rates = [(c, float(i), at(rng.uniform(0, 200))) for i in range(60) for c in ("INR", "EUR")]
    asked = [(f"q{i}", rng.choice(["INR", "EUR", "SGD"]), at(rng.uniform(0, 200))) for i in range(80)]
    a, b = Files(spark, tmp_path / "a"), Files(spark, tmp_path / "b")
    for k in range(4):  # by time, but shuffled across the borders of files, within the delay
        near = lambda rows, i: [r for r in rows if int(((r[i] - start).total_seconds() / 60 + rng.uniform(0, 4)) // 51) == k]
        late = lambda rows, i: sorted(near(rows, i), key=lambda r: rng.random())
        state = rng.getstate()
        a.add(spark.createDataFrame(late(asked, 2), "request_id string, currency string, ts timestamp"))
        b.add(spark.createDataFrame(late(rates, 2), "currency string, rate_per_usdt double, fetched_at timestamp"))
        rng.setstate(state)
    given = [r for p in (a,) for r in spark.read.parquet(f"{p.path}/in/part=*").collect()]
    told = spark.read.parquet(f"{b.path}/in/part=*").collect()
    clock = [datetime(2024, 1, 3)]
    a.add(spark.createDataFrame([("end", "SGD", clock[0])], "request_id string, currency string, ts timestamp"))
    b.add(spark.createDataFrame([("SGD", 1.0, clock[0])], "currency string, rate_per_usdt double, fetched_at timestamp"))
    out = running_rates(a.stream(), b.stream(), 300, "30 minutes")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.request_id: r.rate for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    asked_df = spark.createDataFrame([(r.request_id, r.currency, r.ts) for r in given], "request_id string, currency string, ts timestamp")
    rates_df = spark.createDataFrame([(r.currency, r.rate_per_usdt, r.fetched_at) for r in told], "currency string, rate_per_usdt double, fetched_at timestamp")
    want = {r.request_id: r.rate for r in joins.rate_as_of(asked_df, rates_df, 300).collect()}
    assert got == want and None in want.values() and len({v for v in want.values() if v is not None}) > 10
    left = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "waiting").load()
    held = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "rates").load()
    assert (left.count(), held.count()) == (1, 2)  # the last request and its rate's two spans


def test_a_range_without_trades_falls_back_by_user(spark):
    t = trades(spark, ("a", 1, date(2024, 1, 5), 1.0), ("b", 1, date(2024, 1, 25), 1.0), ("c", 2, date(2024, 1, 25), 1.0), ("d", 2, date(2024, 2, 1), 1.0), ("e", 3, date(2023, 1, 1), 1.0))
    got = filters.metrics_range(t, F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date"))
    assert sorted(r.trade_id for r in got.collect()) == ["a", "c"] and got.columns == t.columns
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


class _State:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "appendValue":
                self.rows.append(given[0])
            elif name in ("put", "clear"):
                self.rows = list(given[0]) if given else []
            return iter(list(self.rows))

        return call


def test_calls_to_the_state_of_rates_do_not_grow_with_the_requests():
    import pandas as pd

    calls = []

    class Handle:
        getListState = getMapState = lambda self, *given: _State(calls)

        def registerTimer(self, at):  # noqa: N802
            calls.append(("timer", at))

    class Clock:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 1000

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    processor = RateProcessor(300)
    processor.init(Handle())
    asked = [("request", f"q{i}", 1000 * i + 7, 0.0) for i in range(2000)]
    rows = pd.DataFrame([("rate", "", 0, 1.5), *asked, asked[3], ("rate", "", 500_000, 2.5)], columns=["kind", "id", "at", "rate"])
    assert list(processor.handleInputRows(("INR", 0), iter([rows]), Clock())) == []
    out = pd.concat(processor.handleExpiredTimer(("INR", 0), Clock(), Clock()))
    assert sorted(zip(out["request_id"], out["rate"], strict=True)) == sorted((f"q{i}", 1.5 if i < 500 else 2.5) for i in range(1000))
    assert len(calls) < 15 and ("timer", 0) in calls and ("timer", 1000) in calls  # the earliest, then the earliest that is left
