"""Stored daily sums after changes against the full run."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import calendar, curves, upkeep
from tradeloom.sources import schemas


def frame(spark, rows):
    base = dict.fromkeys(schemas.TRADES.names)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schemas.TRADES)


def trade(rng, i):
    start = date(2024, 1, 1)
    return {"trade_id": f"t{i}", "user_id": rng.randint(1, 4), "date": rng.choice([None, *(start + timedelta(days=rng.randrange(200)) for _ in range(6))]), "exit_date": rng.choice([None, start + timedelta(days=rng.randrange(250))]),
            "buy_price": rng.choice([10.1, 20.3, None]), "sell_price": rng.choice([11.7, 0.1, 30.0, 0.0]), "shares": rng.choice([1.0, 3.0]), "status": rng.choice(["open", "closed", "closed"])}


def full(t, make):
    if make is upkeep.calendar_days:
        return sorted(((r.user_id, r.day, r.pnl, r.trade_count) for r in calendar.daily(t).collect()), key=str)
    rows = curves.equity_curve(t)
    last = rows.groupBy("user_id", "date").agg(F.max_by("equity", "trade_id").alias("running"), F.count("*").alias("n"))
    return sorted(((r.user_id, r.date, r.running, r.n) for r in last.collect()), key=str)


@pytest.mark.parametrize("make", [upkeep.equity_days, upkeep.calendar_days])
def test_random_changes_equal_the_full_run(spark, tmp_path, make):
    rng = random.Random(8)
    rows = {i: trade(rng, i) for i in range(150)}
    days = make(spark, str(tmp_path / "d"))
    days.create(frame(spark, rows.values()))
    number = 150
    for _ in range(3):
        removed, added = [], []
        for i in rng.sample(sorted(rows), 12):
            removed.append(rows.pop(i))
            if rng.random() < 0.6:
                rows[i] = trade(rng, i)
                added.append(rows[i])
        for _ in range(5):
            rows[number] = trade(rng, number)
            added.append(rows[number])
            number += 1
        days.change(frame(spark, removed), frame(spark, added))
        got = days.read().collect()
        last = "pnl" if make is upkeep.calendar_days else "running"
        assert sorted(((r.user_id, r.day, r[last], r.trades) for r in got), key=str) == full(frame(spark, rows.values()), make)


def test_only_months_from_the_first_touched_day_on_are_written(spark, tmp_path):
    one = lambda i, u, m, p=1.0: {"trade_id": f"t{i}", "user_id": u, "date": date(2024, m, 3), "buy_price": 10.0, "sell_price": 10.0 + p, "shares": 1.0, "status": "closed"}
    days = upkeep.equity_days(spark, str(tmp_path / "d"))
    days.create(frame(spark, [one(m, 1, m) for m in range(1, 7)]))
    before = days.table.state()["months"]
    days.change(frame(spark, [one(4, 1, 4)]), frame(spark, [one(4, 1, 5, 3.0)]))
    after = days.table.state()["months"]
    assert {m for m in after if after[m] == before[m]} == {"2024-01", "2024-02", "2024-03"} and "2024-04" not in after
    assert {r.day.month: r.running for r in days.read().collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 5: 7.0, 6: 8.0}
    version = days.table.version()
    assert days.change(frame(spark, [one(5, 1, 5)]), frame(spark, [one(5, 1, 5)])) == version  # nothing changes
