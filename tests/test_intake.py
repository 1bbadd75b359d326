"""Documents with quarantine, imports counted on their way, exits in one pass."""

import random
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import ledger
from tradeloom.sources import schemas, store

GOOD = '"trade_id": "%s", "user_id": 1, "date": "2024-01-15", "ticker": "A", "shares": 2, "status": "open"'


def test_documents_with_reasons(spark, tmp_path):
    lines = [
        "{" + GOOD % "plain" + "}",
        '{"trade_id": "text", "user_id": "7", "date": "2024-01-15T10:00:00.5Z", "exit_date": "2024-02-01 00:00:00", "ticker": "A", "shares": "2.5", "status": "closed", "created_at": "2024-01-15T10:00:00Z", "sell_price": null}',
        "{" + GOOD % "more" + ', "color": "red", "tags": [1, 2], "n": {"x": 1}}',
        "{" + GOOD % "cut",
        "[1, 2]", "7", "nonsense", "", "   ", "null",
        '{"trade_id": "few", "ticker": " "}',
        '{"trade_id": "bad", "user_id": 1.5, "date": "15.01.2024", "ticker": "A", "shares": "NaN", "status": "held", "buy_price": {"usd": 1}, "updated_at": "soon"}',
        '{"trade_id": "day", "user_id": 1, "date": "2024-02-30", "ticker": "A", "shares": 1e400, "status": "open"}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    docs = store.ingest(spark, str(tmp_path), schemas.TRADES).cache()
    good = {r.trade_id: r for r in store.accepted(docs).collect()}
    assert set(good) == {"plain", "text", "more"}
    t = good["text"]
    assert (t.user_id, t.date, t.exit_date, t.shares, t.created_at, t.sell_price, t.extra) == (7, date(2024, 1, 15), date(2024, 2, 1), 2.5, datetime(2024, 1, 15, 10), None, None)
    assert good["more"].extra == {"color": "red", "tags": "[1,2]", "n": '{"x":1}'}
    bad = store.quarantined(docs).collect()
    why = {r.line[:20]: list(r.reasons) for r in bad}
    assert [why[x] for x in ("[1, 2]", "7", "nonsense", "null", ("{" + GOOD % "cut")[:20])] == [["not an object"]] * 5
    by = {next((n for n in ("few", "bad", "day") if f'"{n}"' in r.line), ""): set(r.reasons) for r in bad}
    assert by["few"] == {"user_id: missing", "date: missing", "ticker: missing", "shares: missing", "status: missing"}
    assert by["bad"] == {"user_id: not a bigint", "date: not a date", "shares: not a double", "status: unknown", "buy_price: not a double", "updated_at: not a timestamp"}
    assert by["day"] == {"date: not a date", "shares: not a double"}
    assert len(bad) == 8 and all(r.file.endswith("a.json") for r in bad)
    assert store.read_documents(spark, str(tmp_path), schemas.TRADES).columns == schemas.TRADES.names


def test_documents_are_read_in_one_pass(spark, tmp_path):
    (tmp_path / "a.json").write_text("{" + GOOD % "x" + "}\n")
    plan = store.ingest(spark, str(tmp_path), schemas.TRADES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan


def _lines(spark, rows):
    return spark.createDataFrame([(u, i, x) for i, (u, x) in enumerate(rows)], "user_id long, line_no long, line string").repartition(3)


TRACKER = ["Pnl,1,", "Month,a", "no comma", "a,b,c", "May 2024,A,1,2,3,,", "May 2024,A,1,9,9,,", ",A,1,2,3,,", "May 2024,,1,2,3,,", "May 2024,A,0,2,3,,", "May 2024,A,1,2,x,,", " May 2024 ,\tb\t,1,2,3,,", "Average,1"]


def test_faults_of_lines(spark):
    rows = ledger.tracker_rows(_lines(spark, [(1, x) for x in [*TRACKER, None]]), F.lit("2025-01-01").cast("date")).collect()
    assert [r.fault for r in sorted(rows, key=lambda r: r.line_no)] == ["ignored", "ignored", "ignored", "fields", None, None, "month", "ticker", "buy_price", "shares", None, "ignored", "ignored"]
    assert next(r for r in rows if r.line_no == 10).ticker == "B"


def test_counts_come_with_the_write(spark, tmp_path):
    lines = _lines(spark, [(u, x) for u in (1, 2, 3) for x in TRACKER])
    day = F.lit("2025-01-01").cast("date")
    stored = spark.createDataFrame([(2, "A", date(2024, 5, 1), 1.0)], "user_id long, ticker string, date date, buy_price double")
    rows, seen, done = ledger.import_counted(lines, stored, day)
    rows.write.parquet(str(tmp_path / "new"))
    assert seen.get == {"lines": 36, "ignored": 12, "rejected": 15}
    report = ledger.import_report(ledger.mark_import(ledger.parse_tracker(lines, day), stored)).agg(F.sum("imported"), F.sum("skipped")).first()
    assert (done.get["imported"], done.get["skipped"]) == tuple(report) == (5, 4)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 5
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 3") == 1 and plan.count("CollectMetrics") == 2  # the lines are read once


def _plain(lots, exits):
    """Outcomes of exits of one key in order, each against the first lot that is left."""
    lots, out = sorted(lots), []
    for _, name, shares in sorted(exits):
        if not lots:
            out.append((name, "no open trade", None, None))
        elif shares > lots[0][1]:
            out.append((name, "too many shares", None, None))
        else:
            rest = lots[0][1] - shares
            full = abs(rest) < 1e-10
            out.append((name, "full" if full else "partial", lots[0][0], shares))
            lots = lots[1:] if full else [(lots[0][0], rest), *lots[1:]]
    return out


def _trades(spark, rows):
    base = dict.fromkeys(schemas.TRADES.names)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schemas.TRADES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exits_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    keys = [(u, t) for u in range(1, 6) for t in "AB"]
    lots = {k: [(f"{k[0]}{k[1]}{i}", float(rng.randint(1, 9))) for i in range(rng.randint(0, 3))] for k in keys}
    exits = {k: [(datetime(2024, 1, 1, 0, rng.randint(0, 9)), f"{k[0]}{k[1]}-{i}", rng.choice([1.0, 2.0, 0.5, 5.0])) for i in range(rng.randint(0, 12))] for k in keys}
    t = _trades(spark, [{"trade_id": i, "user_id": u, "ticker": x, "shares": s, "status": "open", "date": date(2024, 1, 1)} for (u, x), own in lots.items() for i, s in own] + [{"trade_id": "zz", "user_id": 1, "ticker": "A", "shares": 1.0, "status": "closed"}])
    asked = spark.createDataFrame([(n, u, x, s, 3.0, "n", at) for (u, x), own in exits.items() for at, n, s in own], schemas.EXIT_REQUESTS).repartition(5)
    after, done = ledger.apply_exits(t, asked, F.lit("2024-02-01").cast("date"))
    want = [o for k in keys for o in _plain(lots[k], exits[k])]
    assert sorted((r.request_id, r.outcome, r.lot_id, r.shares) for r in done.collect()) == sorted(want)
    closed = sum(o[3] for o in want if o[3])
    got = after.groupBy("status").agg(F.sum("shares").alias("s")).collect()
    assert {r.status: r.s for r in got} == pytest.approx({"open": sum(s for own in lots.values() for _, s in own) - closed, "closed": closed + 1.0} if any(lots.values()) else {"closed": 1.0})


def test_a_hundred_thousand_exits_of_one_position(spark):
    t = _trades(spark, [{"trade_id": f"l{i}", "user_id": 1, "ticker": "A", "shares": 60_000.0, "status": "open", "date": date(2024, 1, 1)} for i in range(2)])
    asked = spark.range(100_000).selectExpr("lpad(id, 6, '0') as request_id", "1L as user_id", "'A' as ticker", "1.0D as shares_to_exit", "2.0D as sell_price", "'' as notes", "timestamp_seconds(id) as ts")
    began = time.time()
    got = {(r.outcome, r.lot_id): r.n for r in ledger.apply_exits(t, asked, F.lit("2024-02-01").cast("date"))[1].groupBy("outcome", "lot_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("partial", "l0"): 59_999, ("full", "l0"): 1, ("partial", "l1"): 40_000} and time.time() - began < 30


def test_documents_are_parsed_once_and_stored_compressed(spark, monkeypatch):
    from tradeloom.plans import projections
    from tradeloom.sources.canonical import Journal

    seen = []
    monkeypatch.setattr(projections, "ingest", lambda *given: seen.append(given[1]) or store.ingest(*given))
    documents = projections._documents(Journal(spark, "/root/testdata/sf0.001"))
    for some in (store.accepted(documents), store.quarantined(documents)):
        # what is parsed comes out of generators, and no projection above them parses it again for each field
        assert some._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 3
    assert seen and all(f.endswith(".lz4") for f in spark.read.text(seen[0]).inputFiles())
