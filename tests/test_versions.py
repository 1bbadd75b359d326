"""Tables by month: which files a merge touches, what readers see, races, clean-up."""

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradeloom.sources.versions import NO_MONTH, Conflict, MonthTable

SCHEMA = "k long, day date, v string"


@pytest.fixture
def table(spark, tmp_path):
    return MonthTable(spark, str(tmp_path / "t"), ["k"], F.col("day"))


def rows(spark, *found, schema=SCHEMA):
    return spark.createDataFrame(list(found), schema)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(table, month):
    return sorted(str(p) for p in Path(table.path, "rows").glob(f"commit=*/month={month}/*.parquet"))


JAN, FEB, MAR = date(2024, 1, 5), date(2024, 2, 5), date(2024, 3, 5)


def test_merge_moves_adds_and_deletes_and_leaves_other_months_alone(spark, table):
    table.create(rows(spark, (1, JAN, "a"), (2, JAN, "b"), (3, FEB, "c"), (4, MAR, "d"), (5, None, "e"), (None, MAR, "n")))
    january, march = files(table, "2024-01"), files(table, "2024-03")
    assert table.merge(rows(spark, (3, MAR, "moved"), (6, MAR, "new")), delete=rows(spark, (5, None, ""), (99, None, "")).select("k")) == 1
    assert content(table.read()) == content(rows(spark, (1, JAN, "a"), (2, JAN, "b"), (3, MAR, "moved"), (4, MAR, "d"), (6, MAR, "new"), (None, MAR, "n")))
    assert files(table, "2024-01") == january and set(files(table, "2024-03")) > set(march)
    assert set(table.state()["months"]) == {"2024-01", "2024-03"}  # emptied months are gone, NO_MONTH too
    assert table.state()["months"]["2024-01"] == table.state(0)["months"]["2024-01"]
    assert len(content(table.read(0))) == 6  # a reader of the old version isn't disturbed


def test_a_frame_keeps_the_version_that_it_was_read_from(spark, table):
    table.create(rows(spark, (1, JAN, "a")))
    before = table.read()
    table.merge(rows(spark, (1, JAN, "b")))
    assert content(before) == [(1, JAN, "a")] and content(table.read()) == [(1, JAN, "b")]


def test_months_are_pruned(spark, table):
    table.create(rows(spark, (1, JAN, "a"), (2, FEB, "b"), (3, None, "c")))
    assert content(table.read(months=["2024-02", NO_MONTH])) == [(2, FEB, "b"), (3, None, "c")]
    some = table.read(with_month=True).where("month = '2024-01'")
    assert "2024-02" not in "".join(some.inputFiles()) or "PartitionFilters: [isnotnull(month" in some._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in some.collect()] == [1]


def test_two_writers_from_one_version(spark, table, monkeypatch):
    """The second one loses, and by itself goes on from the first one's version."""
    table.create(rows(spark, (1, JAN, "a"), (2, FEB, "b")))
    other, write = MonthTable(spark, table.path, ["k"], F.col("day")), MonthTable._write
    turns = []

    def slow(self, *args):
        done = write(self, *args)
        if self is table and not turns:
            turns.append(1)
            other.merge(rows(spark, (1, FEB, "theirs")))
        return done

    monkeypatch.setattr(MonthTable, "_write", slow)
    with pytest.raises(Conflict):
        table.merge(rows(spark, (3, JAN, "c")), attempts=1)
    assert content(table.read()) == [(1, FEB, "theirs"), (2, FEB, "b")]
    turns.clear()
    assert table.merge(rows(spark, (2, JAN, "ours"))) == 3
    assert content(table.read()) == [(1, FEB, "theirs"), (2, JAN, "ours")]


def test_new_columns_marks_and_odd_calls(spark, table):
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        table.merge(rows(spark, (1, JAN, "a")))
    table.create(rows(spark, (1, JAN, "a")), marks={"batch": 1, "other": "x"})
    with pytest.raises(Conflict):
        table.create(rows(spark, (1, JAN, "a")))
    with pytest.raises(ValueError):
        table.merge(None)
    table.merge(rows(spark, (2, FEB, "b", 1.5), schema=SCHEMA + ", more double"), marks={"batch": 2})
    assert content(table.read()) == [(1, JAN, "a", None), (2, FEB, "b", 1.5)] and table.state()["marks"] == {"batch": 2, "other": "x"}
    table.merge(rows(spark, (1, JAN, "a")).limit(0))  # nothing changes
    assert len(content(table.read())) == 2


def test_an_empty_table_and_its_first_rows(spark, table):
    table.create(rows(spark, (1, JAN, "a")).limit(0))
    assert content(table.read()) == []
    table.merge(rows(spark, (1, JAN, "a")))
    table.merge(None, delete=rows(spark, (1, JAN, "a")).select("k"))
    assert content(table.read()) == [] and table.state()["months"] == {}


def test_expire_keeps_what_the_last_versions_name(spark, table):
    table.create(rows(spark, (1, JAN, "a"), (2, FEB, "b")))
    for i in range(3):
        table.merge(rows(spark, (1, JAN, f"a{i}")))
    kept = [content(table.read(n)) for n in (2, 3)]
    assert len(table.expire(keep=2)) == 2 and len(files(table, "2024-01")) == 2 and len(files(table, "2024-02")) == 1
    assert [content(table.read(n)) for n in (2, 3)] == kept and table.version() == 3
    with pytest.raises(Exception):
        table.state(0)


def test_random_merges_equal_a_dictionary(spark, table):
    rng, model = random.Random(3), {}
    start = [(k, date(2024, rng.randint(1, 6), 1), "0") for k in range(40)]
    model.update((r[0], r) for r in start)
    table.create(rows(spark, *start))
    for turn in range(4):
        change = [(k, rng.choice([None, date(2024, rng.randint(1, 6), 1)]), str(turn)) for k in rng.sample(range(60), 8)]
        delete = rng.sample(range(60), 3)
        within = None
        table.merge(rows(spark, *change), delete=rows(spark, *((k, None, "") for k in delete)).select("k"), within=within)
        for k in delete:
            model.pop(k, None)
        model.update((r[0], r) for r in change)
        assert content(table.read()) == sorted(model.values(), key=str)


def test_rows_are_stored_as_zstd(spark, tmp_path):
    new = MonthTable(spark, str(tmp_path / "small"), ["id"], F.col("day"))
    new.create(spark.createDataFrame([(1, date(2024, 1, 1))], "id long, day date"))
    assert [f.rsplit(".", 2)[-2] for f in new.read().inputFiles()] == ["zstd"]
