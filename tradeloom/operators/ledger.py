"""Changes to stored trades: intake, CSV import, patches, upserts, deletions and exits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import filled_risk, given, normal_shares, parsed_month
from .filters import trade_faults
from .joins import with_balance


def intake(new: DataFrame, profiles: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with faults) of new trades: normalised, validated, risk filled, stamped."""
    clean = new.withColumns({"ticker": F.upper("ticker"), "shares": normal_shares("shares"), "buy_price": F.when(F.col("buy_price") > 0, F.col("buy_price")), "sell_price": F.when(F.col("status") == "closed", F.col("sell_price"))})
    checked = clean.withColumn("faults", trade_faults())
    good = with_balance(checked.where(F.size("faults") == 0).drop("faults"), profiles)
    percent, dollars = filled_risk(F.col("balance"))
    good = good.withColumns({"risk": percent, "risk_dollars": dollars, "account_balance": F.col("balance"), "created_at": now, "updated_at": now}).drop("balance")
    return good, checked.where(F.size("faults") > 0)


#: The white space around a field.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_HEADS = ("Pnl", "Month", "Average")


def may_be_trade() -> Column:
    """Whether a tracker line can be a trade at all, told without taking it apart: no title or summary, and fields enough."""
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    head = F.lit(False)
    for word in _HEADS:
        head |= F.col("line").startswith(word)
    return ~head & (commas >= 6)


def tracker_rows(lines: DataFrame, as_of: Column) -> DataFrame:
    """All tracker CSV lines (user_id, line_no, line) as rows, with fault: fields by plain commas, quotes mean nothing.

    fault is NULL for a trade. `ignored`: a line without a comma, a header or a summary line. `fields`: too few of them;
    `month` and `ticker`: empty; `buy_price` and `shares`: not above 0. The first that holds is told.
    """
    head = F.lit(False)
    for word in _HEADS:
        head |= F.col("line").startswith(word)
    ignored = ~F.col("line").contains(",") | head
    # A generator computes what it holds once; a projection's columns would be computed again wherever they are named.
    once = lambda df, x, name: df.select("*", F.explode(F.array(x)).alias(name))
    rows = once(lines.select("user_id", "line_no", F.coalesce(ignored, F.lit(True)).alias("_ignored"), "line"), F.split("line", ",", -1), "f")
    field = lambda i: F.btrim(F.coalesce(F.get("f", F.lit(i)), F.lit("")), F.lit(WHITE))
    number = lambda i: F.coalesce(field(i).try_cast("double"), F.lit(0.0))  # noqa: E731  # a field has no commas
    fields = F.struct(
        F.size("f").alias("n"), field(0).alias("month"), F.upper(field(1)).alias("ticker"), number(2).alias("buy_price"), number(3).alias("_sell"), number(4).alias("shares"), number(6).alias("_risk"), number(13).alias("_pnl")
    )
    rows = once(rows, F.when(~F.col("_ignored") & (F.size("f") >= 7), fields), "x").select("user_id", "line_no", "_ignored", "x.*")
    fault = F.when(F.col("_ignored"), "ignored").when(F.col("n").isNull(), "fields").when(F.col("month") == "", "month").when(F.col("ticker") == "", "ticker").when(~(F.col("buy_price") > 0), "buy_price").when(~(F.col("shares") > 0), "shares")
    rows = rows.withColumn("fault", fault)
    sold = F.col("_sell") > 0
    return rows.select(
        "user_id", "line_no", "fault", parsed_month("month", as_of).alias("date"), "ticker", "buy_price", F.when(sold, F.col("_sell")).alias("sell_price"), "shares", F.when(F.col("_risk") > 0, F.col("_risk")).alias("risk_dollars"),
        F.when(sold, "closed").otherwise("open").alias("status"), F.when(sold, F.when(F.col("_pnl") != 0, F.col("_pnl")).otherwise((F.col("_sell") - F.col("buy_price")) * F.col("shares"))).alias("pnl"),
        F.concat(F.lit("Imported from CSV - "), "month").alias("notes"),
    )


def parse_tracker(lines: DataFrame, as_of: Column) -> DataFrame:
    """The trades of tracker CSV lines; other lines and rows with a fault are dropped (see tracker_rows)."""
    return tracker_rows(lines.where(may_be_trade()), as_of).where("fault is null").drop("fault")


IMPORT_KEY = ["user_id", "ticker", "date", "buy_price"]


def mark_import(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows with accepted: the first line of its key, and no stored trade has the key. One hash layout serves both steps."""
    w = Window.partitionBy(*IMPORT_KEY).orderBy("line_no")
    first = rows.withColumn("_n", F.row_number().over(w))
    known = stored.select(*IMPORT_KEY).distinct().withColumn("_known", F.lit(True))
    return first.join(known, IMPORT_KEY, "left").withColumn("accepted", (F.col("_n") == 1) & F.col("_known").isNull()).drop("_n", "_known")


def import_report(marked: DataFrame) -> DataFrame:
    return marked.groupBy("user_id").agg(F.count_if("accepted").alias("imported"), F.count_if(~F.col("accepted")).alias("skipped"))


def append(stored: DataFrame, marked: DataFrame) -> DataFrame:
    """stored and the accepted rows of an import; columns that one side lacks are NULL there."""
    return stored.unionByName(marked.where("accepted").drop("accepted", "line_no"), allowMissingColumns=True)


def import_counted(lines: DataFrame, stored: DataFrame, as_of: Column) -> tuple[DataFrame, Observation, Observation]:
    """(rows to append, what the lines were, what became of the rows): the counts come with the pass that writes the rows.

    The first observation has lines, ignored and rejected, the second imported and skipped; they can be read once the rows
    have been written. Nothing is parsed twice.
    """
    seen, done = Observation(), Observation()
    rows = tracker_rows(lines, as_of)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("fault") == "ignored").alias("ignored"), F.count_if(F.col("fault") != "ignored").alias("rejected"))
    marked = mark_import(rows.where("fault is null").drop("fault"), stored)
    marked = marked.observe(done, F.count_if("accepted").alias("imported"), F.count_if(~F.col("accepted")).alias("skipped"))
    return marked.where("accepted").drop("accepted", "line_no"), seen, done


def patch(trades: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Trades with partial updates applied (trade_id and the fields to change, NULL: unchanged), and faults.

    A merged row that breaks the rules of trades keeps its stored values; its faults say why. Of several
    updates of a trade the last (by seq) holds. ``asker``, if updates have it, is who asks: an update of another user's
    trade is refused (fault: owner). A missing risk field is filled from the update's or the trade's own balance only.
    updated_at changes for updated trades alone.
    """
    fields = [c for c in updates.columns if c not in ("trade_id", "seq", "asker")]
    asker = [F.max_by("asker", "seq").alias("_asker")] if "asker" in updates.columns else [F.lit(None).alias("_asker")]
    last = updates.groupBy("trade_id").agg(*(F.max_by(c, "seq").alias(f"_{c}") for c in fields), *asker, F.lit(True).alias("_asked"))
    rows = trades.join(last, "trade_id", "left")
    set_ = {*fields, "risk", "risk_dollars"}
    value = {c: F.upper(F.coalesce(f"_{c}", c)) if c == "ticker" else F.coalesce(f"_{c}", c) for c in fields}
    merged = rows.withColumns({f"_old_{c}": F.col(c) for c in set_}).withColumns(value)
    percent, dollars = filled_risk(F.col("account_balance"))
    foreign = F.coalesce(F.col("_asker") != F.col("user_id"), F.lit(False)) if "asker" in updates.columns else F.lit(False)
    faults = F.when(foreign, F.array(F.lit("owner"))).otherwise(trade_faults())
    merged = merged.withColumn("faults", F.when(F.col("_asked"), faults).otherwise(F.array().cast("array<string>")))
    merged = merged.withColumns({"_risk_filled": percent, "_dollars_filled": dollars}).withColumn("_ok", F.coalesce(F.col("_asked"), F.lit(False)) & (F.size("faults") == 0))
    keep = lambda c: F.when(F.col("_ok"), {"risk": F.col("_risk_filled"), "risk_dollars": F.col("_dollars_filled")}.get(c, F.col(c))).otherwise(F.col(f"_old_{c}"))
    stored = F.col("updated_at") if "updated_at" in trades.columns else F.lit(None).cast("timestamp")
    out = merged.withColumns({c: keep(c) for c in set_}).withColumn("updated_at", F.when(F.col("_ok"), now).otherwise(stored))
    return out.select(*trades.columns, *([] if "updated_at" in trades.columns else ["updated_at"]), F.array_join("faults", ",").alias("faults"))


def changed_fields(edits: DataFrame, stored: DataFrame, key: str = "trade_id") -> DataFrame:
    """edits with each field that equals the stored one set to NULL: what a client sends as an update."""
    fields = [c for c in edits.columns if c != key]
    both = edits.join(stored.select(key, *(F.col(c).alias(f"_{c}") for c in fields)), key, "left")
    return both.select(key, *(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).alias(c) for c in fields))


def owner_delete(rows: DataFrame, requests: DataFrame, key: str = "trade_id") -> tuple[DataFrame, DataFrame]:
    """(rows left, requests with outcome: deleted, forbidden or missing). requests: key and user_id of the asker."""
    left = rows.join(requests.select(key, "user_id").distinct(), [key, "user_id"], "left_anti")
    owner = rows.select(key, F.col("user_id").alias("_owner"))
    outcome = F.when(F.col("_owner").isNull(), "missing").when(F.col("_owner") == F.col("user_id"), "deleted").otherwise("forbidden")
    return left, requests.join(owner, key, "left").withColumn("outcome", outcome).drop("_owner")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], now: Column, order: str = "seq") -> DataFrame:
    """stored merged with a batch by key: given (non-NULL) fields overwrite, created_at stays, new keys are added.

    Of rows with one key the last by ``order`` holds. created_at is kept on every update, also of fee settings.
    """
    fields = [c for c in stored.columns if c not in (*keys, "created_at", "updated_at")]
    last = batch.groupBy(*keys).agg(*(F.max_by(c, order).alias(f"_{c}") for c in fields), F.lit(True).alias("_new"))
    rows = stored.join(last, keys, "full")
    stamp = {"created_at": F.coalesce("created_at", F.when(F.col("_new"), now)), "updated_at": F.when(F.col("_new"), now).otherwise(F.col("updated_at"))}
    return rows.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in fields), *(v.alias(n) for n, v in stamp.items() if n in stored.columns))


_DONE = "user_id long, ticker string, request_id string, outcome string, trade_id string, shares double, sell_price double, said string, rest double"


def _noted(notes: Column, word: str, said: Column) -> Column:
    return F.btrim(F.concat(F.coalesce(notes, F.lit("")), F.lit(f" | {word}: "), F.coalesce(said, F.lit(""))), F.lit(" |"))


def _fold_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of exits in order; rows come sorted by key, a key's lots first."""
    key, lots, place, left = None, [], 0, 0.0
    for batch in batches:
        out = []
        for user, ticker, kind, name, shares, price, said in zip(*(batch[c].tolist() for c in ("user_id", "ticker", "kind", "id", "shares", "sell_price", "notes")), strict=True):
            if (user, ticker) != key:
                key, lots, place, left = (user, ticker), [], 0, 0.0
            if kind == 0:
                left = left if lots else shares
                lots.append((name, shares))
            elif place == len(lots):
                out.append((user, ticker, name, "no open trade", None, None, None, None, None))
            elif shares > left:
                out.append((user, ticker, name, "too many shares", None, None, None, None, None))
            else:
                lot = lots[place][0]
                left = 0.0 if abs(left - shares) < 1e-10 else left - shares
                out.append((user, ticker, name, "partial" if left else "full", lot, shares, price, said, left))
                if not left:
                    place += 1
                    left = lots[place][1] if place < len(lots) else 0.0
        if out:
            yield pd.DataFrame(out, columns=["user_id", "ticker", "request_id", "outcome", "trade_id", "shares", "sell_price", "said", "rest"])


def apply_exits(trades: DataFrame, requests: DataFrame, exit_day: Column, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(trades after the exits, outcome of each request). requests: request_id, user_id, ticker, shares_to_exit,
    sell_price, notes, ts.

    Exits of a user and ticker are taken in order of ts, each against the first open trade (by trade_id); one of more
    shares than that trade has is rejected and changes nothing. A full exit closes the row; a partial one leaves the rest open
    and adds a closed row, a copy of the trade whose risk isn't prorated. Rows that an exit changes or adds get ``now`` as
    updated_at, if trades have that column; created_at is the trade's.

    What an exit finds depends on those before it, so a key's exits are one pass: partitions by key, sorted so that a key's
    lots come before its exits. The pass holds the lots of one key, a place among them and what is left there, and gives
    outcomes as it goes, however many exits a key has. What it decides comes back to a trade by one join, and there a trade
    becomes itself and the parts split off from it.
    """
    keys = ["user_id", "ticker"]
    lots = trades.where("status = 'open'").join(requests.select(*keys).distinct(), keys, "left_semi")
    empty = {n: F.lit(None).cast(t) for n, t in (("ts", "timestamp"), ("sell_price", "double"), ("notes", "string"))}
    both = lots.select(*keys, F.lit(0).alias("kind"), empty["ts"].alias("ts"), F.col("trade_id").alias("id"), "shares", empty["sell_price"].alias("sell_price"), empty["notes"].alias("notes")).unionByName(
        requests.select(*keys, F.lit(1).alias("kind"), "ts", F.col("request_id").alias("id"), F.col("shares_to_exit").alias("shares"), "sell_price", "notes")
    )
    # by a hash of its own: an exchange by the keys themselves can be dropped in favour of the joins' partitions, which the
    # adaptive plan may change afterwards
    dealt = both.withColumn("_to", F.xxhash64(*keys)).repartition("_to").sortWithinPartitions(*keys, "kind", "ts", "id")
    done = dealt.drop("ts", "_to").mapInPandas(_fold_exits, _DONE)
    exit_ = F.struct("request_id", "shares", "sell_price", "said")
    changes = done.where("trade_id is not null").groupBy("trade_id").agg(
        F.max(F.when(F.col("outcome") == "full", exit_)).alias("_full"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "partial", exit_))).alias("_parts"), F.min("rest").alias("_rest")
    )
    stamp = F.current_timestamp() if now is None else now
    closed, touched = F.col("_full").isNotNull(), F.col("_rest").isNotNull()
    itself = {
        "shares": F.when(closed, F.col("_full.shares")).otherwise(F.coalesce("_rest", "shares")), "status": F.when(closed, "closed").otherwise(F.col("status")), "sell_price": F.when(closed, F.col("_full.sell_price")).otherwise(F.col("sell_price")),
        "exit_date": F.when(closed, exit_day).otherwise(F.col("exit_date")), "notes": F.when(closed & (F.length("_full.said") > 0), _noted(F.col("notes"), "Exit", F.col("_full.said"))).otherwise(F.col("notes")),
        "updated_at": F.when(touched, stamp).otherwise(F.col("updated_at")) if "updated_at" in trades.columns else None,
    }
    part = lambda x: {
        "trade_id": F.concat_ws("/", "trade_id", x["request_id"]), "shares": x["shares"], "status": F.lit("closed"), "sell_price": x["sell_price"], "exit_date": exit_day, "notes": _noted(F.col("notes"), "Partial exit", x["said"]), "updated_at": stamp,
        "account_balance": F.lit(None),
    }
    row = lambda new: F.struct(*(new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in trades.schema.fields))
    rows = F.concat(F.array(row(itself)), F.transform(F.coalesce("_parts", F.array().cast("array<struct<request_id:string,shares:double,sell_price:double,said:string>>")), lambda x: row(part(x))))
    after = trades.join(changes, "trade_id", "left").select(F.explode(rows).alias("row")).select("row.*")
    return after, done.select("request_id", "user_id", "ticker", "outcome", F.col("trade_id").alias("lot_id"), "shares")
