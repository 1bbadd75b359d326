"""The journal's tables as views over the given star schema.

Each view is a dictionary of column expressions that mean the same to Spark SQL and to DuckDB, so that queries and
their checks start from the same rows: frames for Spark, CTE text for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"  # the clock of trades
AS_OF_USERS = "2024-01-31"  # the clock of users and events, midnight UTC

TRADE_COLUMNS = {
    "trade_id": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string), cast(cast(round(l_extendedprice*100) as bigint) as string), cast(cast(l_shipdate as date) as string))",
    "user_id": "o_custkey",
    "date": "cast(o_orderdate as date)",
    "exit_date": "case when l_linestatus='F' and l_returnflag<>'N' then greatest(cast(l_shipdate as date), cast(o_orderdate as date)) end",
    "ticker": "upper(p_brand)",
    "buy_price": "case when l_linestatus='F' and l_linenumber=7 then null else l_extendedprice/l_quantity end",
    "sell_price": "case when l_linestatus='O' then null when l_linenumber=6 and l_returnflag='R' then cast(0.0 as double) else (l_extendedprice/l_quantity)*(1+(l_discount-l_tax)) end",
    "shares": "l_quantity",
    "risk": "case when l_tax>0 then l_tax*100 end",
    "risk_dollars": "case when l_linenumber in (2,4) then l_extendedprice*cast(0.02 as double) end",
    "account_balance": "case when l_linenumber=3 then cast(25000 as double) end",
    "notes": "case when l_linenumber in (1,4) then concat(p_name,' ',o_orderpriority) when l_linenumber=5 then '  ' end",
    "status": "case when l_linestatus='F' then 'closed' else 'open' end",
}
PROFILE_COLUMNS = {"user_id": "c_custkey", "account_balance": "c_acctbal", "currency": "'USD'", "risk_tolerance": "case when c_custkey%4=0 then cast(1.0 as double) else cast(2.0 as double) end"}
FEE_COLUMNS = {
    "user_id": "c_custkey",
    "brokerage_percentage": "cast(0.1 as double)*(1+c_nationkey%5)",
    "brokerage_max_usd": "cast(5*(1+c_custkey%6) as double)",
    "exchange_transaction_charges_percentage": "cast(0.12 as double)",
    "ifsca_turnover_fees_percentage": "cast(0.0001 as double)",
    "platform_fee_usd": "cast(c_custkey%3 as double)",
}
_START = "cast(1000 + sum(cast(o_totalprice as decimal(18,2))) as double)"
MONTH_COLUMNS = {
    "user_id": "o_custkey",
    "month_start": "cast(date_trunc('month', o_orderdate) as date)",
    "start_cap": _START,
    "close_cap": f"case when count(*)%4<>0 then {_START} + cast(max(cast(o_totalprice as decimal(18,2))) as double) - 150000 end",
}
USER_COLUMNS = {
    "uid": "c_custkey",
    "email": "case when c_custkey%10<>9 then concat(lower(c_name),'@example.com') end",
    "display_name": "case when c_custkey%4=0 then c_name end",
    "last_sign_in": "last_ts",
}
_FROM = {
    "trades": (TRADE_COLUMNS, "lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"),
    "profiles": (PROFILE_COLUMNS, "customer where c_acctbal > 0"),
    "fees_configs": (FEE_COLUMNS, "customer where c_custkey%3<>0"),
    "monthly_returns": (MONTH_COLUMNS, "orders group by o_custkey, cast(date_trunc('month', o_orderdate) as date)"),
    "users": (USER_COLUMNS, "customer left join (select user_id, max(ts) as last_ts from events group by user_id) e on c_custkey = e.user_id"),
    "usage_events": ({"user_id": "user_id", "ts": "ts", "action": "event_type", "event_label": "props->>'$.k'", "value": "value"}, "events"),
}


def ctes(*views: str) -> str:
    """`view AS (...), ...` of the named views, for a WITH clause."""
    return ", ".join(f"{v} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FROM[v][0].items())} FROM {_FROM[v][1]})" for v in views)


class Journal:
    """The journal's tables of one data folder, as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.selectExpr(*(f"{e} as {n}" for n, e in columns.items()))

    def trades(self) -> DataFrame:
        lines, orders, part = self.table("lineitem"), self.table("orders"), self.table("part")
        joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
        return self._select(joined, TRADE_COLUMNS)

    def profiles(self) -> DataFrame:
        return self._select(self.table("customer").where("c_acctbal > 0"), PROFILE_COLUMNS)

    def fees(self) -> DataFrame:
        return self._select(self.table("customer").where("c_custkey % 3 <> 0"), FEE_COLUMNS)

    def monthly_returns(self) -> DataFrame:
        total, top = F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.max(F.col("o_totalprice").cast("decimal(18,2)"))
        by = self.table("orders").groupBy(F.col("o_custkey").alias("user_id"), F.trunc("o_orderdate", "month").alias("month_start"))
        start = (F.lit(1000) + F.col("t")).cast("double")
        return by.agg(total.alias("t"), top.alias("m"), F.count("*").alias("n")).select("user_id", "month_start", start.alias("start_cap"), F.when(F.col("n") % 4 != 0, start + F.col("m").cast("double") - 150000).alias("close_cap"))

    def users(self) -> DataFrame:
        last = self.table("events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
        customer = self.table("customer")
        return self._select(customer.join(last, customer["c_custkey"] == last["user_id"], "left"), USER_COLUMNS)

    def usage_events(self) -> DataFrame:
        return self.table("events").select("user_id", "ts", F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("event_label"), "value")
