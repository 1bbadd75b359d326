"""Tables by month with versions: a merge rewrites the months that it touches and no other, and a reader sees all of it or nothing.

A version is a small file that names, for each month, the commit folder that holds the month's rows. A merge writes new
folders beside the old ones and then adds the next version; that file is made by a rename that fails if it is there, so of
two writers that start from one version one loses, and goes on from the winner's. Files of months that a merge doesn't
touch are neither read in full nor written. The size of a version file grows with the number of months, not of rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows without a day are a month of their own.
NO_MONTH = "none"


class Conflict(RuntimeError):
    """Another writer was first."""


class MonthTable:
    """Rows with unique keys, in folders by the month of a day.

    day: what gives a row its month, from the row's columns. Rows with a NULL key are kept as they are and replaced by
    nothing. Columns that a merge brings and the table lacks are added, those that it lacks are NULL in its rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], day: Column):
        self.spark, self.path, self.keys, self.day = spark, path.rstrip("/"), keys, day
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # the store

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self):
        return self._at(self.path).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._store().listStatus(at)] if self._store().exists(at) else []

    def version(self) -> int | None:
        """The number of the last version, None before the first."""
        found = [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json")]
        return max(found, default=None)

    def state(self, version: int | None = None) -> dict:
        """months (month -> commit), schema (JSON) and marks of a version, by default the last."""
        number = self.version() if version is None else version
        if number is None:
            return {"months": {}, "schema": None, "marks": {}}
        stream = self._store().open(self._at(f"{self.path}/versions/{number:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, state: dict) -> None:
        draft = f"{self.path}/versions/.draft-{uuid.uuid4().hex}"
        out = self._store().create(self._at(draft), True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self._conf)
        try:
            context.rename(self._at(draft), self._at(f"{self.path}/versions/{number:010d}.json"), options)
        except Py4JJavaError as error:
            self._store().delete(self._at(draft), False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.path} is another writer's") from error
            raise

    # rows

    def month(self) -> Column:
        return F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit(NO_MONTH))

    def read(self, version: int | None = None, months: list[str] | None = None, with_month: bool = False) -> DataFrame:
        """The rows of a version, by default the last one now; later merges don't change the frame.

        months: these only; a filter on ``month`` (with with_month) prunes folders as well.
        """
        return self._rows(self.state(version), months, with_month)

    def _rows(self, state: dict, months: list[str] | None = None, with_month: bool = False) -> DataFrame:
        if state["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        both = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("month", T.StringType())])
        folders = [f"{self.path}/rows/commit={c}/month={m}" for m, c in sorted(state["months"].items()) if months is None or m in months]
        rows = self.spark.read.schema(both).option("basePath", f"{self.path}/rows").parquet(*folders) if folders else self.spark.createDataFrame([], both)
        return rows if with_month else rows.select(*schema.names)

    def _write(self, rows: DataFrame, months: list[str]) -> dict[str, str]:
        """A new commit of these rows; month -> commit of the months that have any."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/rows/commit={commit}"
        # an exchange by month whose large parts are split and small ones joined, by size
        rows.withColumn("month", self.month()).hint("rebalance", "month").write.option("compression", "zstd").partitionBy("month").parquet(folder)
        return {m: commit for m in months if self._store().exists(self._at(f"{folder}/month={m}"))}

    def create(self, rows: DataFrame, marks: dict | None = None) -> int:
        """The first version."""
        months = [r.month for r in rows.select(self.month().alias("month")).distinct().collect()]
        self._publish(0, {"months": self._write(rows, months), "schema": rows.schema.json(), "marks": marks or {}})
        return 0

    def merge(self, change: DataFrame | None, delete: DataFrame | None = None, marks: dict | None = None, within: list[str] | None = None, attempts: int = 5) -> int:
        """The number of a new version, in which rows of change replace those of their keys and keys of delete are gone.

        change has whole rows, one for a key at most. A replaced row's month is found by a pass over the keys alone; if it
        is known to lie in some months, ``within`` names them. Months that neither lose nor get a row keep their files.
        marks: values to keep with the version, over those of the last. A lost race is run again from the winner's version.
        """
        for turn in range(attempts):
            try:
                return self._merge(change, delete, marks or {}, within)
            except Conflict:
                if turn == attempts - 1:
                    raise
        raise ValueError("attempts has to be above 0")

    def _merge(self, change: DataFrame | None, delete: DataFrame | None, marks: dict, within: list[str] | None) -> int:
        number = self.version()
        if number is None:
            raise ValueError(f"{self.path} has no version yet")
        state = self.state(number)
        own = change.persist() if change is not None else None
        try:
            gone = [x.select(*self.keys) for x in (own, delete) if x is not None]
            if not gone:
                raise ValueError("nothing to merge")
            gone = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
            gone = gone.distinct()
            held = self._rows(state, within, with_month=True).select(*self.keys, "month")
            touched = {r.month for r in held.join(gone, self.keys, "left_semi").select("month").distinct().collect()}
            if own is not None:
                touched |= {r.month for r in own.select(self.month().alias("month")).distinct().collect()}
            rows = self._rows(state, sorted(touched)).join(gone, self.keys, "left_anti")
            if own is not None:
                rows = rows.unionByName(own, allowMissingColumns=True)
            months = {m: c for m, c in state["months"].items() if m not in touched}
            if touched:
                months |= self._write(rows, sorted(touched))
            self._publish(number + 1, {"months": months, "schema": rows.schema.json(), "marks": {**state["marks"], **marks}})
            return number + 1
        finally:
            if own is not None:
                own.unpersist()

    def expire(self, keep: int = 2) -> list[str]:
        """Delete what only versions before the last ``keep`` name: their files and the folders of months. Returns these.

        Folders of merges under way aren't named by any version and stay.
        """
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))
        folders = lambda n: {f"{self.path}/rows/commit={c}/month={m}" for m, c in self.state(n)["months"].items()}
        old, new = numbers[:-keep], numbers[-keep:]
        stay = set().union(*(folders(n) for n in new)) if new else set()
        gone = sorted(set().union(*(folders(n) for n in old)) - stay) if old else []
        for folder in gone:
            self._store().delete(self._at(folder), True)
        for n in old:
            self._store().delete(self._at(f"{self.path}/versions/{n:010d}.json"), False)
        return gone
