"""Incremental intake: processed sequence numbers kept as disjoint intervals, committed together with the output.

A sequence number is the time of arrival in microseconds. An interval (lo, hi] holds lo < n <= hi; lo None is open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.times import DAY, micros

Interval = tuple[int | None, int]


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Disjoint, sorted intervals that cover the same numbers; touching ones become one."""
    out: list[Interval] = []
    for lo, hi in sorted(intervals, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        if lo is not None and hi <= lo:
            continue
        if out and (lo is None or lo <= out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def subtract(available: Interval, done: list[Interval]) -> list[Interval]:
    """The gaps of available that done, disjoint and sorted, leaves."""
    lo, hi = available
    out: list[Interval] = []
    for a, b in done:
        if a is not None and (lo is None or a > lo):
            if a >= hi:
                break
            out.append((lo, a))
        lo = b if lo is None or b > lo else lo
        if lo >= hi:
            return out
    if lo is None or lo < hi:
        out.append((lo, hi))
    return out

def day_of(number: Column) -> Column:
    """The day of a number of microseconds, rounded down before 1970 too."""
    return ((number - F.pmod(number, F.lit(DAY))) / F.lit(DAY)).cast("long")


OPEN = "day long, lo long, hi long"


def islands(numbers: DataFrame) -> DataFrame:
    """(day, lo, hi): the numbers (one column n, distinct) as disjoint intervals, cut at the ends of days.

    Cutting keeps every group to one day, so that however many numbers are open, no task merges them all.
    """
    w = Window.partitionBy("day").orderBy("n")
    runs = numbers.where("n is not null").select("n", day_of(F.col("n")).alias("day")).withColumn("__r", F.col("n") - F.row_number().over(w))
    return runs.groupBy("day", "__r").agg((F.min("n") - 1).alias("lo"), F.max("n").alias("hi")).select("day", "lo", "hi")


def merged_days(intervals: DataFrame) -> DataFrame:
    """(day, lo, hi) of intervals (day, lo, hi) that don't overlap, with touching ones of a day made one."""
    w = Window.partitionBy("day").orderBy("lo")
    cut = intervals.withColumn("__cut", (~F.col("lo").eqNullSafe(F.lag("hi").over(w))).cast("int")).withColumn("__g", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("day", "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("day", "lo", "hi")


class Ledger:
    """Processed numbers of one source, as numbered commits under path.

    All numbers up to `complete` are done, and so are those in the open intervals above it, a table (day, lo, hi] beside the
    commit, as a source may show a number before lower ones. A run writes its output to a folder of its own and commits;
    only then do its numbers count as done. A run that fails before has changed nothing, and the next one takes the same
    rows, with what came late. A commit holds its own output's folder, so its size doesn't grow with the commits before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _last(self) -> dict:
        last = storage.newest(self.spark, self.path)
        return last[1] if last else {"n": 0, "complete": None, "open": None}

    def complete(self) -> int | None:
        return self._last()["complete"]

    def open(self) -> DataFrame:
        """(day, lo, hi): the done intervals above complete()."""
        path = self._last()["open"]
        return self.spark.read.schema(OPEN).parquet(path) if path else self.spark.createDataFrame([], OPEN)

    def pending(self, rows: DataFrame, number: Column) -> DataFrame:
        """The rows whose number isn't done: the gaps, however they came about. Rows without a number are left out."""
        out = rows.withColumn("__n", number).where("__n is not null")
        if self.complete() is not None:
            out = out.where(F.col("__n") > self.complete())
        if self._last()["open"]:
            done = self.open().toDF("__day", "__lo", "__hi")
            out = out.join(done, (day_of(F.col("__n")) == F.col("__day")) & (F.col("__n") > F.col("__lo")) & (F.col("__n") <= F.col("__hi")), "left_anti")
        return out

    def commit(self, seen: DataFrame, complete: int | None = None, output: str | None = None, after: int | None = None) -> None:
        """Add the numbers seen (n) to what is done, and all up to complete. FileExistsError: another run committed first.

        after: the commit that the run saw when it began, if it isn't to be the last one now.
        """
        last = self._last()
        n = (last["n"] if after is None else after) + 1
        complete = max((c for c in (complete, last["complete"]) if c is not None), default=None)
        rest = merged_days(islands(seen.select("n").distinct()).unionByName(self.open()))
        if complete is not None:
            rest = rest.where(F.col("hi") > complete).withColumn("lo", F.greatest("lo", F.lit(complete)))
        at = f"{self.path}/open-{n}-{uuid.uuid4().hex[:8]}"
        rest.write.parquet(at)
        storage.commit_json(self.spark, storage.manifest_path(self.path, n), {"n": n, "complete": complete, "open": at, "output": output})
        if last["open"] and last["n"] == n - 1:
            storage.remove(self.spark, last["open"])

    def outputs(self) -> list[str]:
        """Folders of committed output; what a failed run left elsewhere isn't read."""
        found = (storage.read_json(self.spark, storage.manifest_path(self.path, n))["output"] for n in storage.manifests(self.spark, self.path))
        return [p for p in found if p]


def take(spark: SparkSession, ledger: Ledger, rows: DataFrame, arrival: str, up_to: int, output: str, complete: int | None = None) -> DataFrame:
    """One run: write the rows that arrived by up_to (microseconds) and aren't done, then commit their numbers; returns them.

    Only numbers that were really seen become done, and those up to complete, below which the source promises to show no
    more. A row that shows up after a commit, with whatever arrival above complete, is taken by the next run, and no row is
    taken twice; but rows of equal arrival must show up together. Rows without an arrival are left out.
    """
    began = ledger._last()["n"]
    ledger.pending(rows, micros(rows, arrival)).where(F.col("__n") <= up_to).withColumnRenamed("__n", "__number").write.mode("overwrite").parquet(output)
    out = spark.read.parquet(output)
    ledger.commit(out.select(F.col("__number").alias("n")), complete, output, began)
    return out.drop("__number")


def assign_intervals(runs: DataFrame) -> DataFrame:
    """(coll, lo, hi, run_id) of a log of runs (run_id, coll, readUpTo, outcome): the disjoint intervals each run took.

    Runs are taken in the order of run_id; only outcome `ok` commits. A run may take all that arrived up to its readUpTo;
    subtracted is what earlier runs of its collection took, whose merged intervals reach up to the greatest readUpTo
    before it, so a running maximum holds them. lo is null where nothing was taken before. A repeated run counts once, with
    its greatest readUpTo; rows with a null coll, run_id or readUpTo read nothing. No row of the log reaches the driver.
    """
    ok = runs.where((F.col("outcome") == "ok") & F.col("coll").isNotNull() & F.col("run_id").isNotNull() & F.col("readUpTo").isNotNull())
    log = ok.groupBy("coll", "run_id").agg(F.max(micros(runs, "readUpTo")).alias("hi")).where("hi is not null")
    before = F.max("hi").over(Window.partitionBy("coll").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("lo", before).where("lo is null or hi > lo").select("coll", "lo", "hi", "run_id")


def locate(spark: SparkSession, records: DataFrame, arrival: str, taken: DataFrame) -> DataFrame:
    """records (with coll) joined to the run whose interval of taken (coll, lo, hi, run_id) holds their arrival; others are left out.

    Intervals are spread over the days they meet, so the join is on (coll, day) with the bounds as a residual: every
    record meets only the few intervals of its own day. The plan, a row per run and day, is written first, so that Spark
    knows its size: up to its threshold it broadcasts it, and records, however skewed by day, aren't shuffled. Arrivals
    before the first bound use the day of that bound, of which the driver gets one a collection.
    """
    days = taken.select(F.col("coll").alias("__coll"), F.explode(F.sequence(day_of(F.coalesce("lo", "hi")), day_of(F.col("hi")))).alias("__day"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "run_id")
    plan = storage.materialize(days, storage.workspace(spark, "runs"))
    floor = F.lit(None).cast("long")
    for coll, day in plan.groupBy("__coll").agg(F.min("__day")).collect():
        floor = F.when(F.col("coll") == coll, F.lit(day)).otherwise(floor)
    keyed = records.withColumn("__at", micros(records, arrival)).withColumn("__on", F.greatest(day_of(F.col("__at")), floor))
    on = (F.col("coll") == F.col("__coll")) & (F.col("__on") == F.col("__day")) & (F.col("__at") <= F.col("__hi")) & (F.col("__lo").isNull() | (F.col("__at") > F.col("__lo")))
    return keyed.where("__at is not null").join(plan, on).drop("__coll", "__day", "__lo", "__hi", "__at", "__on")


def arrivals(rows: DataFrame, coll: str) -> DataFrame:
    """Distinct records of one collection: (coll, rec_id, timeModified) with the earliest arrival; null equals null."""
    return rows.groupBy(F.lit(coll).alias("coll"), F.col("_id").alias("rec_id"), "timeModified").agg(F.min("arrivedAt").alias("arrivedAt"))
