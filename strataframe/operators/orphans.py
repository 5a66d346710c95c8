"""Orphan references, kept up to date as keyed state: a parent index, waiting references and resolved references.

Each batch does three things. New references probe the parent index; those without a parent wait. Arriving parents
resolve the references that wait for their key. Removed parents reopen the references that were resolved through them.

State is a log by bucket of the key: a batch reads the buckets that its own keys fall in, appends what changed there, and
rewrites a bucket only when it has many appended pieces. Counts are carried on from the changes of each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe import storage

#: (field, key, row_key, period, at): field names a referring column, at is the arrival in microseconds or null
REFERENCES = "field string, key string, row_key string, period string, at long"
#: (field, key, op, at). `present`: the parent exists; `seen`: it was heard of; `tombstone`: it was deleted, which a
#: `present` overrules; `remove`: it exists no longer, whatever came before
PARENTS = "field string, key string, op string, at long"
OPS = ("present", "seen", "tombstone", "remove")
#: of each key the last put and removal so far, whether it was ever deleted, and its first arrival; pieces are merged on reading
_INDEX = "field string, key string, put long, removed long, dead boolean, first_at long"
#: of each reference its reasons in turn: the last step counts; a null reason in the waiting log says that it waits no more
_STATE = REFERENCES + ", step long, late boolean, reason string"
_COUNTS = "field string, period string, reason string, n long"
KINDS = ("waiting", "resolved")
BUCKET, KIND = "__bucket", "__kind"
_NEVER = -(2**62)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_REF = _names(REFERENCES)


def _merged(index: DataFrame) -> DataFrame:
    return index.groupBy("field", "key").agg(F.max("put").alias("put"), F.max("removed").alias("removed"), F.bool_or("dead").alias("dead"), F.min("first_at").alias("first_at"))


def _present() -> Column:
    return F.coalesce(F.col("put").isNotNull() & (F.col("removed").isNull() | (F.col("put") > F.col("removed"))), F.lit(False))


class OrphanTracker:
    """Pending-orphan state under path, advanced by apply() batch by batch and committed by a manifest each.

    A tracker on a path that has state goes on from the last committed batch; what a failed batch left is overwritten.

    A reference is an orphan with reason `missing` or `deleted` while its parent isn't present, and with reason `late`
    for good if the parent first became known only after the reference arrived (references without an arrival, or
    parents without one, are never late). A parent deleted and present is present. Null and empty keys are no
    references. Equal references count once; keys compare exactly; extra columns are ignored.

    buckets: with many more of them than a batch has keys, a batch reads and writes little of the state. pieces: how many
    appended pieces of a bucket are read before they are rewritten as one. Folders that no live manifest names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, pieces: int = 8):
        self.spark, self.path, self.step, self.pieces = spark, path.rstrip("/"), 0, pieces
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._logs: dict[str, dict[int, list[str]]] = {"index": {}, "waiting": {}, "resolved": {}}
        self._counts: str | None = None
        last = storage.newest(spark, f"{self.path}/manifests")
        if last:
            self.step, self.buckets, self._counts = last[1]["step"], last[1]["buckets"], last[1]["counts"]
            self._logs = {k: {int(b): p for b, p in last[1][k].items()} for k in self._logs}

    def _bucket(self) -> Column:
        return F.pmod(F.hash("field", "key"), F.lit(self.buckets)).alias(BUCKET)

    def _read(self, schema: str, log: str, only: set[int] | None = None) -> DataFrame:
        paths = [p for b, ps in self._logs[log].items() if only is None or b in only for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, folder: str) -> dict[int, str]:
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in storage.list_names(self.spark, folder) if n.startswith(f"{BUCKET}=")}

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        """By bucket, in tasks that adaptive execution levels: small buckets share a task, a hot one is split."""
        df.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET, *by).write.mode("overwrite").partitionBy(*by, BUCKET).parquet(folder)

    def _last(self, log: str, only: set[int] | None = None) -> DataFrame:
        """The references of a log by their last step; those that wait no more are left out of the waiting ones."""
        rows = self._read(_STATE, log, only).groupBy(*_REF).agg(F.max(F.struct("step", "late", "reason")).alias("x")).select(*_REF, "x.late", "x.reason")
        return rows.where("reason is not null") if log == "waiting" else rows

    def apply(self, references: DataFrame, parents: DataFrame) -> DataFrame:
        """One batch; returns the counts of orphans after it: (step, field, period, reason, n)."""
        spark, step = self.spark, self.step + 1
        at = f"{self.path}/step-{step}"
        storage.remove(spark, at)
        when = F.coalesce("at", F.lit(_NEVER))
        known = parents.select("field", "key", "op", "at").where(F.col("key").isNotNull() & F.col("op").isin(*OPS))
        pieces = known.groupBy("field", "key").agg(
            F.max(F.when(F.col("op") == "present", when)).alias("put"),
            F.max(F.when(F.col("op") == "remove", when)).alias("removed"),
            F.bool_or(F.col("op").isin("tombstone", "remove")).alias("dead"),
            F.min("at").alias("first_at"),
        )
        # one row a key and hashed by it, so it is written as it is
        pieces.withColumn(BUCKET, self._bucket()).write.partitionBy(BUCKET).parquet(f"{at}/index")
        delta = self._written(f"{at}/index")
        new = references.select(*_REF).where("key is not null and key <> ''")
        touched = set(delta)
        if any(self._logs.values()):
            touched |= {r[0] for r in new.select(self._bucket()).distinct().collect()}  # at most one row a bucket

        own = spark.read.schema(_INDEX).parquet(*delta.values()) if delta else spark.createDataFrame([], _INDEX)
        before = self._read(_INDEX, "index", touched)
        index = _merged(before.unionByName(own))
        none, no = F.lit(None).cast("string"), F.lit(False)
        refs = new.select(*_REF, F.lit(None).cast("long").alias("step"), no.alias("late"), none.alias("reason"))
        if any(b in self._logs["waiting"] for b in touched):
            refs = refs.unionByName(self._read(_STATE, "waiting", touched))
        if delta and any(b in self._logs["resolved"] for b in touched):
            # resolved ones are looked at again where their parent was removed, or its first arrival became known
            old = _merged(before).where(_present()).select("field", "key", F.col("first_at").alias("o_first"))
            moved = own.where("removed is not null or first_at is not null").join(old, ["field", "key"]).where("removed is not null or o_first is null or first_at < o_first").select("field", "key")
            refs = refs.unionByName(self._read(_STATE, "resolved", touched).join(moved, ["field", "key"], "left_semi").withColumn("step", F.lit(-1).cast("long")))
        # a reference may come twice, or wait or be resolved by now and come again
        last = F.max(F.when(F.col("step") >= 0, F.struct("step", "late", "reason")))
        refs = refs.groupBy(*_REF).agg(last.alias("x"), F.bool_or(F.col("step").isNull()).alias("new"), F.bool_or(F.coalesce(F.col("step") == -1, no)).alias("again"))
        refs = refs.select(*_REF, F.coalesce("x.late", no).alias("late"), F.col("x.reason").alias("was"), "new", "again").where("new or again or was is not null")
        # a parent that isn't known yet, or is known but not present, may still turn out to be late
        probed = refs.join(index, ["field", "key"], "left").withColumn("late", F.col("late") | F.coalesce(F.col("first_at") > F.col("at"), no))
        open_ = ~_present()
        reason = F.when(open_ & F.coalesce("dead", no), F.lit("deleted")).when(open_, F.lit("missing")).when(F.col("late"), F.lit("late"))
        told = probed.withColumn("reason", reason).where((F.col("new") & F.col("was").isNull()) | ~F.col("was").eqNullSafe(F.col("reason")))
        waits = F.when(F.col("reason").isNotNull() | F.col("was").isNotNull(), F.struct(F.lit("waiting").alias(KIND), "was"))
        rests = F.when(F.col("reason").isNull(), F.struct(F.lit("resolved").alias(KIND), none.alias("was")))
        kinds = F.filter(F.array(waits, rests), lambda x: x.isNotNull())
        state = told.select(*_REF, F.lit(step).cast("long").alias("step"), "late", "reason", F.explode(kinds).alias("x")).select(*_names(_STATE), "x.*")
        self._write(state, f"{at}/state", KIND)
        logs = {k: {b: list(p) for b, p in v.items()} for k, v in self._logs.items()}
        for log, written in (("index", delta), *((k, self._written(f"{at}/state/{KIND}={k}")) for k in KINDS)):
            for b, p in written.items():
                logs[log].setdefault(b, []).append(p)
        self._logs, kept = logs, self._logs
        try:
            self._compact(at)
            counts = self._count(at, step)
            storage.commit_json(spark, storage.manifest_path(f"{self.path}/manifests", step), {"step": step, "buckets": self.buckets, "counts": f"{at}/counts", **self._logs})
        except BaseException:
            self._logs = kept
            raise
        self.step, self._counts = step, f"{at}/counts"
        self._vacuum()
        return counts.select(F.lit(step).alias("step"), *_names(_COUNTS))

    def _count(self, at: str, step: int) -> DataFrame:
        """The counts before, changed by what the batch changed."""
        there = any(n.startswith(KIND) for n in storage.list_names(self.spark, f"{at}/state"))
        told = self.spark.read.schema(_STATE + ", was string").parquet(f"{at}/state") if there else self.spark.createDataFrame([], _STATE + ", was string")
        change = lambda c, n: F.struct(F.col(c).alias("reason"), F.lit(n).cast("long").alias("n"))
        moved = told.select("field", "period", F.explode(F.array(change("was", -1), change("reason", 1))).alias("x")).select("field", "period", "x.*").where("reason is not null")
        if self._counts:
            moved = moved.unionByName(self.spark.read.schema(_COUNTS).parquet(self._counts))
        moved = moved.groupBy("field", "period", "reason").agg(F.sum("n").alias("n"))
        return storage.materialize(moved.where("n <> 0").coalesce(1), f"{at}/counts")

    def _compact(self, at: str) -> None:
        """Rewrite the buckets with many pieces as one each."""
        for log, schema in (("index", _INDEX), ("waiting", _STATE), ("resolved", _STATE)):
            many = {b for b, p in self._logs[log].items() if len(p) > self.pieces}
            if not many:
                continue
            if log == "index":
                rows = _merged(self._read(schema, log, many))
            else:
                rows = self._last(log, many).select(*_REF, F.lit(self.step + 1).cast("long").alias("step"), "late", "reason")
            self._write(rows, f"{at}/{log}-merged")
            written = self._written(f"{at}/{log}-merged")
            for b in many:
                self._logs[log].pop(b)
                if b in written:
                    self._logs[log][b] = [written[b]]

    def _vacuum(self) -> None:
        """Remove older manifests, and folders and files that the newest one doesn't name."""
        for n in storage.manifests(self.spark, f"{self.path}/manifests")[:-1]:
            storage.remove(self.spark, storage.manifest_path(f"{self.path}/manifests", n))
        live = {p for log in self._logs.values() for ps in log.values() for p in ps} | {self._counts}
        for step in storage.list_names(self.spark, self.path):
            if step.startswith("step-") and not any(p.startswith(f"{self.path}/{step}/") for p in live):
                storage.remove(self.spark, f"{self.path}/{step}")

    def report(self) -> DataFrame:
        """(field, key, row_key, period, reason) of all references that are orphans now."""
        return self._last("waiting").select("field", "key", "row_key", "period", "reason")

    def counts(self) -> DataFrame:
        """(field, period, reason, n) of the orphans now, as the last batch left them."""
        return self.spark.read.schema(_COUNTS).parquet(self._counts) if self._counts else self.spark.createDataFrame([], _COUNTS)
