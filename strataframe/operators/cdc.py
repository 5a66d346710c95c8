"""Applying feeds of inserts, updates and deletes: a bucketed copy-on-write table with committed manifests.

State: one row per key, its last change. Deleted keys stay as tombstones, so that an older change which arrives later
can't bring a key back. A feed only rewrites the buckets it touches; every other bucket keeps the files it had.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataframe import storage
from strataframe.functions.times import micros

DELETED = 2
BUCKET = "__bucket"


def last_change(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: that with the greatest values of order, compared in turn; a null is below any value.

    Rows with a null key belong to no entity and are left out; of rows that are equal in all of order any one is kept,
    as repeated deliveries are. The rank limit runs before the shuffle too, so a hot key sends one row per map task.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in order])
    return changes.where(F.col(f"`{key}`").isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


class BucketedTable:
    """Copy-on-write table under path: data files by version and bucket, and manifests that name the live ones.

    Files hold one bucket each, by the hash that Spark's own bucketing and shuffles use, sorted by key. A feed is routed to
    the buckets by a shuffle of its own rows; the base's files of the touched buckets are read as they lie and merged with
    it, sorted side by side, so that the base is never shuffled. What is written replaces those files in the next manifest.

    The table has the columns of its first feed; a later feed may lack some (they are null) but must have key, status
    and order. Columns whose names start with two underscores are reserved.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "referenceId", order: Sequence[str] = ("timeModified", "_id"), status: str = "status", buckets: int | None = None):
        self.spark, self.path, self.key, self.order, self.status = spark, path.rstrip("/"), key, list(order), status
        self._buckets = buckets

    def manifest(self) -> dict:
        """The newest committed manifest; an empty one before the first commit."""
        last = storage.newest(self.spark, f"{self.path}/manifests")
        if last:
            return last[1]
        return {"version": 0, "buckets": self._buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "files": {}, "feeds": [], "streams": {}, "schema": None}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.hash(F.col(f"`{self.key}`")), F.lit(buckets))

    def apply(self, feed: DataFrame, feed_id: str, number: int | None = None) -> dict:
        """Apply one feed and commit. A feed_id that is already committed changes nothing, so a retried run is safe.

        With a number feed_id names a stream of feeds, of which those up to the last committed number change nothing;
        the manifest then holds one number a stream, however many feeds there were. Order within and between feeds
        doesn't matter: the last change by order wins whenever it comes.
        """
        old = self.manifest()
        if feed_id in old["feeds"] if number is None else number <= old["streams"].get(feed_id, -1):
            return old
        known = {"feeds": [*old["feeds"], feed_id]} if number is None else {"streams": old["streams"] | {feed_id: number}}
        buckets, version = old["buckets"], old["version"] + 1
        schema = StructType.fromJson(old["schema"]) if old["schema"] else feed.schema
        feed = feed.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in feed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        rows = last_change(feed, self.key, self.order)
        touched: set[str] = set()
        if old["files"]:  # with no base there is nothing to route around
            touched = {str(r[0]) for r in feed.where(F.col(f"`{self.key}`").isNotNull()).select(self._bucket(buckets)).distinct().collect()}  # at most one row a bucket
            paths = [p for b, ps in old["files"].items() if b in touched for p in ps]
            if paths:
                rows = self._merged(bucketed(self.spark, paths, schema, self.key, buckets), rows)
        target = f"{self.path}/data/v{version}"
        storage.remove(self.spark, target)  # what an attempt that never committed left
        written = write_bucketed(rows, target, self.key, buckets)
        files = {b: ps for b, ps in old["files"].items() if b not in touched} | written
        new = old | {"version": version, "files": files, "schema": schema.jsonValue()} | known
        storage.commit_json(self.spark, storage.manifest_path(f"{self.path}/manifests", version), new)
        return new

    def _merged(self, base: DataFrame, feed: DataFrame) -> DataFrame:
        """Both, one row a key: of two rows the later by order, a null being below any value."""
        whole = lambda df, name: df.select(F.col(f"`{self.key}`").alias(f"__{name}_key"), F.struct(*[F.col(f"`{c}`") for c in self.order]).alias(f"__{name}_at"), F.struct("*").alias(f"__{name}"))
        both = whole(base, "old").join(whole(feed, "new"), F.col("__old_key") == F.col("__new_key"), "full_outer")
        kept = F.col("__new").isNull() | F.coalesce(F.col("__old_at") >= F.col("__new_at"), F.lit(False))
        return both.select(F.when(kept, F.col("__old")).otherwise(F.col("__new")).alias("x")).select("x.*")

    def vacuum(self) -> None:
        """Delete data files that the newest manifest doesn't name, and older manifests."""
        for n in storage.manifests(self.spark, f"{self.path}/manifests")[:-1]:
            storage.remove(self.spark, storage.manifest_path(f"{self.path}/manifests", n))
        named = {p for ps in self.manifest()["files"].values() for p in ps}
        live = {p.rpartition("/")[0] for p in named}
        for v in storage.list_names(self.spark, f"{self.path}/data"):
            folder = f"{self.path}/data/{v}"
            if folder not in live:
                storage.remove(self.spark, folder)
            else:
                for n in storage.list_names(self.spark, folder):
                    if _FILE.search(n) and f"{folder}/{n}" not in named:
                        storage.remove(self.spark, f"{folder}/{n}")

    def current(self, with_deleted: bool = False) -> DataFrame | None:
        """The rows that exist after all committed feeds; None before the first commit."""
        manifest = self.manifest()
        if not manifest["schema"]:
            return None
        schema, paths = StructType.fromJson(manifest["schema"]), [p for ps in manifest["files"].values() for p in ps]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows if with_deleted else rows.where(~F.col(f"`{self.status}`").eqNullSafe(DELETED))


#: the bucket in the name of a file that Spark writes for a bucketed table
_FILE = re.compile(r"_(\d+)\.c\d+")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, list[str]]:
    """Write df to path by Spark's bucketing, sorted by key; the files by bucket.

    Only the catalog's writer makes buckets, so a table is named there for as long as it writes.
    """
    spark = df.sparkSession
    name = f"strataframe_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"drop table if exists {name}")
    out: dict[str, list[str]] = {}
    for n in storage.list_names(spark, path):
        if (m := _FILE.search(n)) and not n.startswith("."):
            out.setdefault(str(int(m.group(1))), []).append(f"{path}/{n}")
    return out


def bucketed(spark: SparkSession, paths: list[str], schema: StructType, key: str, buckets: int) -> DataFrame:
    """The files of some buckets as a relation that Spark knows to be hashed by key, so that joins on it need no shuffle.

    A catalog table would be one folder with all of its files; a relation over chosen files is made of Spark's own parts.
    """
    jvm, session = spark._jvm, spark._jsparkSession
    seq = lambda xs: jvm.org.apache.spark.api.python.PythonUtils.toSeq(_java_list(jvm, xs))
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq([key]), seq([key]))
    options = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(jvm.java.util.HashMap())
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())
    source = jvm.org.apache.spark.sql.execution.datasources.DataSource(session, "parquet", seq(paths), jvm.scala.Some(kind), seq([]), jvm.scala.Some(spec), options, none)
    return DataFrame(session.baseRelationToDataFrame(source.resolveRelation(True, True)), spark)


def _java_list(jvm, xs: list):
    out = jvm.java.util.ArrayList()
    for x in xs:
        out.add(x)
    return out


def replay(spark: SparkSession, log: DataFrame, path: str, feeds: int = 2, arrival: str = "arrivedAt", **options) -> BucketedTable:
    """Apply a change log to an empty table in feeds slices of its time of arrival (rows without one in the first)."""
    out = BucketedTable(spark, path, **options)
    at = micros(log, arrival)
    lo, hi = log.select(F.min(at), F.max(at)).first()
    n = feeds if lo is not None and hi > lo else 1
    k = F.coalesce(F.least(F.lit(n - 1), F.floor((at - F.lit(lo)) * n / F.lit(hi - lo + 1))), F.lit(0)) if n > 1 else F.lit(0)
    for i in range(n):
        out.apply(log.where(k == i) if n > 1 else log, f"slice-{i}")
        out.vacuum()
    return out
