"""Validity periods of changing entities by differencing consecutive snapshots.

Every version of an entity makes a snapshot of it, at the version's time; an entity that is deleted is absent from that
snapshot. Consecutive snapshots are compared by a null-safe full outer join, which classifies keys as inserted, changed
or deleted, the latter where the next snapshot lacks them; the change events are united and closed by lead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.times import micros

DELETED = 2
#: blocks that the versions of a hot entity are cut into
BLOCKS = 256


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], attributes: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key..., change, attributes and carry of the new row, null if deleted) between two snapshots with one row per key.

    A null-safe full outer join: a null key part equals a null one, and nulls in attributes equal only nulls. A key that
    only new has is `inserted`, one that only old has `deleted`, one with other attributes `changed`; unchanged keys have
    no row. carry: columns of new that aren't compared. Extra columns are ignored.
    """
    def side(df: DataFrame, p: str, more: Sequence[str]) -> DataFrame:
        names = [*[(c, f"{p}{i}") for i, c in enumerate(key)], *[(c, f"{p}a{i}") for i, c in enumerate(attributes)], *[(c, f"{p}c{i}") for i, c in enumerate(more)]]
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names], F.lit(True).alias(f"{p}here"))

    a, b = side(old, "o", ()), side(new, "n", carry)
    on, same = F.lit(True), F.lit(True)
    for i in range(len(key)):
        on = on & F.col(f"o{i}").eqNullSafe(F.col(f"n{i}"))
    for i in range(len(attributes)):
        same = same & F.col(f"oa{i}").eqNullSafe(F.col(f"na{i}"))
    change = F.when(F.col("ohere").isNull(), F.lit("inserted")).when(F.col("nhere").isNull(), F.lit("deleted")).when(~same, F.lit("changed"))
    diff = a.join(b, on, "full_outer").withColumn("__change", change).where("__change is not null")
    keys = [F.when(F.col("nhere").isNotNull(), F.col(f"n{i}")).otherwise(F.col(f"o{i}")).alias(c) for i, c in enumerate(key)]
    return diff.select(*keys, F.col("__change").alias("change"), *[F.col(f"na{i}").alias(c) for i, c in enumerate(attributes)], *[F.col(f"nc{i}").alias(c) for i, c in enumerate(carry)])


def _blocks(keyed: DataFrame, hot: int) -> DataFrame | None:
    """(hk, cuts): the quantiles of the times of entities with more than hot versions; None where there are none.

    There is at most one row per hot versions. It is written, so that Spark knows its size and broadcasts it only if small.
    """
    spark = keyed.sparkSession
    many = storage.materialize(keyed.groupBy(F.col("k").alias("hk")).agg(F.count("*").alias("n")).where(F.col("n") > hot).select("hk"), storage.workspace(spark, "hot"))
    if many.isEmpty():
        return None
    cuts = F.array_distinct(F.percentile_approx("t", [i / BLOCKS for i in range(1, BLOCKS)], 10_000)).alias("cuts")
    return storage.materialize(keyed.join(many, F.col("k") == F.col("hk")).groupBy("hk").agg(cuts), storage.workspace(spark, "cuts"))


def _next_block(rows: DataFrame, first: str) -> DataFrame:
    """(nk, nb, b1, t1): for each block of a hot entity the next one that has rows, and its first time."""
    firsts = rows.where("hot").groupBy("k", "b").agg(F.min(first).alias("t0"))
    after = F.lead(F.struct("b", "t0")).over(Window.partitionBy("k").orderBy("b"))  # at most BLOCKS rows an entity
    return firsts.withColumn("x", after).select(F.col("k").alias("nk"), F.col("b").alias("nb"), F.col("x.b").alias("b1"), F.col("x.t0").alias("t1"))


def validity(log: DataFrame, key: str = "referenceId", time: str = "timeModified", version: str = "_id", status: str = "status", attributes: Sequence[str] = ("title", "description", "facetId", "groupId", "sortKey", "flags"), hot: int = 1_000_000) -> DataFrame:
    """(key, valid_from, valid_to, change, attributes) of every period, in microseconds since 1970 UTC.

    valid_to is exclusive and null if the period still lasts; change is `inserted` or `changed`. Versions are ordered by
    time, then version; of those with equal time only the last counts. Rows with a null key or time have no place in
    the order and are left out; a null status isn't a deletion; a null version is below any other. Attributes are
    compared null-safely. Repeated rows and repeated changes without a difference start no period.
    hot: an entity with more versions is cut into blocks of time, so that no task sorts all of it; it changes the work per
    task, never the result. The older side of the join is a digest of the attributes, the newer one carries them.
    """
    names = [f"a{i}" for i in range(len(attributes))]
    digest = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{a}`").alias(n) for a, n in zip(attributes, names)]), {"ignoreNullFields": "false"}), 256)), 1, 16)
    gone = F.coalesce(F.col(f"`{status}`") == DELETED, F.lit(False))
    keyed = log.select(F.col(f"`{key}`").alias("k"), micros(log, time).alias("t"), F.col(f"`{version}`").alias("id"), gone.alias("gone"), digest.alias("d"), *[F.col(f"`{a}`").alias(n) for a, n in zip(attributes, names)]).where("k is not null and t is not null")
    cuts = _blocks(keyed, hot)
    part = ["k"] if cuts is None else ["k", "b"]
    if cuts is not None:
        block = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("t"))), F.lit(0))
        keyed = keyed.join(cuts, F.col("k") == F.col("hk"), "left").withColumn("b", F.when(F.col("hk").isNotNull(), block).otherwise(0)).withColumn("hot", F.col("hk").isNotNull()).drop("hk", "cuts")

    # one shuffle by entity and block: the last of equal times, and the time of the entity's next snapshot
    last = Window.partitionBy(*part, "t").orderBy(F.col("id").desc_nulls_last(), F.col("gone").desc(), F.col("d").desc())
    in_block = Window.partitionBy(*part).orderBy("t")
    rows = keyed.repartition(*part).withColumn("r", F.row_number().over(last)).where("r = 1").withColumn("t1", F.lead("t").over(in_block))
    rows = storage.materialize(rows.drop("r", "id"), storage.workspace(log.sparkSession, "versions"))
    if cuts is not None:
        after = _next_block(rows, "t").withColumnsRenamed({"b1": "b2", "t1": "t2"})
        rows = rows.join(after, (F.col("k") == F.col("nk")) & (F.col("b") == F.col("nb")), "left")
        rows = rows.withColumn("b1", F.when(F.col("t1").isNull(), F.col("b2")).otherwise(F.col("b"))).withColumn("t1", F.coalesce("t1", "t2")).drop("nk", "nb", "b2", "t2")

    # each snapshot, where the entity exists, as of the next one's time, against that one
    keys = ["k", "t"] if cuts is None else ["k", "t", "b", "hot"]
    old = rows.where("not gone and t1 is not null").drop("t").withColumnsRenamed({"t1": "t"} | ({} if cuts is None else {"b": "b0", "b1": "b"})).select(*keys, "d")
    new = rows.where("not gone").select(*keys, "d", *names)
    events = snapshot_diff(old, new, keys, ["d"], names)
    closed = events.withColumn("t1", F.lead("t").over(in_block))
    if cuts is not None:
        after = _next_block(events, "t").drop("b1").withColumnRenamed("t1", "t2")
        closed = closed.join(after, (F.col("k") == F.col("nk")) & (F.col("b") == F.col("nb")), "left").withColumn("t1", F.coalesce("t1", "t2"))
    spans = closed.where("change <> 'deleted'")
    return spans.select(F.col("k").alias(key), F.col("t").alias("valid_from"), F.col("t1").alias("valid_to"), "change", *[F.col(n).alias(a) for n, a in zip(names, attributes)])
