"""Frames of versioned collections: the last version of each item as of a time, or all that changed in an interval.

The total order of versions is timeModified, then _id. Filters on versions work before the last one is picked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.predicates import CREATED, DELETED, UPDATED, FrameFilter, part_types

PART_COLUMNS = ("_id", "itemId", "typeId", "roleId", "timeCreated", "creatorId", "timeModified", "userId", "content", "_status")


def latest(history: DataFrame) -> DataFrame:
    """The last version of each referenceId. The rank limit runs on the map side too, so hot keys stay small."""
    w = Window.partitionBy("referenceId").orderBy(F.col("timeModified").desc_nulls_last(), F.col("_id").desc_nulls_last())
    return history.where(F.col("referenceId").isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def adjusted(df: DataFrame) -> DataFrame:
    """_id becomes the entity's id, status becomes _status."""
    return df.select(F.col("referenceId").alias("_id"), *[F.col(c) for c in df.columns if c not in ("_id", "referenceId", "status", "arrivedAt")], F.col("status").alias("_status"))


def not_deleted(df: DataFrame, status: str = "_status") -> DataFrame:
    return df.where(~F.col(status).eqNullSafe(DELETED))


def parts_of(history_parts: DataFrame, f: FrameFilter, incremental: bool = False, with_deleted: bool = True) -> DataFrame:
    """The last versions of parts that pass the filter's time and types."""
    out = adjusted(latest(history_parts.where(f.until(incremental) & part_types(f.white_types, f.black_types))))
    return out if with_deleted else not_deleted(out)


def nest(items: DataFrame, parts: DataFrame) -> DataFrame:
    """items with _parts, their parts sorted by _id; an empty array where there are none. One row per item, always.

    An array is one value of one task, as whoever asks for nested parts wants them; where an item's parts may be more than
    a task holds, child_parts() has the same rows as a table of its own.
    """
    part = F.struct(*[F.col(c) for c in PART_COLUMNS if c in parts.columns])
    grouped = parts.groupBy(F.col("itemId").alias("__item")).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    empty = F.array().cast(grouped.schema["_parts"].dataType)
    return items.join(grouped, F.col("_id") == F.col("__item"), "left").drop("__item").withColumn("_parts", F.coalesce("_parts", empty))


def child_parts(items: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts of items as rows, without nesting: what nest() puts into _parts, for items of any number of parts."""
    kept = items.select(F.col("_id").alias("__item")).distinct()
    return parts.select(*[F.col(c) for c in PART_COLUMNS if c in parts.columns]).join(kept, F.col("itemId") == F.col("__item"), "left_semi")


def snapshot(history_items: DataFrame, f: FrameFilter, with_deleted: bool = True) -> DataFrame:
    """Each item's last version among those that match the filter and aren't after max_time; min_time plays no part.

    With a page, the rows of that page in the order of sortKey, then _id; deleted items are dropped after paging.
    """
    out = adjusted(latest(history_items.where(f.attributes() & f.until(False))))
    if f.page is not None:
        out = out.orderBy("sortKey", "_id").offset((f.page - 1) * f.page_size).limit(f.page_size)
    return out if with_deleted else not_deleted(out)


def incremental(history_items: DataFrame, history_parts: DataFrame, f: FrameFilter, part_date: bool = True, with_deleted: bool = True) -> DataFrame:
    """The last version of each item of which a matching version, or with part_date a matching part, changed in the interval.

    The last version may be later than the interval. An item that comes in by its parts only counts as updated where its
    last version says created.
    """
    own = history_items.where(f.attributes() & f.until(True)).select(F.col("referenceId").alias("k")).distinct()
    if part_date:
        by_parts = history_parts.where(f.until(True) & part_types(f.white_types, f.black_types)).select(F.col("itemId").alias("k")).distinct()
        keys = own.withColumn("own", F.lit(True)).unionByName(by_parts.withColumn("own", F.lit(False))).groupBy("k").agg(F.bool_or("own").alias("own"))
    else:
        keys = own.withColumn("own", F.lit(True))
    out = adjusted(latest(history_items.join(keys.select("k"), F.col("referenceId") == F.col("k"), "left_semi")))
    out = out.join(keys, F.col("_id") == F.col("k")).withColumn("_status", F.when((F.col("_status") == CREATED) & ~F.col("own"), F.lit(UPDATED)).otherwise(F.col("_status"))).drop("k", "own")
    return out if with_deleted else not_deleted(out)


def frame(history_items: DataFrame, history_parts: DataFrame, f: FrameFilter, parts: bool = True, part_date: bool = True, with_deleted: bool = True) -> DataFrame:
    """The frame of a filter with its nested parts; incremental if the filter has a min_time."""
    inc = f.min_time is not None
    items = incremental(history_items, history_parts, f, part_date, with_deleted) if inc else snapshot(history_items, f, with_deleted)
    return nest(items, parts_of(history_parts, f, inc, with_deleted)) if parts else items


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "nr") -> DataFrame:
    """df with out: the 1-based rank of each row within its keys, or among all rows if there are no keys, in an order.

    Rows are sorted over all tasks, so neither all rows nor those of a hot key meet in one. A row's rank is its place in
    its partition's run of equal keys, after the runs of the partitions before, of which only the lengths are added up.
    The sorted rows are written to the shared folder in between, as the bounds of partitions are drawn anew whenever a
    sort is run again. Equal rows have ranks in any order; a null key is a key.
    """
    sort = [*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`") for c in order]]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id())
    tagged = storage.materialize(ranged, storage.workspace(df.sparkSession, "numbered")).withColumn("__p", F.shiftright("__id", 33))
    runs = tagged.groupBy(F.col("__p").alias("__rp"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.min("__id").alias("__from"), F.count("*").alias("__n"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__rp").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    on = F.col("__p") == F.col("__rp")
    for i, c in enumerate(keys):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
    ranked = tagged.join(runs, on).withColumn(out, (F.col("__id") - F.col("__from") + F.col("__before") + 1).cast("long"))
    return ranked.drop("__id", "__p", "__rp", "__from", "__n", "__before", *[f"__k{i}" for i in range(len(keys))])


def chunked(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """df with chunk: the 0-based number of the dump file that holds the row, size rows a file in the given order."""
    return numbered(df, [], order, "__nr").withColumn("chunk", F.expr(f"(__nr - 1) div {int(size)}")).drop("__nr")


def items_patched(items: DataFrame, user: str = "zeus") -> DataFrame:
    """Defaults of imported items: facet `default`, the id as title, an empty description, a user."""
    blank = lambda c, d: F.when(F.length(F.coalesce(F.col(c), F.lit(""))) == 0, d).otherwise(F.col(c)).alias(c)
    sort_key = F.lower(F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), F.col("_id")), "[^\\p{L}\\p{Nd}]", ""))
    fixed = {"facetId": F.lit("default"), "title": F.col("_id"), "description": F.lit(""), "creatorId": F.lit(user), "userId": F.lit(user), "sortKey": sort_key}
    return items.select(*[blank(c, fixed[c]) if c in fixed else F.col(c) for c in items.columns])


def ensure_parts(items: DataFrame, parts: DataFrame, type_id: str, role_id: str | None = None) -> DataFrame:
    """parts with one more of type and role for every item that has none; it takes its users and times from the item."""
    same = (F.col("typeId") == type_id) & F.col("roleId").eqNullSafe(F.lit(role_id))
    missing = items.join(parts.where(same).select(F.col("itemId").alias("__k")), F.col("_id") == F.col("__k"), "left_anti")
    values = {"_id": F.concat_ws("/", F.col("_id"), F.lit(type_id), F.lit(role_id)), "itemId": F.col("_id"), "typeId": F.lit(type_id), "roleId": F.lit(role_id).cast("string"), "creatorId": F.col("creatorId"), "userId": F.col("userId"), "timeCreated": F.col("timeCreated"), "timeModified": F.col("timeModified")}
    new = missing.select(*[(values[c] if c in values else F.lit(None)).cast(parts.schema[c].dataType).alias(c) for c in parts.columns])
    return parts.unionByName(new)


def _other_than(name: str):
    return lambda k, _: k != name


def flag_metadata(df: DataFrame, column: str, on: dict[str, str], off: dict[str, str]) -> DataFrame:
    """df with metadata: names set by flags. A key of on counts when all its bits are set, one of off when none is.

    Keys are decimal, or hexadecimal after `h`; a value `name=value` sets a name, a bare `name` removes it. Rows without
    flags get no metadata at all.
    """
    def mask(k: str) -> int:
        return int(k[1:], 16) if k[:1] in "hH" else int(k)

    empty = F.create_map().cast("map<string,string>")
    m = empty
    for table_, test in ((on, lambda b, k: b == k), (off, lambda b, k: b == 0)):
        for k, v in table_.items():
            hit = test(F.col(column).bitwiseAND(F.lit(mask(k))), mask(k))
            name, eq, value = v.partition("=")
            rest = F.map_filter(m, _other_than(name))
            m = F.when(hit, F.map_concat(rest, F.create_map(F.lit(name), F.lit(value))) if eq else rest).otherwise(m)
    return df.withColumn("metadata", F.when(F.coalesce(F.col(column), F.lit(0)) == 0, empty).otherwise(m))
