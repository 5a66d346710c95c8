"""Controlled vocabularies: grouping of rows, merging, aliases and dumps. Entries: (thesaurus_id, ord, id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.csvload import fill_down

ENTRIES = "array<struct<id:string,value:string>>"


def entries_of(thesauri: DataFrame) -> DataFrame:
    """(thesaurus_id, ord, id, value) of thesauri (id, entries, targetId) that are no aliases; of repeated rows one."""
    own = thesauri.where("id is not null and coalesce(targetId, '') = ''").groupBy("id").agg(F.max(F.struct(F.size("entries").alias("n"), F.col("entries"))).alias("x"))
    return own.select(F.col("id").alias("thesaurus_id"), F.posexplode("x.entries").alias("ord", "e")).where("e is not null").select("thesaurus_id", "ord", "e.id", "e.value")


def aliases_of(thesauri: DataFrame) -> DataFrame:
    """(id, target_id) of aliases; a target without language is the one in English."""
    target = F.when(F.col("targetId").contains("@"), F.col("targetId")).otherwise(F.concat("targetId", F.lit("@en")))
    return thesauri.where("id is not null and targetId <> ''").groupBy("id").agg(F.min(target).alias("target_id"))


def group_rows(rows: DataFrame, file: str = "file_no", line: str = "line_no") -> DataFrame:
    """(file, first, thesaurus_id, target_id, entries) of rows in file order (thesaurus_id, id, value, target_id).

    A blank id is that of the row before; consecutive rows of one id are one thesaurus; a row with a target is an alias.
    Groups without entries are left out.
    """
    named = rows.withColumn("__t", F.nullif(F.trim("thesaurus_id"), F.lit("")))
    told = fill_down(named, file, line, "__t", "__prev", before=True)
    own = F.coalesce("__t", "__prev")
    starts = told.withColumn("__id", own).withColumn("__start", F.when(F.col("__t").isNotNull() & ~F.col("__t").eqNullSafe(F.col("__prev")), F.col(line)))
    # a run is known by its first line; runs are filled down by blocks, so a long file is spread over tasks
    islands = fill_down(starts, file, line, "__start", "__run")
    entry = F.when(F.col("id").isNotNull(), F.struct(F.col(line).alias("line"), "id", "value"))
    out = islands.groupBy(file, "__run", F.col("__id").alias("thesaurus_id")).agg(F.min(line).alias("first"), F.max("target_id").alias("target_id"), F.array_sort(F.collect_list(entry)).alias("es"))
    return out.where("target_id is not null or size(es) > 0").select(file, "first", "thesaurus_id", "target_id", F.transform("es", lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"))).alias("entries"))


def merged(source: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """(thesaurus_id, ord, id, value) of target after source came in; both hold entries, and an id occurs once in each.

    replace: thesauri of source as they are. patch: values of source win, the order of target stays, new entries follow.
    synch: as patch, without the entries that source lacks. Thesauri that only target has stay in every mode.
    """
    ids = source.select(F.col("thesaurus_id").alias("__t")).distinct()
    rest = target.join(ids, F.col("thesaurus_id") == F.col("__t"), "left_anti")
    if mode == "replace":
        return source.unionByName(rest)
    both = target.join(ids, F.col("thesaurus_id") == F.col("__t"), "left_semi")
    a, b = both.toDF(*[f"t_{c}" for c in both.columns]), source.toDF(*[f"s_{c}" for c in source.columns])
    full = a.join(b, (F.col("t_thesaurus_id") == F.col("s_thesaurus_id")) & (F.col("t_id") == F.col("s_id")), "full_outer")
    if mode == "synch":
        full = full.where("s_id is not null")
    elif mode != "patch":
        raise ValueError(mode)
    key = F.coalesce("t_thesaurus_id", "s_thesaurus_id")
    rows = full.select(key.alias("thesaurus_id"), F.coalesce("t_id", "s_id").alias("id"), F.when(F.col("s_id").isNotNull(), F.col("s_value")).otherwise(F.col("t_value")).alias("value"), "t_ord", "s_ord")
    order = Window.partitionBy("thesaurus_id").orderBy(F.col("t_ord").asc_nulls_last(), F.col("s_ord").asc_nulls_last())
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("thesaurus_id", "ord", "id", "value").unionByName(rest)


def merged_thesauri(source: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """Thesauri (id, entries, targetId) of target after those of source came in by mode, as merged().

    An alias of source replaces whatever target has under its id, in every mode; a source with entries replaces an alias of
    target. Of repeated rows one counts; rows without an id are left out. Entries keep their order.
    """
    in_aliases, old_aliases = aliases_raw(source), aliases_raw(target)
    own, old = entries_of(source), entries_of(target)
    new_ids = source.where("id is not null").select(F.col("id").alias("__n")).distinct()
    gone = in_aliases.select(F.col("id").alias("__a"))
    kept = old.join(gone, F.col("thesaurus_id") == F.col("__a"), "left_anti")
    rows = merged(own, kept, mode)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "value"))), lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value")))
    whole = rows.groupBy(F.col("thesaurus_id").alias("id")).agg(entries.alias("entries")).withColumn("targetId", F.lit(None).cast("string"))
    empty = F.array().cast(ENTRIES).alias("entries")
    aliases = in_aliases.unionByName(old_aliases.join(new_ids, F.col("id") == F.col("__n"), "left_anti")).select("id", empty, "targetId")
    bare = source.unionByName(target.join(new_ids, F.col("id") == F.col("__n"), "left_anti")).where("id is not null and coalesce(targetId, '') = ''").select(F.col("id").alias("__b")).distinct()
    known = whole.select(F.col("id").alias("__w")).unionByName(aliases.select(F.col("id").alias("__w")))
    without = bare.join(known, F.col("__b") == F.col("__w"), "left_anti").select(F.col("__b").alias("id"), empty, F.lit(None).cast("string").alias("targetId"))
    return whole.unionByName(aliases).unionByName(without)


def aliases_raw(thesauri: DataFrame) -> DataFrame:
    """(id, targetId) of aliases as they stand; of repeated rows the least target."""
    return thesauri.where("id is not null and targetId <> ''").groupBy("id").agg(F.min("targetId").alias("targetId"))


def entry_ids(wanted: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (thesaurus_id, value) with entry_id: the id of the first entry of that value, through an alias if need be."""
    via = aliases.select(F.col("id").alias("__a"), "target_id")
    first = entries.groupBy(F.col("thesaurus_id").alias("__t"), F.col("value").alias("__v")).agg(F.min_by("id", "ord").alias("entry_id"))
    out = wanted.join(via, F.col("thesaurus_id") == F.col("__a"), "left").withColumn("__to", F.coalesce("target_id", "thesaurus_id"))
    return out.join(first, (F.col("__to") == F.col("__t")) & (F.col("value") == F.col("__v")), "left").select(*wanted.columns, "entry_id")


def documents(thesauri: DataFrame) -> DataFrame:
    """(n, id, json) of thesauri as exported: an alias is its id and target, others have their entries.

    n is the place in a dump: `model-types@en` comes first, then by id. Repeated rows come once.
    """
    alias = F.coalesce(F.col("targetId"), F.lit("")) != ""
    entries = F.transform(F.filter(F.coalesce("entries", F.array().cast(ENTRIES)), lambda e: e.isNotNull()), lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value")))
    json = F.when(alias, F.to_json(F.struct("id", "targetId"))).otherwise(F.to_json(F.struct("id", entries.alias("entries"))))
    rows = thesauri.select("id", json.alias("json")).distinct()
    return rows.withColumn("n", F.struct(F.when(F.col("id") == "model-types@en", 0).otherwise(1).alias("k"), F.col("id").alias("id")))
