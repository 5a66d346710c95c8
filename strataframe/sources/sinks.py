"""Sinks: chunked JSON dumps, text flows, RDF files and appended tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators import framing


def json_chunks(frame: DataFrame, path: str, size: int = 100, order: tuple[str, ...] = ("sortKey", "_id")) -> None:
    """JSON lines of a frame in folders chunk=N, exactly size rows each but the last."""
    rows = framing.chunked(frame, list(order), size)
    rows.select("chunk", F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("value")).repartition("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").text(path)


def json_envelopes(frame: DataFrame, size: int, options: dict, stamp: str, order: tuple[str, ...] = ("sortKey", "_id")) -> DataFrame:
    """(chunk, doc): whole documents `{time, chunk, options, items}` of size items each."""
    rows = framing.chunked(frame, list(order), size)
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))
    key = F.struct(*[F.col(c) for c in order], item.alias("json"))
    grouped = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(key)).alias("xs"))
    head = F.concat(F.lit('{"time":' + json.dumps(stamp) + ',"chunk":'), (F.col("chunk") + 1).cast("string"), F.lit(',"options":' + json.dumps(options) + ',"items":['))
    return grouped.select("chunk", F.concat(head, F.array_join(F.transform("xs", lambda x: x["json"]), ","), F.lit("]}")).alias("doc"))


def envelope_lines(frame: DataFrame, path: str, size: int, options: dict, stamp: str, order: tuple[str, ...] = ("sortKey", "_id")) -> None:
    """The documents of json_envelopes as text files in folders chunk=N, an item a line: no value is larger than an item.

    A chunk is written by one task, row by row in order, however many items it has.
    """
    rows = framing.numbered(frame, [], list(order), "__nr").withColumn("chunk", F.expr(f"(__nr - 1) div {int(size)}"))
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))
    last = F.lit(rows.agg(F.max("__nr")).first()[0])
    ends = (F.col("__nr") % int(size) == 0) | (F.col("__nr") == last)
    lines = rows.select("chunk", F.col("__nr").alias("k"), F.concat(item, F.when(ends, F.lit("")).otherwise(F.lit(","))).alias("value"))
    chunks = rows.select("chunk").distinct()
    head = F.concat(F.lit('{"time":' + json.dumps(stamp) + ',"chunk":'), (F.col("chunk") + 1).cast("string"), F.lit(',"options":' + json.dumps(options) + ',"items":['))
    lines = lines.unionByName(chunks.select("chunk", F.lit(0).cast("long").alias("k"), head.alias("value"))).unionByName(chunks.select("chunk", F.lit(2**62).alias("k"), F.lit("]}").alias("value")))
    lines.repartition("chunk").sortWithinPartitions("chunk", "k").drop("k").write.partitionBy("chunk").text(path)


def text_flows(rows: DataFrame, path: str, flow: str = "flow", order: str = "item_nr", text: str = "text") -> None:
    """Texts of flows in folders flow=NAME, each in order; names are made safe for files by the file system's rules."""
    rows.select(F.col(flow).alias("flow"), F.col(order).alias("__n"), F.col(text).alias("value")).repartition("flow").sortWithinPartitions("flow", "__n").drop("__n").write.partitionBy("flow").text(path)


def ordered_lines(lines: DataFrame, path: str, order: str = "n", line: str = "line") -> None:
    """Lines of a document in part files whose names keep the order; nothing is gathered in one task."""
    lines.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.col(line).alias("value")).write.text(path)


def append_import(items: DataFrame, parts: DataFrame, path: str, history: bool = True) -> None:
    """Imported items and parts, appended to their tables and, as created, to the history tables."""
    for name, df in (("items", items), ("parts", parts)):
        df.write.mode("append").parquet(f"{path}/{name}.parquet")
        if history:
            log = df.withColumn("referenceId", F.col("_id")).withColumn("_id", F.sha2(F.concat_ws("/", "_id", F.col("timeModified").cast("string")), 256)).withColumn("status", F.lit(0))
            log.write.mode("append").parquet(f"{path}/history_{name}.parquet")


def markdown_items(items: DataFrame, per_file: int = 100, parts: DataFrame | None = None, json_parts: bool = False) -> DataFrame:
    """(file, n, text): items as Markdown sections, per_file to a file d00001.md and so on, in the order of sortKey.

    parts: an item's parts follow as sections of their own, with their content in a code block if json_parts.
    """
    def line(label: str, c: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"- {label}: `"), F.col(c).cast("string"), F.lit("`\n")), F.lit(""))

    rows = framing.chunked(items, ["sortKey", "_id"], per_file)
    labels = (("ID", "_id"), ("description", "description"), ("facet ID", "facetId"), ("group ID", "groupId"), ("sort key", "sortKey"), ("created", "timeCreated"), ("creator", "creatorId"), ("modified", "timeModified"), ("user", "userId"))
    text = F.concat(F.lit("#### "), F.coalesce("title", F.col("_id")), F.lit("\n\n"), *[line(a, b) for a, b in labels if b in items.columns])
    if "flags" in items.columns:  # in hexadecimal, of four digits at least
        digits = F.hex(F.col("flags").cast("long"))
        text = F.concat(text, F.when(F.coalesce(F.col("flags"), F.lit(0)) != 0, F.concat(F.lit("- flags: `"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit("`\n"))).otherwise(F.lit("")))
    file = F.format_string("d%05d.md", (F.col("chunk") + 1).cast("int")).alias("file")
    out = rows.select(file, F.struct("sortKey", "_id", F.lit("").alias("part")).alias("n"), text.alias("text"))
    if parts is None:
        return out
    of_parts = (("type ID", "__p_typeId"), ("role ID", "__p_roleId"), ("created", "__p_timeCreated"), ("creator", "__p_creatorId"), ("modified", "__p_timeModified"), ("user", "__p_userId"))
    own = parts.select(*[F.col(c).alias(f"__p_{c}") for c in framing.PART_COLUMNS if c in parts.columns])
    both = rows.join(own, F.col("_id") == F.col("__p_itemId"))
    code = [F.lit("\n```json\n"), F.coalesce("__p_content", F.lit("")), F.lit("\n```\n")] if json_parts else []
    part = F.concat(F.lit("\n##### "), F.coalesce("__p__id", F.lit("")), F.lit("\n\n"), *[line(a, b) for a, b in of_parts if b in both.columns], *code)
    return out.unionByName(both.select(file, F.struct("sortKey", "_id", F.coalesce("__p__id", F.lit("")).alias("part")).alias("n"), part.alias("text")))
