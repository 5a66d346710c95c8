"""Layered texts: locations to character ranges, ranges to consecutive segments, and transforms of linear segments.

A text is a row (item_id, part_id, lines, text). A linear tree is rows (item_id, n, ...), in the order of n; a branched
tree is rows keyed by the hash of their path. Ranges include their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.scalars import FEATURES, cut_text, replacements

_POINT = r"(\d+)\.(\d+)(?:@(\d+)(?:x(\d+))?)?"
LOCATION = rf"\A{_POINT}(?:-{_POINT})?\z"
#: positions of a text that share a join key when ranges meet segments
BUCKET = 256


def current(parts: DataFrame) -> DataFrame:
    """One row per part: of repeated rows and outdated copies the last by timeModified, then arrivedAt, then content."""
    w = Window.partitionBy("_id").orderBy(*[F.col(c).desc_nulls_last() for c in ("timeModified", "arrivedAt", "content", "itemId", "roleId")])
    return parts.where("_id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def base_texts(parts: DataFrame, role: str = "base-text") -> DataFrame:
    """(item_id, part_id, lines, text) of each item's base text; of several the one with the least part id."""
    lines = F.transform(F.from_json("content", "lines array<struct<y:int,text:string>>")["lines"], lambda x: F.coalesce(x["text"], F.lit("")))
    own = parts.where((F.col("roleId") == role) & F.col("itemId").isNotNull()).select("itemId", "_id", lines.alias("lines")).where("lines is not null")
    one = own.groupBy(F.col("itemId").alias("item_id")).agg(F.min_by(F.struct("_id", "lines"), "_id").alias("x"))
    return one.select("item_id", F.col("x._id").alias("part_id"), F.col("x.lines").alias("lines"), F.array_join("x.lines", "\n").alias("text"))


def as_array(text: Column) -> Column:
    """JSON text of an array, also where only its one object is given."""
    return F.when(F.ltrim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)


def layer_fragments(parts: DataFrame, prefix: str = "fr.", type_ids: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, part_id, role_id, fr_index, fr_id, location, tag, entries) of all layer parts, entries as JSON text."""
    layers = parts.where(F.col("roleId").startswith(prefix) & F.col("itemId").isNotNull())
    if type_ids:
        layers = layers.where(F.col("typeId").isin(*type_ids))
    frs = F.from_json(as_array(F.get_json_object("content", "$.fragments")), "array<struct<location:string,tag:string,entries:string>>")
    rows = layers.select(F.col("itemId").alias("item_id"), F.col("_id").alias("part_id"), "typeId", F.col("roleId").alias("role_id"), F.posexplode(frs).alias("fr_index", "fr")).where("fr is not null")
    return rows.select("item_id", "part_id", "role_id", "fr_index", F.concat("typeId", F.lit(":"), "role_id", F.lit("@"), F.col("fr_index").cast("string")).alias("fr_id"), "fr.location", "fr.tag", as_array(F.col("fr.entries")).alias("entries"))


def _number(loc: Column, group: int) -> Column:
    return F.regexp_extract(loc, LOCATION, group).try_cast("int")


def range_of(lines: Column, loc: Column) -> tuple[Column, Column]:
    """(start, end) of a location `y.x`, `y.x@at`, `y.x@atxrun`, or of a range of two; null where there is no such place."""
    def point(g: int, last: bool) -> Column:
        y, x, at, run = (_number(loc, g + i) for i in range(4))
        line = F.get(lines, y - 1)
        tokens = F.split(line, " ", -1)
        before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(F.lit(0), y - 1)), F.lit(0), lambda a, s: a + F.length(s) + 1)
        start = F.least(F.length(line), F.length(F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), x - 1)), " ")) + F.when(x > 1, 1).otherwise(0))
        inside = F.coalesce(at - 1, F.lit(0))
        if not last:
            out = before + start + inside
        else:
            whole = start + F.coalesce(F.length(F.get(tokens, x - 1)), F.lit(0)) - 1
            out = before + F.when(at.isNull(), whole).otherwise(start + inside + F.coalesce(run, F.lit(1)) - 1)
        return F.when((y >= 1) & (x >= 1) & (y <= F.size(lines)), out)

    return point(1, False), F.when(_number(loc, 5).isNull(), point(1, True)).otherwise(point(5, True))


def flatten(texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """(item_id, fr_id, start, end): the ranges of fragments in their item's text; those without a place are left out."""
    both = fragments.select("item_id", "fr_id", "location").join(texts.select("item_id", "lines"), "item_id")
    a, b = range_of(F.col("lines"), F.col("location"))
    return both.select("item_id", "fr_id", a.alias("start"), b.alias("end")).where("start is not null and end is not null and start <= end")


def consecutive(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(item_id, n, start, end, fragment_ids, text, eol): each text cut at all bounds of its ranges, without gaps.

    fragment_ids are the sorted ids of the ranges that cover a segment; ranges beyond the text are clipped. eol: the next
    character is a line feed. Segments meet ranges by item and stretch of the text, so one long text with very many
    ranges is spread over many tasks.
    """
    sized = texts.select("item_id", F.length("text").alias("size"))
    clipped = ranges.join(sized, "item_id").select("item_id", "fr_id", F.greatest(F.lit(0), "start").alias("start"), F.least(F.col("size") - 1, F.col("end")).alias("end")).where("start <= end")
    bounds = sized.where("size > 0").select("item_id", F.explode(F.array(F.lit(0), F.col("size"))).alias("pos")).unionByName(clipped.select("item_id", F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("pos"))).distinct()
    w = Window.partitionBy("item_id").orderBy("pos")
    gaps = bounds.withColumn("end", F.lead("pos").over(w) - 1).where("end is not null").withColumn("n", F.row_number().over(w)).withColumnRenamed("pos", "start")
    left = gaps.withColumn("b", F.floor(F.col("start") / BUCKET))
    right = clipped.select(F.col("item_id").alias("r_item"), "fr_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("rb"))
    met = left.join(right, (F.col("item_id") == F.col("r_item")) & (F.col("b") == F.col("rb")) & (F.col("r_start") <= F.col("end")) & (F.col("r_end") >= F.col("start")), "left")
    ids = met.groupBy("item_id", "n", "start", "end").agg(F.array_sort(F.collect_set("fr_id")).alias("fragment_ids"))
    placed = ids.join(texts.select("item_id", F.col("text").alias("__text")), "item_id")
    piece = F.substr("__text", F.col("start") + 1, F.col("end") - F.col("start") + 1)
    return placed.select("item_id", "n", "start", "end", "fragment_ids", piece.alias("text"), (F.substr("__text", F.col("end") + 2, F.lit(1)) == "\n").alias("eol"))


def layered(parts: DataFrame, role: str = "base-text", prefix: str = "fr.") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, fragments, segments) of the last versions of parts.

    Each is used several times by what follows, so it is written once to the shared folder: parts are scanned and
    ordered only once, however many renditions are made of them.
    """
    folder = storage.workspace(parts.sparkSession, "layers")
    last = current(parts.select("_id", "itemId", "typeId", "roleId", "timeModified", "arrivedAt", "content"))
    narrow = storage.materialize(last.where((F.col("roleId") == role) | F.col("roleId").startswith(prefix)), f"{folder}/parts")
    base = storage.materialize(base_texts(narrow, role), f"{folder}/texts")
    frs = storage.materialize(layer_fragments(narrow, prefix), f"{folder}/fragments")
    ranges = storage.materialize(flatten(base, frs), f"{folder}/ranges")
    return base, frs, storage.materialize(consecutive(base, ranges), f"{folder}/segments")


def merge_linear(segments: DataFrame, names: tuple[str, ...] = (), break_at_lf: bool = True, keys: tuple[str, ...] = ("item_id",), value_filters: Sequence[tuple[str, str, bool]] = ()) -> DataFrame:
    """Adjacent segments with equal sets of features, of given names or all, merged: keys..., n, text, features, others.

    value_filters: literal or (third value true) regular-expression replacements on values before they are compared. Texts
    are joined, features and tags united, payloads joined in order; n and other columns are those of the first. With
    break_at_lf a segment after a line feed is never merged with what comes before it.
    """
    wanted = F.col("features") if not names else F.filter("features", lambda f: f["name"].isin(*names))
    if value_filters:
        rewrite = replacements(value_filters)
        wanted = F.transform(wanted, lambda f: F.struct(f["name"].alias("name"), rewrite(f["value"]).alias("value")))
    same = F.to_json(F.array_sort(F.array_distinct(F.coalesce(wanted, F.array().cast(FEATURES)))))
    w = Window.partitionBy(*keys).orderBy("n")
    cut = ~F.lag("__set").over(w).eqNullSafe(F.col("__set"))
    if break_at_lf:
        cut = cut | F.coalesce(F.lag("text").over(w).endswith("\n"), F.lit(False))
    islands = segments.withColumn("__set", same).withColumn("__cut", cut.cast("int")).withColumn("__island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = [c for c in ("tags", "payloads") if c in segments.columns]
    others = [c for c in segments.columns if c not in (*keys, "n", "text", "features", *lists)]
    rows = islands.groupBy(*keys, "__island").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "text", "features", *lists))).alias("__rows"), *[F.min_by(c, "n").alias(c) for c in others])
    joined = lambda c: F.flatten(F.transform("__rows", lambda r: F.coalesce(r[c], F.array().cast(segments.schema[c].dataType))))
    more = [(F.array_distinct(joined(c)) if c == "tags" else joined(c)).alias(c) for c in lists]
    return rows.select(*keys, "n", F.array_join(F.transform("__rows", lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"), F.array_distinct(joined("features")).alias("features"), *more, *others)


def block_lines(segments: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Segments cut at line feeds: keys..., n, k (the piece of segment n), text, eol, and the other columns as they were.

    Line feeds vanish; eol marks the piece before one or more of them, in the same segment or later. Pieces without
    text vanish; line feeds before any text do too. A null text is no segment.
    """
    others = [c for c in segments.columns if c not in (*keys, "n", "text", "eol")]
    pieces = segments.where("text is not null").select(*keys, "n", *others, F.posexplode(F.split("text", "\n", -1)).alias("k", "piece"), F.size(F.split("text", "\n", -1)).alias("__size"))
    order = Window.partitionBy(*keys).orderBy("n", "k")
    group = F.sum((F.col("piece") != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = pieces.withColumn("__g", group).where("__g > 0")
    row = F.struct("n", "k", F.col("piece").alias("text"), *others)
    out = numbered.groupBy(*keys, "__g").agg(F.max(F.when(F.col("piece") != "", row)).alias("__row"), F.bool_or(F.col("k") < F.col("__size") - 1).alias("eol"))
    return out.select(*keys, "__row.n", "__row.k", "__row.text", "eol", *[f"__row.{c}" for c in others])


def with_lines(pieces: DataFrame, order: tuple[str, ...] = ("n", "k"), keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """pieces with y, the number of their line: one more than the line ends before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("y", (1 + F.coalesce(F.sum(F.col("eol").cast("int")).over(w), F.lit(0))).cast("int"))


def first_run(segments: DataFrame, test: Column, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(keys..., first, last): the bounds, as n, of the first unbroken run of segments that pass a test."""
    w = Window.partitionBy(*keys).orderBy("n")
    rows = segments.withColumn("__hit", F.coalesce(test, F.lit(False)))
    rows = rows.withColumn("__start", (F.col("__hit") & ~F.coalesce(F.lag("__hit").over(w), F.lit(False))).cast("int")).withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__hit and __run = 1").groupBy(*keys).agg(F.min("n").alias("first"), F.max("n").alias("last"))


def dense_ids(df: DataFrame, group: list[str], key: str, order: list[str], out: str = "id") -> DataFrame:
    """(group..., key, out): numbers from 1 for the keys of a group, in the order in which they first occur."""
    first = df.groupBy(*group, key).agg(F.min(F.struct(*order)).alias("__first"))
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy("__first", key))).drop("__first")


def extract_tokens(df: DataFrame, texts: DataFrame, pattern: str = r"@\{([^}]+)\}", template: str = "{text}", open_: str = "[", close: str = "]", whole: bool = False, portion: bool = False, cut: dict | None = None) -> DataFrame:
    """df (item_id, text) with `@{location}` replaced by the place's text: its tokens, with marks around the part meant.

    whole: without marks. portion: only the part meant. cut: options of cut_text for what is put in. A location that is no
    place is left out; rows of items without a text stay as they are.
    """
    rows = df.withColumn("__n", F.monotonically_increasing_id())
    refs = rows.where(F.regexp_like("text", F.lit(pattern))).select("__n", "item_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("i", "loc"))
    a, b = range_of(F.col("lines"), F.col("loc"))
    placed = refs.join(texts.select("item_id", "lines", F.col("text").alias("base")), "item_id").select("__n", "i", "base", a.alias("a"), b.alias("b"))
    head = F.regexp_extract(F.substr("base", F.lit(1), F.col("a")), r"([^ \n]*)\z", 1)
    tail = F.regexp_extract(F.substr("base", F.col("b") + 2), r"\A([^ \n]*)", 1)
    middle = F.substr("base", F.col("a") + 1, F.col("b") - F.col("a") + 1)
    plain = F.concat(head, middle, tail)
    marked = middle if portion else plain if whole else F.when((head == "") & (tail == ""), plain).otherwise(F.concat(head, F.lit(open_), middle, F.lit(close), tail))
    marked = cut_text(marked, **cut) if cut is not None else marked
    filled = F.replace(F.lit(template), F.lit("{text}"), F.coalesce(marked, F.lit("")))
    values = placed.groupBy("__n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", filled.alias("v")))), lambda x: x["v"]).alias("__vs"))
    pieces = F.zip_with(F.split("text", pattern, -1), "__vs", lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return rows.join(values, "__n", "left").withColumn("text", F.when(F.col("__vs").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))).select(*df.columns)


def preview(parts: DataFrame, text_part: str, layer_parts: Sequence[str], role: str = "base-text") -> DataFrame:
    """(item_id, n, k, text, eol, y, fragment_ids, start, end): one text part's pieces under some of its item's layers."""
    last = current(parts.where(F.col("_id").isin(text_part, *layer_parts)))
    base = base_texts(last.where(F.col("_id") == text_part).withColumn("roleId", F.lit(role)), role)
    frs = layer_fragments(last.where(F.col("_id").isin(*layer_parts)))
    return with_lines(block_lines(consecutive(base, flatten(base, frs))))


#: types of apparatus entries that leave the text as it is
NOTE = 3
ENTRY = "array<struct<type:int,value:string,isAccepted:boolean,tag:string,note:string,witnesses:string,authors:string>>"


def apparatus_entries(fragments: DataFrame, role: str = "apparatus") -> DataFrame:
    """(item_id, part_id, fr_index, entry_index, type, value, accepted, tag, note, witnesses, authors) of apparatus layers."""
    rows = fragments.where(F.col("role_id").endswith(role)).select("item_id", "part_id", "fr_index", "fr_id", F.col("tag").alias("fr_tag"), F.posexplode(F.from_json("entries", ENTRY)).alias("entry_index", "e")).where("e is not null")
    values = lambda c: F.coalesce(F.from_json(as_array(c), "array<struct<value:string,note:string>>"), F.array().cast("array<struct<value:string,note:string>>"))
    return rows.select("item_id", "part_id", "fr_index", "fr_id", "fr_tag", "entry_index", F.coalesce("e.type", F.lit(0)).alias("type"), "e.value", F.coalesce("e.isAccepted", F.lit(False)).alias("accepted"), F.col("e.tag").alias("tag"), F.col("e.note").alias("note"), values(F.col("e.witnesses")).alias("witnesses"), values(F.col("e.authors")).alias("authors"))


def renamed_sources(entries: DataFrame, witnesses: dict[str, str] | None = None, authors: dict[str, str] | None = None) -> DataFrame:
    """entries whose witnesses and authors have other names, where the maps have one for them."""
    def renamed(c: str, names: dict[str, str] | None) -> Column:
        if not names:
            return F.col(c)
        known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        return F.transform(c, lambda x: F.struct(F.coalesce(F.try_element_at(known, x["value"]), x["value"]).alias("value"), x["note"].alias("note"))).alias(c)

    return entries.withColumns({"witnesses": renamed("witnesses", witnesses), "authors": renamed("authors", authors)})


def fragment_features() -> Column:
    """Features of segments by the layers of their fragments: (role, the role of each)."""
    return F.array_distinct(F.transform("fragment_ids", lambda x: F.struct(F.lit("role").alias("name"), F.regexp_extract(x, ":(.*)@", 1).alias("value"))))


def versions(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """(item_id, tag, n, text): the base version, tagged by nothing, and one of each source, `w:` witness or `a:` author.

    A source's text of a segment is that of the first entry it has there; a note leaves the base text, an entry without
    value empties it, and a source that has none reads with the base. Of several layer parts of one role the first by id
    counts. Sources meet only the segments of their own item.
    """
    sources = entries.select("item_id", "part_id", "fr_id", "entry_index", "type", "value", F.explode(F.concat(F.transform("witnesses", lambda w: F.concat(F.lit("w:"), w["value"])), F.transform("authors", lambda a: F.concat(F.lit("a:"), a["value"])))).alias("tag")).where("tag is not null")
    reading = sources.groupBy("item_id", "tag", "fr_id").agg(F.min_by(F.struct("type", "value"), F.struct("part_id", "entry_index")).alias("e"))
    tags = sources.select("item_id", "tag").distinct().unionByName(segments.select("item_id", F.lit("").alias("tag")).distinct())
    here = segments.select("item_id", "n", "text", F.filter("fragment_ids", lambda x: x.contains(":fr.") & x.contains("apparatus@")).alias("frs"))
    rows = here.join(tags, "item_id").withColumn("fr_id", F.get("frs", 0))
    found = rows.join(reading, ["item_id", "tag", "fr_id"], "left")
    text = F.when(F.col("e").isNull() | (F.col("e.type") == NOTE), F.col("text")).otherwise(F.coalesce("e.value", F.lit("")))
    return found.select("item_id", "tag", "n", text.alias("text"))


def version_tree(vs: DataFrame) -> DataFrame:
    """(item_id, n, node, parent, text, tags): the prefix tree of all versions; versions with equal beginnings share nodes.

    A node is named by a hash chained along its path, so no row holds a whole path. parent is null at the first level.
    """
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task come version by version, in order, so one hash at a time is carried on."""
        version, node = None, None
        for b in batches:
            items, tags, ns, texts_ = (b.column(i).to_pylist() for i in range(4))
            nodes, parents = [], []
            for item, tag, text in zip(items, tags, texts_):
                if (item, tag) != version:
                    version, node = (item, tag), None
                parents.append(node)
                node = hashlib.sha256(f"{node or ''}/{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(nodes, pa.string()), pa.array(parents, pa.string())], names=["item_id", "tag", "n", "text", "node", "parent"])

    ordered = vs.select("item_id", "tag", F.col("n").cast("int").alias("n"), "text").repartition("item_id", "tag").sortWithinPartitions("item_id", "tag", "n")
    nodes = ordered.mapInArrow(chained, "item_id string, tag string, n int, text string, node string, parent string")
    return nodes.groupBy("item_id", "n", "node", "parent", "text").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
