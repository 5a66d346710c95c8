"""Renditions of linear and branched segments: ordered aggregations of text, one row per item."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.scalars import fill_template
from strataframe.operators.framing import numbered
from strataframe.operators.rdf import xml_text

TEI = "http://www.tei-c.org/ns/1.0"


def _joined(rows: str, field: str = "x") -> Column:
    return F.array_join(F.transform(rows, lambda r: r[field]), "")


def payload_lines(pieces: DataFrame, flat: bool = False) -> DataFrame:
    """(item_id, json): an array of lines, each an array of segments, or flat, all segments in one array.

    pieces have n, k, y, start, end, fragment_ids and text.
    """
    seg = F.struct(F.col("start"), F.col("end"), F.col("fragment_ids").alias("fragmentIds"), F.col("text"))
    lines = pieces.groupBy("item_id", "y").agg(F.array_sort(F.collect_list(F.struct("n", "k", seg.alias("seg")))).alias("rows"))
    texts = lines.select("item_id", "y", F.to_json(F.transform("rows", lambda r: r["seg"])).alias("x"))
    return texts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("ls")).select("item_id", F.concat(F.lit("["), F.array_join(F.transform("ls", lambda r: F.substr(r["x"], F.lit(2), F.length(r["x"]) - 2) if flat else r["x"]), ","), F.lit("]")).alias("json"))


@dataclass(frozen=True)
class Blocks:
    """How lines become elements.

    root: name of the element around all lines, which is written only if root_included. elements: names of line elements by
    block type, of which block_type is taken, a text or a column of pieces. indented: lines on lines of their own. source
    and number: whether lines tell their item and their number. Names may have a prefix of namespaces.
    """

    root: str = "tei:div"
    root_included: bool = False
    elements: dict[str, str] = field(default_factory=lambda: {"default": "tei:p"})
    block_type: str | Column = "default"
    indented: bool = False
    source: bool = True
    number: bool = True
    namespaces: dict[str, str] = field(default_factory=dict)

    def name(self, name: str) -> tuple[str, str]:
        """(local name, xmlns attribute) of a name with or without prefix; ValueError for an unknown prefix."""
        prefix, colon, local = name.rpartition(":")
        spaces = {"tei": TEI} | self.namespaces
        if colon and prefix not in spaces:
            raise ValueError(f"no namespace for {name}")
        return local, f' xmlns="{spaces[prefix]}"' if colon else ""


def blocks(pieces: DataFrame, x: Column, o: Blocks | None = None) -> DataFrame:
    """(item_id, xml): the renditions x of pieces in one element per line."""
    o = o or Blocks()
    names = {k: o.name(v) for k, v in o.elements.items()}
    root, root_space = o.name(o.root)
    if isinstance(o.block_type, str):
        local, space = names[o.block_type]
        element, xmlns = F.lit(local), F.lit(space)
    else:
        other = names["default"]
        pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, n in names.items() for v in (k, n[i])]), o.block_type), F.lit(other[i]))
        element, xmlns = pick(0), pick(1)
    if o.root_included:  # a namespace is declared where it changes
        xmlns = F.when(xmlns == root_space, F.lit("")).otherwise(xmlns)
    line = F.struct("n", "k", F.struct(x.alias("x"), element.alias("el"), xmlns.alias("ns")).alias("x"))
    rows = pieces.select("item_id", "y", line.alias("l")).groupBy("item_id", "y").agg(F.array_sort(F.collect_list("l")).alias("rows"))
    first = F.get("rows", 0)["x"]
    head = F.concat(F.lit("<"), first["el"], *([F.lit(' source="^'), xml_text(F.col("item_id"), True), F.lit('"')] if o.source else []), *([F.lit(' n="'), F.col("y").cast("string"), F.lit('"')] if o.number else []), first["ns"], F.lit(">"))
    lines = rows.select("item_id", "y", F.concat(head, F.array_join(F.transform("rows", lambda r: r["x"]["x"]), ""), F.lit("</"), first["el"], F.lit(">")).alias("x"))
    gap = "" if not o.indented else "\n  " if o.root_included else "\n"
    inner = lines.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("ls")).select("item_id", F.array_join(F.transform("ls", lambda r: r["x"]), gap).alias("xml"))
    if not o.root_included:
        return inner
    end = "\n" if o.indented else ""
    return inner.select("item_id", F.concat(F.lit(f"<{root}{root_space}>{gap}"), "xml", F.lit(f"{end}</{root}>")).alias("xml"))


def tei_standoff(pieces: DataFrame, o: Blocks | None = None) -> DataFrame:
    """(item_id, xml): lines as p, annotated segments as seg with an id that counts the item's annotated segments.

    Pieces of one segment share its id.
    """
    w = Window.partitionBy("item_id").orderBy("n")
    marked = F.size("fragment_ids") > 0
    ids = pieces.where(marked).select("item_id", "n").distinct().withColumn("seg", F.row_number().over(w))
    rows = pieces.join(ids, ["item_id", "n"], "left")
    x = F.when(F.col("seg").isNotNull(), F.concat(F.lit('<seg xml:id="seg'), F.col("seg").cast("string"), F.lit('">'), xml_text(F.col("text")), F.lit("</seg>"))).otherwise(xml_text(F.col("text")))
    return blocks(rows, x, o)


def _attr(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), xml_text(value, True), F.lit('"')), F.lit(""))


def apparatus(segments: DataFrame, entries: DataFrame, numbered: bool = True, zero_type: str | None = None, located: bool = False, detail_inside: bool = False) -> DataFrame:
    """(item_id, fr_id, first, last, xml): the app element of each apparatus fragment.

    The lemma is the text of the first unbroken run of segments that have the fragment. Accepted entries are lem, others
    rdg; a witness's or author's note becomes a witDetail after its reading, whose id counts the item's readings of that
    element that have notes. located: with a loc, or a span of two, of the segments. detail_inside: witDetail is within its
    reading.
    """
    held = segments.select("item_id", "n", "text", F.explode("fragment_ids").alias("fr_id")).where(F.col("fr_id").contains("apparatus@"))
    w = Window.partitionBy("item_id", "fr_id").orderBy("n")
    run = held.withColumn("r", F.row_number().over(w)).withColumn("base", F.col("n") - F.col("r")).withColumn("b0", F.min("base").over(Window.partitionBy("item_id", "fr_id"))).where("base = b0")
    lemma = run.groupBy("item_id", "fr_id").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ts")).select("item_id", "fr_id", "first", "last", _joined("ts", "text").alias("lemma"))
    rows = entries.join(lemma, ["item_id", "fr_id"])
    tag = F.when(F.col("accepted"), F.lit("lem")).otherwise(F.lit("rdg"))
    noted = lambda c: F.filter(c, lambda x: F.coalesce(x["note"] != "", F.lit(False)))
    has_notes = (F.size(noted("witnesses")) > 0) | (F.size(noted("authors")) > 0)
    counted = rows.withColumn("el", tag).withColumn("has_notes", has_notes).withColumn("num", F.sum(F.col("has_notes").cast("int")).over(Window.partitionBy("item_id", "el").orderBy("fr_index", "part_id", "entry_index").rowsBetween(Window.unboundedPreceding, 0)))
    target = F.concat(F.col("el"), F.col("num").cast("string"))
    kind = F.nullif(F.col("tag"), F.lit(""))
    if zero_type:
        kind = F.when(F.coalesce(F.col("value"), F.lit("")) == "", F.concat_ws(" ", kind, F.lit(zero_type))).otherwise(kind)
    refs = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: F.concat(F.lit("#"), x["value"])), " "), F.lit(""))
    detail = lambda c, name: F.array_join(F.transform(noted(c), lambda x: F.concat(F.lit('<witDetail target="#'), target, F.lit(f'" {name}="#'), xml_text(x["value"], True), F.lit('">'), xml_text(x["note"]), F.lit("</witDetail>"))), "")
    number = _attr("n", (F.col("entry_index") + 1).cast("string")) if numbered else F.lit("")
    content = F.when(F.col("accepted"), F.col("lemma")).otherwise(F.coalesce("value", F.lit("")))
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "", F.concat(F.lit("<note>"), xml_text(F.col("note")), F.lit("</note>"))).otherwise(F.lit(""))
    details = [detail("witnesses", "wit"), detail("authors", "resp")]
    one = F.concat(F.lit("<"), F.col("el"), _attr("type", kind), number, F.when(F.col("has_notes"), _attr("xml:id", target)).otherwise(F.lit("")), _attr("wit", refs("witnesses")), _attr("resp", refs("authors")), F.lit(">"), xml_text(content), note, *(details if detail_inside else []), F.lit("</"), F.col("el"), F.lit(">"), *([] if detail_inside else details))
    grouped = counted.withColumn("x", one).groupBy("item_id", "fr_id", "fr_index", "fr_tag", "first", "last").agg(F.array_sort(F.collect_list(F.struct("entry_index", "x"))).alias("es"))
    loc, span = F.lit(""), F.lit("")
    if located:
        seg = lambda c: F.concat(F.lit("seg"), F.col(c).cast("string"))
        loc = F.when(F.col("first") == F.col("last"), _attr("loc", F.concat(F.lit("#"), seg("first")))).otherwise(F.lit(""))
        span = F.when(F.col("first") != F.col("last"), F.concat(F.lit("<loc"), _attr("spanFrom", F.concat(F.lit("#"), seg("first"))), _attr("spanTo", F.concat(F.lit("#"), seg("last"))), F.lit(" />"))).otherwise(F.lit(""))
    head = _attr("n", (F.col("fr_index") + 1).cast("string")) if numbered else F.lit("")
    return grouped.select("item_id", "fr_id", "first", "last", F.concat(F.lit("<app"), head, _attr("type", F.nullif("fr_tag", F.lit(""))), loc, F.lit(">"), span, _joined("es"), F.lit("</app>")).alias("xml"))


def tei_apparatus(pieces: DataFrame, apps: DataFrame, o: Blocks | None = None) -> DataFrame:
    """(item_id, xml): lines as p, with the app in place of each annotated segment's text."""
    keyed = pieces.withColumn("fr_id", F.get(F.filter("fragment_ids", lambda f: f.contains("apparatus@")), 0))
    rows = keyed.join(apps.select("item_id", "fr_id", F.col("xml").alias("app")), ["item_id", "fr_id"], "left")
    return blocks(rows, F.coalesce("app", xml_text(F.col("text"))), o)


def tei_parallel(tree: DataFrame, source: bool = False, number: bool = True) -> DataFrame:
    """(item_id, xml): level by level the only text, or an app of all texts; the base text of the first level is lem.

    Texts of a level come with the base version first, then by witness, then by author.
    """
    rank = F.array_min(F.transform("tags", lambda t: F.concat(F.when(t == "", F.lit("0")).when(t.startswith("w:"), F.lit("1")).otherwise(F.lit("2")), t)))
    variants = tree.groupBy("item_id", "n", "text").agg(F.min(rank).alias("rank"))
    base = variants.where("rank = '0'").groupBy("item_id").agg(F.min_by("text", "n").alias("original"))
    rows = variants.join(base, "item_id", "left")
    level = rows.groupBy("item_id", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "text", F.coalesce(F.col("text") == F.col("original"), F.lit(False)).alias("lem")))).alias("vs"))
    el = lambda v: F.when(v["lem"], F.lit("lem")).otherwise(F.lit("rdg"))
    app = F.concat(F.lit("<app>"), F.array_join(F.transform("vs", lambda v: F.concat(F.lit("<"), el(v), F.lit(">"), xml_text(v["text"]), F.lit("</"), el(v), F.lit(">"))), ""), F.lit("</app>"))
    x = F.when(F.size("vs") == 1, xml_text(F.get("vs", 0)["text"])).otherwise(app)
    return level.select("item_id", "n", x.alias("x")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("ls")).select("item_id", F.concat(F.lit("<p"), *([F.lit(' source="^'), xml_text(F.col("item_id"), True), F.lit('"')] if source else []), F.lit(' n="1"' if number else ""), F.lit(f' xmlns="{TEI}">'), _joined("ls"), F.lit("</p>")).alias("xml"))


def dispatch(parts: DataFrame, renderers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(_id, text): each part's content by the renderer of its `typeId:roleId`, else of its `typeId`; others are left out."""
    key = F.concat_ws(":", "typeId", "roleId")
    out = F.lit(None).cast("string")
    for k, f in sorted(renderers.items(), key=lambda x: x[0].count(":")):
        out = F.when(key == k if ":" in k else F.col("typeId") == k, f(F.col("content"))).otherwise(out)
    return parts.select("_id", out.alias("text")).where("text is not null")


def metadata(items: DataFrame) -> DataFrame:
    """(item_nr, _id, title, facetId, flags, groupId, new_group): items as they are composed, in the order of sortKey.

    Numbers count within a group; new_group marks the first item of each.
    """
    rows = numbered(items.withColumn("__flow", _flow()), ["__flow"], ["sortKey", "_id"], "item_nr")
    return rows.select(F.col("item_nr").cast("int").alias("item_nr"), "_id", "title", "facetId", "flags", "groupId", (F.col("item_nr") == 1).alias("new_group"))


def _flow() -> Column:
    return F.coalesce(F.nullif(F.col("groupId"), F.lit("")), F.lit("default"))


def standoff_flows(pieces: DataFrame, apps: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(item_id, flow, xml): the base text, and side by side with it a flow for each layer role.

    apps: the apparatus. others: (item_id, fr_id, xml), elements of fragments of whatever other layers, in the order of
    fr_index if there is one, else of fr_id; standoff_fragments makes them where a layer has no renderer of its own.
    """
    base = tei_standoff(pieces).select("item_id", F.lit("base-text").alias("flow"), "xml")
    flow = F.regexp_extract("fr_id", r":(.*)@", 1).alias("flow")
    layers = apps.select("item_id", flow, F.struct("first", "fr_id", "xml").alias("x"))
    if others is not None:
        first = F.col("fr_index") if "fr_index" in others.columns else F.lit(0)
        layers = layers.unionByName(others.select("item_id", flow, F.struct(first.cast(apps.schema["first"].dataType).alias("first"), "fr_id", "xml").alias("x")))
    grouped = layers.groupBy("item_id", "flow").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return base.unionByName(grouped.select("item_id", "flow", F.concat(F.lit('<standOff source="^'), xml_text(F.col("item_id"), True), F.lit(f'" xmlns="{TEI}">'), _joined("xs", "xml"), F.lit("</standOff>")).alias("xml")))


def standoff_fragments(pieces: DataFrame, fragments: DataFrame, skip: str = "apparatus") -> DataFrame:
    """(item_id, fr_id, fr_index, xml): a note on the segments of each fragment of a layer that skip doesn't name.

    Fragments (item_id, fr_id, fr_index, tag, entries) without a segment are left out.
    """
    w = Window.partitionBy("item_id").orderBy("n")
    ids = pieces.where(F.size("fragment_ids") > 0).select("item_id", "n", "fragment_ids").distinct().withColumn("seg", F.row_number().over(w))
    held = ids.select("item_id", "seg", F.explode("fragment_ids").alias("fr_id")).where(~F.col("fr_id").contains(f"{skip}@")).groupBy("item_id", "fr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("seg")), lambda s: F.concat(F.lit("#seg"), s.cast("string"))), " ").alias("target"))
    rows = fragments.join(held, ["item_id", "fr_id"])
    return rows.select("item_id", "fr_id", "fr_index", F.concat(F.lit("<note"), _attr("target", F.col("target")), _attr("type", F.nullif("tag", F.lit(""))), F.lit(">"), xml_text(F.coalesce(F.col("entries"), F.lit(""))), F.lit("</note>")).alias("xml"))


#: fixed values: names that templates of items and groups may hold in braces
METADATA = {"item-id": "_id", "item-title": "title", "item-facet": "facetId", "item-group": "groupId", "item-flags": "flags", "item-nr": "item_nr"}


def composed(items: DataFrame, rendered: DataFrame, head: str = "", tail: str = "", group_head: str = "", group_tail: str = "", item_head: str = "", item_tail: str = "", grouped: bool = True) -> DataFrame:
    """(flow, item_nr, text): the renditions of items in the order of sortKey, by flow: the item's group, or one for all.

    head and tail are the first and last texts of every flow; group_head and group_tail, with `{group}`, start and end each
    group; item_head and item_tail stand around each item, with the names of METADATA in braces.
    """
    flow = _flow() if grouped else F.lit("default")
    kept = [c for c in METADATA.values() if c in items.columns and c != "_id"]
    both = items.join(rendered.toDF("__item", "text"), F.col("_id") == F.col("__item")).select(flow.alias("flow"), "sortKey", "_id", "text", *kept)
    rows = numbered(both, ["flow"], ["sortKey", "_id"], "item_nr").withColumn("item_nr", F.col("item_nr").cast("int"))
    values = {k: F.col(c) for k, c in METADATA.items() if c in rows.columns}
    rows = rows.select("flow", "item_nr", F.concat(*([fill_template(item_head, values)] if item_head else []), F.col("text"), *([fill_template(item_tail, values)] if item_tail else [])).alias("text"))
    flows = rows.select("flow").distinct()
    of_group = lambda x: F.replace(F.lit(x), F.lit("{group}"), F.col("flow"))
    ends = [flows.select("flow", F.lit(0).alias("item_nr"), F.concat(F.lit(head), of_group(group_head)).alias("text"))] if head or group_head else []
    ends += [flows.select("flow", F.lit(2**31 - 1).alias("item_nr"), F.concat(of_group(group_tail), F.lit(tail)).alias("text"))] if tail or group_tail else []
    for e in ends:
        rows = rows.unionByName(e)
    return rows


def composite(*renderers: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One renderer that joins what several make of the same pieces, item by item and in their order, into one text."""
    def apply(pieces: DataFrame) -> DataFrame:
        out = None
        for i, r in enumerate(renderers):
            df = r(pieces)
            one = df.select("item_id", F.struct(F.lit(i).alias("i"), F.col(df.columns[-1]).alias("x")).alias("x"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("item_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("item_id", _joined("xs").alias("text"))

    return apply
