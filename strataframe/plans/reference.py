"""Queries of framing, graphs, RDF, layered texts, renditions, text functions and vocabularies, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.functions.predicates import FrameFilter
from strataframe.operators import framing, graph, rdf, render, texts, thesaurus
from strataframe.plans import problems
from strataframe.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, FROM, TO = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
PREFIXES = {"lv": "http://lv.example.org/vocabulary#", "x": "http://data.example.org/", "xsd": "http://www.w3.org/2001/XMLSchema#", "xs": "http://www.w3.org/2001/XMLSchema#"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# framing

_LATEST = """(select *, row_number() over (partition by "referenceId" order by "timeModified" desc nulls last, _id desc nulls last) as r from {t} where "referenceId" is not null and {w})"""
_ITEM = '"referenceId" as _id, title, status as _status, "sortKey", flags'


def _items(df: DataFrame) -> DataFrame:
    return df.select("_id", "title", "_status", "sortKey", "flags")


def _snapshot_query(name: str, f: FrameFilter, where: str, tail: str = "", with_deleted: bool = True) -> None:
    sql = f"select {_ITEM} from {_LATEST.format(t='history_items', w=where)} where r = 1 {tail}"
    query(name, sql)(lambda s, d: _items(framing.snapshot(table(s, d, "history_items"), f, with_deleted)))


_UNTIL = f"\"timeModified\" <= timestamp '{AS_OF}'"
_snapshot_query("frame_items", FrameFilter(), "true")
_snapshot_query("frame_items_asof", FrameFilter(max_time=AS_OF), _UNTIL)
_snapshot_query("frame_items_nodeleted", FrameFilter(), "true", "and status is distinct from 2", False)
_snapshot_query("filter_title_regex", FrameFilter(title="^(stele|altar) of"), "regexp_matches(title, '^(stele|altar) of', 'i')")
_snapshot_query("filter_description_regex", FrameFilter(description="a.u[mt]\\b"), r"regexp_matches(description, 'a.u[mt]\b', 'i')")
_snapshot_query("filter_equal", FrameFilter(facet_id="default", group_id="g001", user_id="ed01"), "\"facetId\" = 'default' and \"groupId\" = 'g001' and \"userId\" = 'ed01'")
for _how, _test in {"all_set": "flags & 3 = 3", "any_set": "flags & 3 <> 0", "all_clear": "flags & 3 = 0", "any_clear": "flags & 3 <> 3"}.items():
    _snapshot_query(f"filter_flags_{_how}", FrameFilter(flags=3, flag_match=_how), f"({_test})")
query("frame_items_page", f"select * from (select {_ITEM} from {_LATEST.format(t='history_items', w='true')} where r = 1 order by \"sortKey\", _id limit 20 offset 20) where _status is distinct from 2")(
    lambda s, d: _items(framing.snapshot(table(s, d, "history_items"), FrameFilter(page=2, page_size=20), False))
)


def _nested(df: DataFrame) -> DataFrame:
    part = lambda p: F.concat_ws("/", p["_id"], p["typeId"], F.coalesce(p["roleId"], F.lit("-")), p["_status"].cast("string"))
    return df.select("_id", "_status", F.array_join(F.transform("_parts", part), " ").alias("parts"))


def _frame_sql(items: str, part_where: str, deleted: bool = True) -> str:
    gone = "" if deleted else "and status is distinct from 2"
    return f"""with i as ({items}), p as (select "itemId" as k, string_agg("referenceId" || '/' || "typeId" || '/' || coalesce("roleId", '-') || '/' || status, ' ' order by "referenceId") as parts
  from {_LATEST.format(t="history_parts", w=part_where)} where r = 1 {gone} group by 1)
select i._id, i._status, coalesce(p.parts, '') as parts from i left join p on p.k = i._id"""


_ALL = f"select {_ITEM} from {_LATEST.format(t='history_items', w='true')} where r = 1"


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "history_items"), table(s, d, "history_parts")


query("frame_snapshot", _frame_sql(_ALL, "true"))(lambda s, d: _nested(framing.frame(*_both(s, d), FrameFilter())))
query("frame_snapshot_asof", _frame_sql(f"select {_ITEM} from {_LATEST.format(t='history_items', w=_UNTIL)} where r = 1 and status is distinct from 2", _UNTIL, False))(
    lambda s, d: _nested(framing.frame(*_both(s, d), FrameFilter(max_time=AS_OF), with_deleted=False))
)
query("frame_white_types", _frame_sql(_ALL, "(\"typeId\" = 'lapida.note' and \"roleId\" is null or \"typeId\" = 'lapida.token-text' and \"roleId\" = 'base-text')"))(
    lambda s, d: _nested(framing.frame(*_both(s, d), FrameFilter(white_types=("lapida.note", "lapida.token-text:base-text"))))
)
query("frame_black_types", _frame_sql(_ALL, "\"typeId\" not in ('lapida.token-text', 'lapida.note')"))(
    lambda s, d: _nested(framing.frame(*_both(s, d), FrameFilter(black_types=("lapida.token-text", "lapida.note:x"))))
)
_IN = f"\"timeModified\" between timestamp '{FROM}' and timestamp '{TO}'"


def _incremental_sql(attributes: str, parts: bool) -> str:
    union = f'union select "itemId", false from history_parts where {_IN}' if parts else ""
    return f"""with k as (select k, bool_or(own) as own from (select "referenceId" as k, true as own from history_items where {_IN} and {attributes} {union}) where k is not null group by 1)
select l."referenceId" as _id, l.title, case when l.status = 0 and not k.own then 1 else l.status end as _status, l."sortKey", l.flags
from {_LATEST.format(t='history_items', w='true')} l join k on k.k = l."referenceId" where l.r = 1"""


query("frame_incremental", _incremental_sql("true", True))(lambda s, d: _items(framing.incremental(*_both(s, d), FrameFilter(min_time=FROM, max_time=TO))))
query("frame_incremental_filtered", _incremental_sql("\"facetId\" = 'default'", True))(lambda s, d: _items(framing.incremental(*_both(s, d), FrameFilter(facet_id="default", min_time=FROM, max_time=TO))))
query("frame_incremental_nopartdate", _incremental_sql("true", False))(lambda s, d: _items(framing.incremental(*_both(s, d), FrameFilter(min_time=FROM, max_time=TO), part_date=False)))
query("frame_incremental_nested", _frame_sql(f"select _id, _status from ({_incremental_sql('true', True)})", _IN))(lambda s, d: _nested(framing.frame(*_both(s, d), FrameFilter(min_time=FROM, max_time=TO))))
query("frame_parts", f"select \"referenceId\" as _id, \"itemId\", \"typeId\", \"roleId\", status as _status from {_LATEST.format(t='history_parts', w=_UNTIL)} where r = 1 and status is distinct from 2")(
    lambda s, d: framing.parts_of(table(s, d, "history_parts"), FrameFilter(max_time=AS_OF), with_deleted=False).select("_id", "itemId", "typeId", "roleId", "_status")
)
query("dump_chunks", f"select cast((row_number() over (order by \"sortKey\", _id) - 1) // 100 as bigint) as chunk, _id from ({_ALL})")(
    lambda s, d: framing.chunked(_items(framing.snapshot(table(s, d, "history_items"), FrameFilter())), ["sortKey", "_id"], 100).select("chunk", "_id")
)
query("source_item_ids", "select distinct _id from items where \"facetId\" = 'default' and _id is not null")(lambda s, d: table(s, d, "items").where(FrameFilter(facet_id="default").attributes() & F.col("_id").isNotNull()).select("_id").distinct())
query("import_patched", """select distinct _id, coalesce(nullif("facetId", ''), 'default') as "facetId", coalesce(nullif(title, ''), _id) as title, coalesce(description, '') as description, coalesce(nullif("userId", ''), 'zeus') as "userId" from items""")(
    lambda s, d: framing.items_patched(table(s, d, "items")).select("_id", "facetId", "title", "description", "userId").distinct()
)
query("import_ensured_parts", """with p as (select distinct _id, "itemId", "typeId", "roleId" from parts), i as (select distinct _id from items)
select * from p union all select _id || '/lapida.note/internal', _id, 'lapida.note', 'internal' from i where _id not in (select "itemId" from p where "typeId" = 'lapida.note' and "roleId" = 'internal' and "itemId" is not null)""")(
    lambda s, d: framing.ensure_parts(table(s, d, "items").dropDuplicates(["_id"]), table(s, d, "parts").select("_id", "itemId", "typeId", "roleId").distinct(), "lapida.note", "internal")
)
query("flag_metadata", """select distinct _id, flags, case when coalesce(flags, 0) = 0 then '' else array_to_string(list_sort(list_filter([
  case when flags & 1 = 1 then 'state=draft' when flags & 3 = 0 then 'state=final' end, case when flags & 8 = 8 then 'checked=yes' end], lambda x: x is not null)), ' ') end as metadata from items""")(
    lambda s, d: framing.flag_metadata(table(s, d, "items").select("_id", "flags").distinct(), "flags", {"1": "state=draft", "h8": "checked=yes"}, {"3": "state=final"}).select(
        "_id", "flags", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("metadata")
    )
)


# graph and RDF

def _decoded(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triple").distinct()
    return graph.decode(t, graph.uris(table(s, d, "node")))


_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in PREFIXES.items())
_FULL = "case when {c} like '%:%' and (case split_part({c}, ':', 1) " + _MAP + " end) is not null then (case split_part({c}, ':', 1) " + _MAP + " end) || {c}[strpos({c}, ':') + 1:] else {c} end"
_DECODED = """with u as (select id, min(label) as uri from node where label is not null and id is not null group by 1),
t as (select distinct * from triple), d as (select t.*, s.uri as s, p.uri as p, o.uri as o from t left join u s on s.id = s_id left join u p on p.id = p_id left join u o on o.id = o_id)"""
_ESC = r"""replace(replace(replace(replace(replace({c}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
_LIT = f"""'"' || {_ESC.format(c="o_lit")} || '"' || case when o_lit_lang <> '' then '@' || o_lit_lang when o_lit_type <> '' then '^^' || {{kind}} else '' end"""
query("graph_decode", f"{_DECODED} select id, s, p, o, o_lit from d")(lambda s, d: _decoded(s, d).select("id", "s", "p", "o", "o_lit"))
query("graph_curie", f"select distinct id, {_FULL.format(c='label')} as uri from node where label is not null")(lambda s, d: table(s, d, "node").where("label is not null").select("id", graph.expand(F.col("label"), PREFIXES).alias("uri")).distinct())
query("graph_referenced_nodes", "select distinct id, label, tag from node where id in (select s_id from triple where s_id is not null union select o_id from triple where o_id is not null)")(
    lambda s, d: graph.referenced_nodes(table(s, d, "node"), table(s, d, "triple")).select("id", "label", "tag").distinct()
)
query("graph_tagged", "select distinct id, s_id, p_id from triple where tag in ('imp', 'auto')")(lambda s, d: graph.tagged(table(s, d, "triple"), ["imp", "auto"]).select("id", "s_id", "p_id").distinct())
query("graph_count", "select count(*) as n from triple where tag = 'imp'")(lambda s, d: graph.tagged(table(s, d, "triple"), ["imp"]).agg(F.count("*").alias("n")))
query("graph_stats", "with t as (select distinct * from triple) select count(*) as triples, count(*) filter (o_lit <> '') as literals, count(*) filter (coalesce(o_lit, '') = '' and o_id is not null) as resources, count(distinct s_id) as subjects, count(distinct p_id) as predicates, count(distinct o_id) as objects from t")(
    lambda s, d: graph.statistics(table(s, d, "triple").distinct())
)
query("graph_invalid", """with u as (select id from node where label is not null), r as (select distinct id, 'subject' as place, s_id as ref from triple union select id, 'predicate', p_id from triple union select id, 'object', o_id from triple)
select * from r where ref is not null and ref not in (select id from u where id is not null)""")(lambda s, d: graph.invalid(table(s, d, "triple"), graph.uris(table(s, d, "node"))))
query("graph_find", f"{_DECODED} select id, s, o from d where p = 'lv:isA' and o = 'lv:stele'")(lambda s, d: graph.find(_decoded(s, d), PREFIXES, p="http://lv.example.org/vocabulary#isA", o="lv:stele").select("id", "s", "o"))
query("graph_closure", """with recursive t as (select distinct s_id, p_id, o_id from triple where s_id is not null and o_id is not null),
c as (select s_id as id, o_id as class_id, 1 as level, [o_id] as path from t where p_id = 119
 union all select c.id, t.o_id, level + 1, list_append(path, t.o_id) from c join t on t.s_id = c.class_id and t.p_id = 120 where not list_contains(path, t.o_id))
select id, class_id, min(level) as level from c group by 1, 2""")(lambda s, d: graph.class_closure(table(s, d, "triple"), 119, 120))
query("graph_namespaces", f"""select id, uri, case when uri like 'http://lv.example.org/vocabulary#%' then 'lv' else 'x' end as prefix from (select id, min({_FULL.format(c='label')}) as uri from node where label is not null group by 1)
where regexp_matches(uri, '^http://lv\\.example\\.org/vocabulary#[A-Za-z_][A-Za-z0-9._-]*$') or regexp_matches(uri, '^http://data\\.example\\.org/[A-Za-z_][A-Za-z0-9._-]*$')""")(
    lambda s, d: graph.node_labels_by_prefix(graph.uris(table(s, d, "node")).withColumn("uri", graph.expand(F.col("uri"), PREFIXES)), graph.namespaces(s, PREFIXES))
)
_KIND = "case when o_lit_type like '%:%' and o_lit_type not like 'http%' then {short} else '<' || o_lit_type || '>' end"
_TERM = "case when {c} like '%:%' and {c} not like 'http%' then {c} else '<' || " + _FULL + " || '>' end"
_TTL = f"{_DECODED} select id, line from (select id, {_TERM.format(c='s')} || ' ' || {_TERM.format(c='p')} || ' ' || case when o_lit <> '' then {_LIT.format(kind=_KIND.format(short='o_lit_type'))} else {_TERM.format(c='o')} end || ' .' as line from d) where line is not null"
_NT = f"{_DECODED} select id, line from (select id, '<' || {_FULL.format(c='s')} || '> <' || {_FULL.format(c='p')} || '> ' || case when o_lit <> '' then {_LIT.format(kind=_KIND.format(short=chr(39) + '<' + chr(39) + ' || ' + _FULL.format(c='o_lit_type') + ' || ' + chr(39) + '>' + chr(39)))} else '<' || {_FULL.format(c='o')} || '>' end || ' .' as line from d) where line is not null"
query("rdf_turtle", _TTL)(lambda s, d: rdf.turtle(_decoded(s, d), PREFIXES))
query("rdf_ntriples", _NT)(lambda s, d: rdf.ntriples(_decoded(s, d), PREFIXES))
_Q = f"""'"' || {_ESC} || '"'"""
query("rdf_jsonld", f"""{_DECODED}, v as (select s_id, s, p, id, case when o_lit <> '' then '{{"@value": ' || {_Q.format(c='o_lit')} || case when o_lit_lang <> '' then ', "@language": ' || {_Q.format(c='o_lit_lang')} when o_lit_type <> '' then ', "@type": ' || {_Q.format(c='o_lit_type')} else '' end || '}}'
  else '{{"@id": ' || {_Q.format(c='o')} || '}}' end as v from d),
g as (select s_id, s, p, min(id) as first, string_agg(v, ', ' order by id, v) as vs, count(*) as n from v where v is not null and s is not null and p is not null group by 1, 2, 3)
select s_id, '{{"@id": ' || {_Q.format(c='s')} || ', ' || string_agg({_Q.format(c='p')} || ': ' || case when n = 1 then vs else '[' || vs || ']' end, ', ' order by first, p) || '}}' as node from g group by s_id, s""")(lambda s, d: rdf.jsonld(_decoded(s, d)))
_XA = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_XE = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _xml_sql(element: str) -> str:
    attr = f"case when o_lit_lang <> '' then ' xml:lang=\"' || {_XA.format(c='o_lit_lang')} || '\"' when o_lit_type <> '' then ' rdf:datatype=\"' || {_XA.format(c=_FULL.format(c='o_lit_type'))} || '\"' else '' end"
    return f"""{_DECODED}, x as (select s_id, s, id, case when o_lit <> '' then '<' || p || {attr} || '>' || {_XE.format(c='o_lit')} || '</' || p || '>'
  when o is not null then '<' || p || ' rdf:resource="' || {_XA.format(c=_FULL.format(c='o'))} || '" />' else '<' || p || ' />' end as x from d where s is not null and p is not null)
select s_id, '<{element} rdf:about="' || {_XA.format(c=_FULL.format(c='s'))} || '">' || string_agg(x, '' order by id, x) || '</{element}>' as xml from x group by s_id, s"""


query("rdf_xml", _xml_sql("rdf:Description"))(lambda s, d: rdf.xml_subjects(_decoded(s, d), PREFIXES))
query("rdf_owl", _xml_sql("owl:NamedIndividual"))(lambda s, d: rdf.xml_subjects(_decoded(s, d), PREFIXES, "owl:NamedIndividual"))
for _form in ("turtle", "ntriples", "jsonld", "rdfxml", "owlxml"):
    query(f"rdf_document_{_form}")(lambda s, d, form=_form: rdf.document(_decoded(s, d), PREFIXES, form).select(F.col("n.part").alias("part"), F.col("n.k").alias("k"), "line"))


query("graph_page", "select id, s_id from (select distinct * from triple) order by id, s_id limit 100 offset 200")(lambda s, d: graph.page(table(s, d, "triple").distinct().where("id is not null"), 200, 100).select("id", "s_id"))
query("graph_properties", "select distinct id, data_type, description from property")(lambda s, d: table(s, d, "property").select("id", "data_type", "description").distinct())
query("graph_is_uri", r"""select distinct id, coalesce(regexp_full_match(label, '[A-Za-z][A-Za-z0-9+.-]*:[^\s<>"{}|\\^`]+'), false) as ok from node""".replace("\\\\", "\\"))(lambda s, d: table(s, d, "node").select("id", graph.is_uri(F.col("label")).alias("ok")).distinct())


def _document_sql(head: list[str], body: str, foot: list[str], comma: bool = False) -> str:
    """SQL of a document: fixed lines around (k, line) of a body."""
    rows = ", ".join("({}, {}, '{}')".format(part, i, x.replace("'", "''")) for part, xs in ((0, head), (2, foot)) for i, x in enumerate(xs))
    line = "line || case when k = max(k) over () then '' else ',' end" if comma else "line"
    return f"select cast(part as int) as part, cast(k as bigint) as k, line from (values {rows}) as t(part, k, line) union all select 1, cast(k as bigint), {line} from ({body})"


_SAID = ["RDF data exported from the graph", "Export date: "]
_SPACES = {"rdf": rdf.RDF} | PREFIXES
ORACLES["rdf_document_turtle"] = _document_sql([*(f"@prefix {k}: <{v}> ." for k, v in PREFIXES.items()), "", *(f"# {x}" for x in _SAID), ""], f"select id as k, line from ({_TTL})", ["", "# End of RDF data"])
ORACLES["rdf_document_ntriples"] = _document_sql([f"# {x}" for x in _SAID], f"select id as k, line from ({_NT})", ["# End of RDF data"])
ORACLES["rdf_document_jsonld"] = _document_sql(["{", f'  "@comment": "{"; ".join(_SAID)}",', '  "@context": {' + ", ".join(f'"{k}": "{v}"' for k, v in PREFIXES.items()) + "},", '  "@graph": ['], f"select s_id as k, node as line from ({ORACLES['rdf_jsonld']})", ["  ]", "}"], True)
for _name, _element, _ns in (("rdfxml", "rdf:Description", _SPACES), ("owlxml", "owl:NamedIndividual", {"rdf": rdf.RDF, "owl": rdf.OWL} | PREFIXES)):
    ORACLES[f"rdf_document_{_name}"] = _document_sql(['<?xml version="1.0" encoding="utf-8"?>', "<rdf:RDF " + " ".join(f'xmlns:{k}="{v}"' for k, v in _ns.items()) + ">", *(f"<!-- {x} -->" for x in _SAID)], f"select s_id as k, xml as line from ({_xml_sql(_element)})", ["</rdf:RDF>"])


# layered texts

def _parts(s: SparkSession, d: str) -> DataFrame:
    return texts.current(table(s, d, "parts"))


def _layers(s: SparkSession, d: str):
    return texts.layered(table(s, d, "parts"))


def _roles(segments: DataFrame) -> DataFrame:
    """Segments whose features are the roles of their fragments."""
    roles = F.array_distinct(F.transform("fragment_ids", lambda x: F.struct(F.lit("role").alias("name"), F.regexp_extract(x, ":(.*)@", 1).alias("value"))))
    return segments.withColumn("features", roles)


def _pieces(segments: DataFrame) -> DataFrame:
    return texts.with_lines(texts.block_lines(segments))


_CURRENT = """p as (select * from (select *, row_number() over (partition by _id order by "timeModified" desc nulls last, "arrivedAt" desc nulls last, content desc nulls last, "itemId" desc nulls last, "roleId" desc nulls last) as r from parts where _id is not null) where r = 1),
b as (select item_id, part_id, lines, array_to_string(lines, chr(10)) as text from (select "itemId" as item_id, _id as part_id, from_json(json_extract(content, '$.lines[*].text'), '["VARCHAR"]') as lines, row_number() over (partition by "itemId" order by _id) as q
  from p where "roleId" = 'base-text' and "itemId" is not null and json_type(content, '$.lines') = 'ARRAY') where q = 1)"""
_FRS = """, f as (select item_id, part_id, role_id, type_id, unnest(range(len(js))) as fr_index, unnest(js) as fr from (
  select "itemId" as item_id, _id as part_id, "roleId" as role_id, "typeId" as type_id, from_json(case json_type(content, '$.fragments') when 'OBJECT' then '[' || json_extract(content, '$.fragments') || ']' else json_extract(content, '$.fragments') end, '["JSON"]') as js
  from p where starts_with("roleId", 'fr.') and "itemId" is not null)),
g as (select item_id, type_id || ':' || role_id || '@' || fr_index as fr_id, json_extract_string(fr, '$.location') as loc from f where json_type(fr) = 'OBJECT')"""
_RE = r"^(\d+)\.(\d+)(?:@(\d+)(?:x(\d+))?)?(?:-(\d+)\.(\d+)(?:@(\d+)(?:x(\d+))?)?)?$"


def _point_sql(g: int, last: bool) -> str:
    n = lambda i: f"try_cast(regexp_extract(loc, '{_RE}', {g + i}) as int)"
    line = f"lines[{n(0)}]"
    before = f"coalesce(list_sum(list_transform(lines[1:{n(0)} - 1], lambda l: length(l) + 1)), 0)"
    start = f"least(length({line}), length(array_to_string(string_split({line}, ' ')[1:{n(1)} - 1], ' ')) + case when {n(1)} > 1 then 1 else 0 end)"
    if not last:
        out = f"{before} + {start} + coalesce({n(2)} - 1, 0)"
    else:
        out = f"{before} + {start} + case when {n(2)} is null then coalesce(length(string_split({line}, ' ')[{n(1)}]), 0) - 1 else {n(2)} - 1 + coalesce({n(3)}, 1) - 1 end"
    return f"case when {n(0)} >= 1 and {n(1)} >= 1 and {n(0)} <= len(lines) then {out} end"


_RANGES = f""", r as (select * from (select item_id, fr_id, cast({_point_sql(1, False)} as int) as "start", cast(case when regexp_extract(loc, '{_RE}', 5) = '' then {_point_sql(1, True)} else {_point_sql(5, True)} end as int) as "end" from g join b using (item_id)) where "start" <= "end")"""
_SEGS = """, k as (select r.item_id, fr_id, greatest(0, "start") as a, least(length(text) - 1, "end") as z from r join b using (item_id)),
x as (select distinct item_id, pos from (select item_id, unnest([0, length(text)]) as pos from b where length(text) > 0 union all select item_id, unnest([a, z + 1]) from k where a <= z)),
y as (select item_id, pos as "start", lead(pos) over w - 1 as "end", row_number() over w as n from x window w as (partition by item_id order by pos)),
s as (select y.item_id, n, "start", "end", coalesce(list_sort(list(distinct fr_id) filter (fr_id is not null)), []) as ids, any_value(text) as body from y join b using (item_id) left join k on k.item_id = y.item_id and a <= "end" and z >= "start" and a <= z where "end" is not null group by all),
t as (select item_id, cast(n as int) as n, cast("start" as int) as "start", cast("end" as int) as "end", ids, substr(body, "start" + 1, "end" - "start" + 1) as text, substr(body, "end" + 2, 1) = chr(10) as eol from (select * from s))"""
_TEXT = f"with {_CURRENT}{_FRS}{_RANGES}{_SEGS}"
query("text_base", f"with {_CURRENT} select item_id, part_id, text from b")(lambda s, d: texts.base_texts(_parts(s, d)).select("item_id", "part_id", "text"))
query("text_locations", f"with {_CURRENT}{_FRS}{_RANGES} select * from r")(lambda s, d: (lambda p: texts.flatten(texts.base_texts(p), texts.layer_fragments(p)))(_parts(s, d)))
query("text_consecutive", f"{_TEXT} select item_id, n, \"start\", \"end\", array_to_string(ids, ' ') as ids, text, eol from t")(lambda s, d: _layers(s, d)[2].select("item_id", "n", "start", "end", F.array_join("fragment_ids", " ").alias("ids"), "text", "eol"))
query("text_merge_linear", f"""{_TEXT}, q as (select item_id, n, text, array_to_string(list_sort(list_distinct(list_transform(ids, lambda i: regexp_extract(i, ':(.*)@', 1)))), ' ') as roles from t),
c as (select *, case when lag(roles) over w is distinct from roles or coalesce(ends_with(lag(text) over w, chr(10)), false) then 1 else 0 end as cut from q window w as (partition by item_id order by n)),
i as (select *, sum(cut) over (partition by item_id order by n) as island from c)
select item_id, min(n) as n, string_agg(text, '' order by n) as text, any_value(roles) as roles from i group by item_id, island""")(
    lambda s, d: texts.merge_linear(_roles(_layers(s, d)[2]), ("role",)).select("item_id", "n", "text", F.array_join(F.array_sort(F.transform("features", lambda f: f["value"])), " ").alias("roles"))
)
_PIECES = """, l as (select item_id, n, ids, unnest(range(len(ps))) as k, unnest(ps) as piece, len(ps) as size, "start", "end" from (select *, string_split(text, chr(10)) as ps from t)),
m as (select *, sum(case when piece <> '' then 1 else 0 end) over (partition by item_id order by n, k rows unbounded preceding) as grp from l),
o as (select item_id, grp, max(n) filter (piece <> '') as n, max(k) filter (piece <> '') as k, max(piece) filter (piece <> '') as text, any_value(ids) filter (piece <> '') as ids, any_value("start") filter (piece <> '') as "start", any_value("end") filter (piece <> '') as "end", bool_or(k < size - 1) as eol from m where grp > 0 group by 1, 2),
z as (select *, cast(1 + coalesce(sum(case when eol then 1 else 0 end) over (partition by item_id order by grp rows between unbounded preceding and 1 preceding), 0) as int) as y from o)"""
query("text_block_lines", f"{_TEXT}{_PIECES} select item_id, n, cast(k as int) as k, text, eol, y from z")(lambda s, d: _pieces(_layers(s, d)[2]).select("item_id", "n", "k", "text", "eol", "y"))
query("text_first_run", f"""{_TEXT}, h as (select item_id, n, len(ids) > 0 as hit, lag(len(ids) > 0) over (partition by item_id order by n) as before from t), q as (select *, sum(case when hit and not coalesce(before, false) then 1 else 0 end) over (partition by item_id order by n) as run from h)
select item_id, min(n) as first, max(n) as last from q where hit and run = 1 group by 1""")(lambda s, d: texts.first_run(_layers(s, d)[2], F.size("fragment_ids") > 0))
query("text_dense_ids", """select "itemId", "typeId", row_number() over (partition by "itemId" order by f, i, "typeId") as id from (select "itemId", "typeId", min("timeCreated") as f, arg_min(_id, ("timeCreated", _id)) as i from parts where "itemId" is not null and "timeCreated" is not null and _id is not null group by 1, 2)""")(
    lambda s, d: texts.dense_ids(table(s, d, "parts").where("itemId is not null and timeCreated is not null and _id is not null"), ["itemId"], "typeId", ["timeCreated", "_id"])
)
_XT = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_AT = """case json_type({0}) when 'ARRAY' then from_json({0}, '["JSON"]') when 'OBJECT' then [{0}] else cast([] as json[]) end"""
_ENTRIES = f""", af as (select item_id, part_id, fr_index, type_id || ':' || role_id || '@' || fr_index as fr_id, fr from f where json_type(fr) = 'OBJECT' and ends_with(role_id, 'apparatus')),
ae as (select item_id, part_id, fr_id, k as entry_index, x from (select *, unnest(range(len(l))) as k, unnest(l) as x from (select *, {_AT.format("json_extract(fr, '$.entries')")} as l from af)) where json_type(x) = 'OBJECT'),
ap as (select item_id, part_id, fr_id, cast(entry_index as int) as entry_index, coalesce(cast(json_extract(x, '$.type') as int), 0) as type, x ->> '$.value' as value, coalesce(cast(json_extract(x, '$.isAccepted') as boolean), false) as accepted, x ->> '$.tag' as tag,
  list_transform(list_filter({_AT.format("json_extract(x, '$.witnesses')")}, lambda e: json_type(e) = 'OBJECT'), lambda e: e ->> '$.value') as ws, list_transform(list_filter({_AT.format("json_extract(x, '$.authors')")}, lambda e: json_type(e) = 'OBJECT'), lambda e: e ->> '$.value') as rs from ae),
so as (select item_id, part_id, fr_id, entry_index, type, value, unnest(list_concat(list_transform(ws, lambda e: 'w:' || e), list_transform(rs, lambda e: 'a:' || e))) as tag from ap),
rd as (select item_id, tag, fr_id, arg_min(type, (part_id, entry_index)) as type, arg_min(struct_pack(v := value), (part_id, entry_index)) as sv from so where tag is not null group by all),
tg as (select distinct item_id, tag from so where tag is not null union select distinct item_id, '' from t),
vs as (select t.item_id, tg.tag, t.n, case when rd.fr_id is null or rd.type = 3 then t.text else coalesce(rd.sv.v, '') end as text from t join tg using (item_id)
  left join rd on rd.item_id = t.item_id and rd.tag = tg.tag and rd.fr_id = list_filter(t.ids, lambda x: contains(x, 'apparatus@'))[1])"""
query("text_versions", f"{_TEXT}{_ENTRIES} select item_id, tag, n, text from vs")(lambda s, d: (lambda b, f, g: texts.versions(g, texts.apparatus_entries(f)))(*_layers(s, d)))
_TREE = f"""{_TEXT.replace('with p as', 'with recursive p as', 1)}{_ENTRIES}, ch as (select item_id, tag, n, text, sha256('/' || text) as node, cast(null as varchar) as parent from vs where n = 1
  union all select vs.item_id, vs.tag, vs.n, vs.text, sha256(ch.node || '/' || vs.text), ch.node from ch join vs on vs.item_id = ch.item_id and vs.tag = ch.tag and vs.n = ch.n + 1),
tr as (select item_id, n, node, parent, text, array_to_string(list_sort(list(distinct tag)), ' ') as tags from ch group by item_id, n, node, parent, text)"""
query("text_version_tree", f"{_TREE} select * from tr")(lambda s, d: (lambda b, f, g: texts.version_tree(texts.versions(g, texts.apparatus_entries(f))))(*_layers(s, d)).withColumn("tags", F.array_join("tags", " ")))
query("text_apparatus", f"with {_CURRENT}{_FRS}{_ENTRIES.partition('\nso as')[0].rstrip(',')} select item_id, fr_id, entry_index, type, value, accepted, tag, array_to_string(ws, ' ') as witnesses, array_to_string(rs, ' ') as authors from ap")(lambda s, d: texts.apparatus_entries(texts.layer_fragments(_parts(s, d))).select("item_id", "fr_id", "entry_index", "type", "value", "accepted", "tag", *[F.array_join(F.transform(c, lambda x: x["value"]), " ").alias(c) for c in ("witnesses", "authors")]))
query("render_payload_lines", f"""{_TEXT}{_PIECES}, j as (select item_id, y, '[' || string_agg('{{"start":' || "start" || ',"end":' || "end" || ',"fragmentIds":' || to_json(ids) || ',"text":' || to_json(text) || '}}', ',' order by n, k) || ']' as x from z group by 1, 2)
select item_id, '[' || string_agg(x, ',' order by y) || ']' as json from j group by 1""")(lambda s, d: render.payload_lines(_pieces(_layers(s, d)[2])))
query("render_tei_standoff", f"""{_TEXT}{_PIECES}, w as (select item_id, n, row_number() over (partition by item_id order by n) as seg from (select distinct item_id, n from z where len(ids) > 0)),
v as (select z.item_id, y, z.n, k, case when seg is not null then '<seg xml:id="seg' || seg || '">' || {_XT.format(c='text')} || '</seg>' else {_XT.format(c='text')} end as x from z left join w on w.item_id = z.item_id and w.n = z.n),
u as (select item_id, y, '<p source="^' || item_id || '" n="' || y || '" xmlns="http://www.tei-c.org/ns/1.0">' || string_agg(x, '' order by n, k) || '</p>' as x from v group by item_id, y)
select item_id, string_agg(x, '' order by y) as xml from u group by 1""")(lambda s, d: render.tei_standoff(_pieces(_layers(s, d)[2])))


def _apps(s: SparkSession, d: str, **options) -> tuple[DataFrame, DataFrame]:
    _, frs, segments = _layers(s, d)
    return segments, render.apparatus(segments, texts.apparatus_entries(frs), **options)


_XB = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _attr_sql(name: str, value: str) -> str:
    return f"""coalesce(' {name}="' || {_XB.format(c=f"({value})")} || '"', '')"""


def _apparatus_sql(zero: bool, located: bool) -> str:
    """SQL of (item_id, fr_id, first, last, xml) of apparatus fragments."""
    objects = lambda path: f"list_filter({_AT.format(path)}, lambda e: json_type(e) = 'OBJECT')"
    notes = lambda c: f"list_filter({c}, lambda e: e ->> '$.note' <> '')"
    refs = lambda c: f"nullif(array_to_string(list_transform({c}, lambda e: '#' || (e ->> '$.value')), ' '), '')"
    detail = lambda c, n: f"""array_to_string(list_transform({notes(c)}, lambda e: '<witDetail target="#' || target || '" {n}="#' || {_XB.format(c="(e ->> '$.value')")} || '">' || {_XT.format(c="(e ->> '$.note')")} || '</witDetail>'), '')"""
    kind = "case when coalesce(value, '') = '' then concat_ws(' ', nullif(tag, ''), 'zero') else nullif(tag, '') end" if zero else "nullif(tag, '')"
    loc = f"""case when first = last then ' loc="#seg' || first || '"' else '' end""" if located else "''"
    span = f"""case when first <> last then '<loc spanFrom="#seg' || first || '" spanTo="#seg' || last || '" />' else '' end""" if located else "''"
    return f"""{_TEXT}{_ENTRIES.partition('\nso as')[0].rstrip(',')}, hd as (select item_id, n, text, unnest(ids) as fr_id from t),
ru as (select *, n - row_number() over (partition by item_id, fr_id order by n) as base from hd where contains(fr_id, 'apparatus@')),
lm as (select item_id, fr_id, min(n) as first, max(n) as last, string_agg(text, '' order by n) as lemma from (select *, min(base) over (partition by item_id, fr_id) as b0 from ru) where base = b0 group by 1, 2),
en as (select item_id, part_id, fr_id, cast(regexp_extract(fr_id, '@([0-9]+)$', 1) as int) as fr_index, entry_index, case when coalesce(cast(json_extract(x, '$.isAccepted') as boolean), false) then 'lem' else 'rdg' end as el, x ->> '$.value' as value, x ->> '$.tag' as tag, x ->> '$.note' as note,
  {objects("json_extract(x, '$.witnesses')")} as ws, {objects("json_extract(x, '$.authors')")} as rs, first, last, lemma from ae join lm using (item_id, fr_id)),
fn as (select *, len({notes('ws')}) + len({notes('rs')}) > 0 as noted from en),
nu as (select *, el || sum(case when noted then 1 else 0 end) over (partition by item_id, el order by fr_index, part_id, entry_index rows unbounded preceding) as target from fn),
on_ as (select *, '<' || el || {_attr_sql('type', kind)} || ' n="' || (entry_index + 1) || '"' || case when noted then ' xml:id="' || target || '"' else '' end || {_attr_sql('wit', refs('ws'))} || {_attr_sql('resp', refs('rs'))} || '>'
  || {_XT.format(c="(case when el = 'lem' then lemma else coalesce(value, '') end)")} || case when note <> '' then '<note>' || {_XT.format(c='note')} || '</note>' else '' end || '</' || el || '>' || {detail('ws', 'wit')} || {detail('rs', 'resp')} as one from nu),
tg as (select item_id, part_id, fr_id, fr ->> '$.tag' as fr_tag from af)
select item_id, fr_id, first, last, '<app n="' || (fr_index + 1) || '"' || {_attr_sql('type', "nullif(fr_tag, '')")} || {loc} || '>' || {span} || string_agg(one, '' order by entry_index, one) || '</app>' as xml
from on_ join tg using (item_id, part_id, fr_id) group by item_id, fr_id, fr_index, fr_tag, first, last"""


query("render_apparatus", _apparatus_sql(True, False))(lambda s, d: _apps(s, d, zero_type="zero")[1])
query("render_apparatus_standoff", _apparatus_sql(False, True))(lambda s, d: _apps(s, d, located=True)[1])
query("render_tei_apparatus", f"""with aa as ({_apparatus_sql(False, False)}), zz as ({_TEXT}{_PIECES} select item_id, n, k, y, text, list_filter(ids, lambda x: contains(x, 'apparatus@'))[1] as fr_id from z),
v as (select zz.item_id, y, n, k, coalesce(aa.xml, {_XT.format(c='text')}) as x from zz left join aa on aa.item_id = zz.item_id and aa.fr_id = zz.fr_id),
u as (select item_id, y, '<p source="^' || item_id || '" n="' || y || '" xmlns="http://www.tei-c.org/ns/1.0">' || string_agg(x, '' order by n, k, x) || '</p>' as x from v group by item_id, y)
select item_id, string_agg(x, '' order by y) as xml from u group by 1""")(lambda s, d: (lambda g, a: render.tei_apparatus(_pieces(g), a))(*_apps(s, d)))
query("render_tei_parallel", f"""{_TREE}, va as (select item_id, n, text, min(case when tag = '' then '0' when starts_with(tag, 'w:') then '1' || tag else '2' || tag end) as rank from ch group by 1, 2, 3),
og as (select item_id, arg_min(text, n) as original from va where rank = '0' group by 1),
lv as (select item_id, n, case when count(*) = 1 then any_value({_XT.format(c='text')}) else '<app>' || string_agg(case when text = original then '<lem>' || {_XT.format(c='text')} || '</lem>' else '<rdg>' || {_XT.format(c='text')} || '</rdg>' end, '' order by rank, text) || '</app>' end as x from va left join og using (item_id) group by 1, 2)
select item_id, '<p n="1" xmlns="http://www.tei-c.org/ns/1.0">' || string_agg(x, '' order by n) || '</p>' as xml from lv group by 1""")(lambda s, d: (lambda b, f, g: render.tei_parallel(texts.version_tree(texts.versions(g, texts.apparatus_entries(f)))))(*_layers(s, d)))
query("compose_text_flows", f"""with {_CURRENT}, i as (select "referenceId" as _id, "groupId", "sortKey" from {_LATEST.format(t='history_items', w='true')} where r = 1 and status is distinct from 2),
c as (select coalesce(nullif("groupId", ''), 'default') as flow, row_number() over (partition by coalesce(nullif("groupId", ''), 'default') order by "sortKey", _id) as item_nr, text from i join b on b.item_id = i._id)
select flow, cast(item_nr as int) as item_nr, text from c union all select distinct flow, 0, '# ' || flow from c""")(
    lambda s, d: render.composed(framing.snapshot(table(s, d, "history_items"), FrameFilter(), False), texts.base_texts(_parts(s, d)).select("item_id", "text"), group_head="# {group}")
)


# text functions

query("scalar_iso639", """select doc_id, case when lang is null then null when not regexp_full_match(left(lang, 2), '[a-z]{2}') then 'in ^^' || lang || '.'
  else 'in ' || coalesce(map {'en': 'English', 'de': 'German', 'fr': 'French', 'ja': 'Japanese', 'zh': 'Chinese', 'un': 'un', 'xx': 'xx', 'it': 'Italian', 'es': 'Spanish; Castilian', 'ko': 'Korean', 'la': 'Latin'}[left(lang, 2)], left(lang, 2)) || lang[3:] || '.' end as x from documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", scalars.iso639(r"\^\^([a-z]{2})", 2)(F.concat(F.lit("in ^^"), F.col("lang"), F.lit("."))).alias("x"))
)
query("scalar_bcp47", """select doc_id, case lower(lang) when 'en' then 'English' when 'de' then 'German (any)' when 'fr' then 'French' when 'ja' then 'Japanese' when 'zh' then 'Chinese' else lang end || ' | German (Austria)' as x from documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", scalars.bcp47(custom={"de": "German (any)"})(F.concat(F.lit("^^"), F.col("lang"), F.lit(" | ^^de-AT"))).alias("x"))
)
query("scalar_append", "select distinct _id, case when length(description) > 0 then description || ' [end]' else description end as x from items")(lambda s, d: table(s, d, "items").select("_id", scalars.append(" [end]")(F.col("description")).alias("x")).distinct())
query("scalar_replacements", "select distinct _id, regexp_replace(replace(title, ' of ', ' / '), '(\\d+)$', '#\\1') as x from items")(lambda s, d: table(s, d, "items").select("_id", scalars.replacements([(" of ", " / ", False), (r"(\d+)$", "#$1", True)])(F.col("title")).alias("x")).distinct())
query("scalar_escape_literal", f"select distinct id, {_LIT.format(kind=_KIND.format(short='o_lit_type'))} as x from triple where o_lit <> ''")(lambda s, d: table(s, d, "triple").where("o_lit <> ''").select("id", rdf.literal().alias("x")).distinct())
_SPACE = "chr(32), chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288)"
# the place of each character after the last parenthesis tells whether it is searched; a sentence ends where a run of marks and spaces does
query("scalar_sentences", f"""with d as (select doc_id, replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' ') as t from documents where text <> ''),
c as (select doc_id, unnest(range(1, length(t) + 1)) as i, unnest(string_split(t, '')) as c from d),
b as (select *, coalesce(max(case when c = '(' then i end) over w, 0) > coalesce(max(case when c = ')' then i end) over w, 0) as black from c window w as (partition by doc_id order by i)),
m as (select *, not black and c in ('.', '?', '!', chr(894), '…') as mark, c in (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) as space from b),
r as (select *, sum(case when mark or space and not black then 0 else 1 end) over (partition by doc_id order by i) as run from m),
e as (select *, max(case when mark then 1 else 0 end) over (partition by doc_id, run order by i) as ended from r),
s as (select *, case when (mark or space and not black) and run > 0 and ended = 1 then 0 else 1 end as inside from e),
g as (select *, sum(case when inside = 1 and coalesce(prior, 1) = 0 then 1 else 0 end) over (partition by doc_id order by i) as g from (select *, lag(inside) over (partition by doc_id order by i) as prior from s)),
x as (select doc_id, g, string_agg(c, '' order by i) as s from g group by all),
y as (select doc_id, g, trim(s, array_to_string([{_SPACE}], '')) as s from x)
select d.doc_id, coalesce((select string_agg(s, chr(10) order by g) from y where y.doc_id = d.doc_id and s <> ''), '') as x from d""")(
    lambda s, d: table(s, d, "documents").where("text <> ''").select("doc_id", F.array_join(scalars.sentences(F.col("text")), "\n").alias("x"))
)
#: fixed values: plurals and their singulars, by hand
_PLURALS = {
    "cities": "city", "pies": "py", "ties": "ty", "ies": "ie", "wolves": "wolf", "ves": "ve", "heroes": "hero", "toes": "to", "glasses": "glass", "ses": "se", "boxes": "box", "xes": "xe", "churches": "church", "aches": "ach", "dishes": "dish", "ashes": "ash", "cats": "cat", "s": None, "glass": None, "sheep": None,
    "children": "child", "people": "person", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "oxen": "ox", "criteria": "criterion", "phenomena": "phenomenon", "data": "datum", "analyses": "analysis", "bases": "basis", "crises": "crisis", "theses": "thesis", "vertices": "vertex", "indices": "index", "matrices": "matrix", "appendices": "appendix",
}
_WORDS = ", ".join(f"('{k}', {'null' if v is None else chr(39) + v + chr(39)})" for k, v in _PLURALS.items())
query("scalar_singular", f"""with w as (select distinct unnest(string_split(lower(p_name), ' ')) as n from part), e(e, s) as (values ('ies', 'y'), ('ves', 'f'), ('oes', 'o'), ('ses', 's'), ('xes', 'x'), ('ches', 'ch'), ('shes', 'sh'), ('zs', 'z'), ('z', null))
select n || e as w, n || s as x from w, e where length(n) > 2 union all select * from (values {_WORDS})""")(
    lambda s, d: (lambda words: words.unionByName(s.createDataFrame([(k,) for k in _PLURALS], "w string")).select("w", scalars.singular(F.col("w")).alias("x")))(
        table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("n")).distinct().where("length(n) > 2").select(F.explode(F.transform(F.array(*[F.lit(x) for x in ("ies", "ves", "oes", "ses", "xes", "ches", "shes", "zs", "z")]), lambda e: F.concat("n", e))).alias("w"))
    )
)
query("scalar_file_name", r"""select distinct _id, regexp_replace(regexp_replace("sortKey" || '/a:b?. ', '[\\/:*?"<>|]', '_', 'g'), '[. ]+$', '') as x from items""")(lambda s, d: table(s, d, "items").select("_id", scalars.file_name(F.concat("sortKey", F.lit("/a:b?. "))).alias("x")).distinct())
query("scalar_template", "select distinct _id, 'Item ' || coalesce(title, '') || ' in ' || coalesce(\"groupId\", '') || ' {other}' as x from items")(
    lambda s, d: table(s, d, "items").select("_id", scalars.fill_template("Item {title} in {group} {other}", {"title": F.col("title"), "group": F.col("groupId")}).alias("x")).distinct()
)
query("scalar_source_ids", "select distinct _id, case \"facetId\" when 'default' then 'see facet1!' else 'see facet/' || \"facetId\" || '!' end as x from items where \"facetId\" is not null")(
    lambda s, d: table(s, d, "items").where("facetId is not null").select("_id", scalars.source_ids({"facet/default": 1})(F.concat(F.lit("see #[facet/"), F.col("facetId"), F.lit("]#!"))).alias("x")).distinct()
)
_KNOWN = """e as (select id as t, unnest(range(len(entries))) as ord, unnest(entries) as en from (select id, arg_max(entries, len(entries)) as entries from thesauri where id is not null and coalesce("targetId", '') = '' group by 1)),
k as (select t, cast(ord as int) as ord, en.id as id, en."value" as v from e where en is not null)"""
query("scalar_thesaurus_references", f"with {_KNOWN} select t || '|' || ord as key, 'see ' || coalesce(v, id) || '; ' || 'none' || '.' as text from k where id is not null and regexp_full_match(t, '[@_a-zA-Z0-9.-]+') and regexp_full_match(id, '[_a-zA-Z0-9.-]+')")(
    lambda s, d: (lambda e: scalars.thesaurus_references(e.where(r"id rlike '^[_a-zA-Z0-9.-]+$' and thesaurus_id rlike '^[@_a-zA-Z0-9.-]+$'").select(F.concat("thesaurus_id", F.lit("|"), F.col("ord").cast("string")).alias("key"), F.concat(F.lit("see $"), "thesaurus_id", F.lit(":"), "id", F.lit("; $no@en:none."), F.lit("")).alias("text")), "key", "text", e, r"\$([@_a-zA-Z0-9.-]+):([_a-zA-Z0-9-]+(?:\.[_a-zA-Z0-9-]+)*)"))(thesaurus.entries_of(table(s, d, "thesauri")))
)
query("scalar_thesaurus_references_all")(
    lambda s, d: (lambda e: scalars.thesaurus_references(e.where("id is not null").select(F.concat("thesaurus_id", F.lit("|"), F.col("ord").cast("string")).alias("key"), F.concat(F.lit("see $"), "thesaurus_id", F.lit(":"), "id", F.lit("; $no@en:none.")).alias("text")), "key", "text", e))(thesaurus.entries_of(table(s, d, "thesauri")))
)
query("scalar_features", """select distinct _id, case when flags & 1 = 1 then 'facet=' || coalesce("facetId", '-') || ' flag=odd' else 'facet=' || coalesce("facetId", '-') end as x, flags & 1 = 1 as odd from items where flags is not null""")(
    lambda s, d: table(s, d, "items").where("flags is not null").withColumn("f", scalars.add_feature(scalars.add_feature(F.array().cast(scalars.FEATURES), "facet", F.coalesce("facetId", F.lit("-"))), "flag", "odd"))
    .withColumn("f", F.when(F.col("flags").bitwiseAND(1) == 1, F.col("f")).otherwise(scalars.remove_features(F.col("f"), "flag"))).select("_id", F.array_join(F.transform("f", lambda f: F.concat(f["name"], F.lit("="), f["value"])), " ").alias("x"), scalars.has_feature(F.col("f"), "flag").alias("odd")).distinct()
)
query("json_decorate_fragments", f"""with {_CURRENT}{_FRS} select part_id, fr_index, '{{"_key":"' || type_id || ':' || role_id || '@' || fr_index || '",' || fr[2:] as fr from (select part_id, cast(fr_index as int) as fr_index, type_id, role_id, cast(fr as varchar) as fr from f where json_type(fr) = 'OBJECT')""")(
    lambda s, d: _parts(s, d).where("roleId like 'fr.%' and itemId is not null").select(F.col("_id").alias("part_id"), F.posexplode(scalars.decorate_fragments(F.from_json(texts.as_array(F.get_json_object("content", "$.fragments")), "array<string>"), F.col("typeId"), F.col("roleId"))).alias("fr_index", "fr")).where("fr is not null")
)


# vocabularies

def _entries(s: SparkSession, d: str) -> DataFrame:
    return thesaurus.entries_of(table(s, d, "thesauri")).where("id is not null").groupBy("thesaurus_id", "id").agg(F.min_by(F.struct("ord", "value"), "ord").alias("x")).select("thesaurus_id", F.col("x.ord").alias("ord"), "id", F.col("x.value").alias("value"))


def _half(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two vocabularies that overlap: every entry but the first three, with upper-case values; and every entry but the last ones."""
    e = _entries(s, d)
    return e.where("ord >= 3").withColumn("value", F.upper("value")), e.where("ord < 5")


_UNIQUE = f"with {_KNOWN}, q as (select t, id, min(ord) as ord, arg_min(v, ord) as v from k where id is not null group by 1, 2), s as (select t, id, ord, upper(v) as v from q where ord >= 3), g as (select * from q where ord < 5)"
query("thes_entries", f"with {_KNOWN} select t as thesaurus_id, ord, id, v as value from k")(lambda s, d: thesaurus.entries_of(table(s, d, "thesauri")))
query("thes_aliases", "select id, min(case when contains(\"targetId\", '@') then \"targetId\" else \"targetId\" || '@en' end) as target_id from thesauri where id is not null and \"targetId\" <> '' group by 1")(lambda s, d: thesaurus.aliases_of(table(s, d, "thesauri")))
query("thes_replace", f"{_UNIQUE} select t as thesaurus_id, ord, id, v as value from s union all select t, ord, id, v from g where t not in (select t from s)")(lambda s, d: thesaurus.merged(*_half(s, d), "replace"))
for _mode, _keep in (("patch", "true"), ("synch", "s.id is not null")):
    query(f"thes_{_mode}", f"""{_UNIQUE}, m as (select coalesce(g.t, s.t) as t, coalesce(g.id, s.id) as id, case when s.id is not null then s.v else g.v end as v, g.ord as go, s.ord as so from (select * from g where t in (select t from s)) g full join s on s.t = g.t and s.id = g.id where {_keep})
select t as thesaurus_id, cast(row_number() over (partition by t order by go nulls last, so nulls last) - 1 as int) as ord, id, v as value from m union all select t, ord, id, v from g where t not in (select t from s)""")(lambda s, d, mode=_mode: thesaurus.merged(*_half(s, d), mode))
query("thes_entry_ids", f"""with {_KNOWN}, a as (select id, min(case when contains("targetId", '@') then "targetId" else "targetId" || '@en' end) as target from thesauri where id is not null and "targetId" <> '' group by 1),
w as (select distinct t as thesaurus_id, v as value from k where v is not null union select a.id, k.v from a join k on k.t = a.target where v is not null)
select w.*, (select arg_min(k.id, k.ord) from k where k.t = coalesce(a.target, w.thesaurus_id) and k.v = w.value) as entry_id from w left join a on a.id = w.thesaurus_id""")(
    lambda s, d: (lambda e, a: thesaurus.entry_ids(e.select("thesaurus_id", "value").where("value is not null").unionByName(a.join(e, F.col("target_id") == e["thesaurus_id"]).where("value is not null").select(a["id"].alias("thesaurus_id"), "value")).distinct(), e, a))(thesaurus.entries_of(table(s, d, "thesauri")), thesaurus.aliases_of(table(s, d, "thesauri")))
)
query("thes_documents", """select distinct case when id = 'model-types@en' then 0 else 1 end as k, id, case when coalesce("targetId", '') <> '' then '{' || case when id is not null then '"id":' || to_json(id) || ',' else '' end || '"targetId":' || to_json("targetId") || '}'
  else '{' || case when id is not null then '"id":' || to_json(id) || ',' else '' end || '"entries":[' || array_to_string(list_transform(list_filter(coalesce(entries, []), lambda e: e is not null), lambda e: '{' || array_to_string(list_filter([case when e.id is not null then '"id":' || to_json(e.id) end, case when e."value" is not null then '"value":' || to_json(e."value") end], lambda x: x is not null), ',') || '}'), ',') || ']}' end as json from thesauri""")(lambda s, d: thesaurus.documents(table(s, d, "thesauri")).select(F.col("n.k").alias("k"), "id", "json"))


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Thesauri in their first row by id and, as source, those whose id has an even length, entries turned round, with aliases of the others to them."""
    t = table(s, d, "thesauri").where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce(F.size("entries"), F.lit(-1)).alias("n"), "entries", "targetId")).alias("x")).select("id", "x.entries", "x.targetId")
    t = t.withColumn("entries", F.when(F.coalesce("targetId", F.lit("")) == "", F.array_distinct(F.filter("entries", lambda e: e.isNotNull() & e["id"].isNotNull()))))
    new = t.where(F.length("id") % 2 == 0).withColumn("entries", F.reverse("entries")).unionByName(t.where((F.length("id") % 3 == 0) & (F.length("id") % 2 == 1)).select("id", F.lit(None).cast(thesaurus.ENTRIES).alias("entries"), F.lit("new@en").alias("targetId")))
    return new, t


query("thes_merged_replace", """with t as (select id, entries, "targetId" from (select *, row_number() over (partition by id order by case when entries is null then -1 else len(entries) end desc, entries desc nulls last, "targetId" desc nulls last) as r from thesauri where id is not null) where r = 1),
c as (select id, case when coalesce("targetId", '') = '' then list_filter(entries, lambda e: e is not null and e.id is not null) end as entries, "targetId" from t),
n as (select id, list_reverse(entries) as entries, "targetId" from c where length(id) % 2 = 0 union all select id, null, 'new@en' from c where length(id) % 3 = 0 and length(id) % 2 = 1),
m as (select * from n union all select * from c where id not in (select id from n))
select id, coalesce(nullif("targetId", ''), '') as target_id, case when coalesce("targetId", '') <> '' then '' else array_to_string(list_transform(coalesce(entries, []), lambda e: e.id), ' ') end as entries from m""")(
    lambda s, d: thesaurus.merged_thesauri(*_two(s, d), "replace").select("id", F.coalesce("targetId", F.lit("")).alias("target_id"), F.array_join(F.transform("entries", lambda e: e["id"]), " ").alias("entries"))
)
query("rdf_line_statistics", f"select 8 as header_lines, count(*) as output_lines, 2 as footer_lines from ({_TTL})")(lambda s, d: rdf.line_statistics(rdf.document(_decoded(s, d), PREFIXES, "turtle")))


@query("thes_group_rows")
def thes_group_rows(s: SparkSession, d: str) -> DataFrame:
    from strataframe.operators.csvload import read_thesaurus_records

    rows = read_thesaurus_records(table(s, d, "thesaurus_csv")).where("reason is null").select("file_no", "line_no", "thesaurus_id", "id", "value", "target_id")
    return thesaurus.group_rows(rows).select("file_no", "first", "thesaurus_id", "target_id", F.to_json("entries").alias("entries"))


# functions in Arrow batches

query("json_to_xml")(lambda s, d: _parts(s, d).select(F.col("_id"), _arrow().json_to_xml_filter(_arrow().XmlOptions(numbered=True, skip=frozenset({"null", "false"})))(F.col("content")).alias("xml")))
query("json_paths", """with p as (select * from (select *, row_number() over (partition by _id order by "timeModified" desc nulls last, "arrivedAt" desc nulls last, content desc nulls last, "itemId" desc nulls last, "roleId" desc nulls last) as r from parts where _id is not null) where r = 1)
select _id, coalesce(json_extract_string(content, '$.citation'), 'null') as x from p""")(lambda s, d: _parts(s, d).select("_id", _arrow().json_path_filter("citation", strip=True)(F.col("content")).alias("x")))
# all titles; what Markdown would read as marks is escaped, and several kinds of blocks and spans stand around it
_MD_SQL = "replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
query("markdown_regions", f"""select distinct _id, '<p><strong>b</strong> and <em>i</em> ' || {_MD_SQL} || '</p>' || chr(10) || ' end ' || coalesce(title, '') as x from items""")(
    lambda s, d: table(s, d, "items").select("_id", F.coalesce("title", F.lit("")).alias("t")).select("_id", _arrow().markdown_filter("<_md>", "</_md>")(F.concat(F.lit("<_md>**b** and *i* "), F.regexp_replace("t", r"([\\`*_{}\[\]()#+.!|-])", r"\\$1"), F.lit("</_md> end "), F.col("t"))).alias("x")).distinct()
)
# each finder, by its own term and by several
for _name, _terms, _where in (
    ("literal", {"lit": "true"}, "o_lit = 'true'"),
    ("tag", {"tag": "imp", "p": "lv:isA"}, "tag = 'imp' and p = 'lv:isA'"),
    ("all", {"p": "http://lv.example.org/vocabulary#isA", "o": "lv:stele", "tag": "imp"}, "p = 'lv:isA' and o = 'lv:stele' and tag = 'imp'"),
):
    query(f"graph_find_{_name}", f"{_DECODED} select id, s, p, o, o_lit from d where {_where}")(lambda s, d, terms=_terms: graph.find(_decoded(s, d), PREFIXES, **terms).select("id", "s", "p", "o", "o_lit"))
query("graph_find_subject", f"{_DECODED} select id, s, p, o, o_lit from d where s = (select max(s) from d)")(lambda s, d: (lambda x: graph.find(x, PREFIXES, s=x.agg(F.max("s")).first()[0]).select("id", "s", "p", "o", "o_lit"))(_decoded(s, d)))
query("graph_contains", f"{_DECODED} select distinct s, p, o, exists (select 1 from d e where e.s = d.s and e.p = d.p and e.o = d.o and e.o_lit is null) as here from d where s is not null and p is not null and o is not null and p = 'lv:isA' and o = 'lv:stele'")(
    lambda s, d: (lambda x: x.where("p = 'lv:isA' and o = 'lv:stele' and s is not null").groupBy("s", "p", "o").agg(F.bool_or(F.col("o_lit").isNull()).alias("here")))(_decoded(s, d))
)
query("text_extract_tokens", f"with {_CURRENT} select item_id, 'see ' || string_split(lines[1], ' ')[1] || '!' as text from b where len(lines) > 0")(
    lambda s, d: (lambda b: texts.extract_tokens(b.where("size(lines) > 0").select("item_id", F.lit("see @{1.1}!").alias("text")), b))(texts.base_texts(_parts(s, d)))
)
query("dump_envelopes")(lambda s, d: _sinks().json_envelopes(framing.frame(*_both(s, d), FrameFilter()), 100, {}, ""))
query("dump_markdown", f"""with i as (select "referenceId" as _id, * exclude (_id, "referenceId") from {_LATEST.format(t='history_items', w='true')} where r = 1), n as (select *, row_number() over (order by "sortKey", _id) as nr from i)
select printf('d%05d.md', (nr - 1) // 100 + 1) as file, '#### ' || coalesce(title, _id) || chr(10) || chr(10) || """ + " || ".join(f"""coalesce('- {a}: `' || {b} || '`' || chr(10), '')""" for a, b in (("ID", "_id"), ("description", "description"), ("facet ID", '"facetId"'), ("group ID", '"groupId"'), ("sort key", '"sortKey"'), ("created", """rtrim(rtrim(strftime("timeCreated", '%Y-%m-%d %H:%M:%S.%g'), '0'), '.')"""), ("creator", '"creatorId"'), ("modified", """rtrim(rtrim(strftime("timeModified", '%Y-%m-%d %H:%M:%S.%g'), '0'), '.')"""), ("user", '"userId"'))) + " || case when coalesce(flags, 0) <> 0 then '- flags: `' || printf('%04X', flags) || '`' || chr(10) else '' end as text from n")(lambda s, d: _sinks().markdown_items(framing.snapshot(table(s, d, "history_items"), FrameFilter())).select("file", "text"))


def _arrow():
    from strataframe.functions import arrow

    return arrow


def _sinks():
    from strataframe.sources import sinks

    return sinks


# composition

query("compose_metadata", f"""select cast(row_number() over (partition by coalesce(nullif("groupId", ''), 'default') order by "sortKey", "referenceId") as int) as item_nr, "referenceId" as _id, title, "facetId", flags, "groupId",
  row_number() over (partition by coalesce(nullif("groupId", ''), 'default') order by "sortKey", "referenceId") = 1 as new_group from {_LATEST.format(t='history_items', w='true')} where r = 1 and status is distinct from 2""")(
    lambda s, d: render.metadata(framing.snapshot(table(s, d, "history_items"), FrameFilter(), False))
)
query("compose_dispatch", f"""with {_CURRENT} select _id, case when "typeId" = 'lapida.note' and "roleId" = 'internal' then 'internal' when "typeId" = 'lapida.note' then json_extract_string(content, '$.text') else json_extract_string(content, '$.citation') end as text from p
where "typeId" = 'lapida.note' and ("roleId" = 'internal' or json_extract_string(content, '$.text') is not null) or "typeId" = 'lapida.token-text' and json_extract_string(content, '$.citation') is not null""")(
    lambda s, d: render.dispatch(_parts(s, d), {"lapida.note:internal": lambda c: F.lit("internal"), "lapida.note": lambda c: F.get_json_object(c, "$.text"), "lapida.token-text": lambda c: F.get_json_object(c, "$.citation")})
)
query("compose_standoff_flows")(lambda s, d: (lambda g, a: render.standoff_flows(_pieces(g), a))(*_apps(s, d, located=True)))
query("json_fragment_at", f"""with {_CURRENT} select _id, json_extract_string(content, '$.fragments[1].location') as location from p where json_extract(content, '$.fragments[1]') is not null and json_type(content, '$.fragments[1]') = 'OBJECT'""")(
    lambda s, d: _parts(s, d).select("_id", scalars.fragment_at(F.col("content"), 1).alias("f")).where("f like '{%'").select("_id", F.get_json_object("f", "$.location").alias("location"))
)
query("text_composite", f"""{_TEXT}, q as (select item_id, n % 2 as sub_id, n, text from t), c as (select *, case when lag(n) over w is null or coalesce(ends_with(lag(text) over w, chr(10)), false) then 1 else 0 end as cut from q window w as (partition by item_id, sub_id order by n)),
i as (select *, sum(cut) over (partition by item_id, sub_id order by n) as island from c)
select item_id, sub_id, min(n) as n, string_agg(text, '' order by n) as text from i group by item_id, sub_id, island""")(
    lambda s, d: texts.merge_linear(_layers(s, d)[2].withColumn("sub_id", F.col("n") % 2).withColumn("features", F.array().cast(scalars.FEATURES)), keys=("item_id", "sub_id")).select("item_id", "sub_id", "n", "text")
)

_GROUPED = f"""{problems._P3}, ld as (select distinct file_no, line_no, t as thesaurus_id, i as id, va as value, g as target_id from o where reason is null),
cu as (select *, case when lag(thesaurus_id) over w is distinct from thesaurus_id then 1 else 0 end as cut from ld window w as (partition by file_no order by line_no)),
gr as (select *, sum(cut) over (partition by file_no order by line_no) as grp from cu)
select file_no, min(line_no) as first, thesaurus_id, max(target_id) as target_id, coalesce('[' || string_agg('{{"id":' || to_json(id) || case when value is not null then ',"value":' || to_json(value) else '' end || '}}', ',' order by line_no) filter (id is not null) || ']', '[]') as entries
from gr group by file_no, grp, thesaurus_id having max(target_id) is not null or count(id) > 0"""
ORACLES["thes_group_rows"] = _GROUPED


_SHEET = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="root"><p><xsl:for-each select="lines/line"><xsl:if test="position() &gt; 1"><br/></xsl:if><xsl:value-of select="text"/></xsl:for-each></p></xsl:template></xsl:stylesheet>"""
query("json_xslt", f"""with {_CURRENT} select part_id, case when len(lines) = 0 then '<p />' else '<p>' || array_to_string(list_transform(lines, lambda x: {_XT.format(c='x')}), '<br />') || '</p>' end as html from b""")(
    lambda s, d: (lambda p: p.join(texts.base_texts(p).select("part_id"), F.col("_id") == F.col("part_id")).select("part_id", _arrow().xslt_filter(_SHEET)(F.col("content")).alias("html")))(_parts(s, d))
)
