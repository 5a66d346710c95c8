"""The pN_ queries of the general problems over a folder of tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.times import micros
from strataframe.operators import cdc, csvload, eav, history, intake, nested, orphans
from strataframe.storage import table, workspace

#: how dumps of framed items and thesauri are read
ITEMS = nested.Options(
    root="item",
    envelope="items",
    elements={("item", "_parts"): "part", ("part", "fragments"): "fragment", ("part.content", "fragments"): "fragment", ("fragment", "entries"): "reading", ("reading", "witnesses"): "witness"},
    declared=frozenset({"part", "fragment", "reading", "witness"}),
    keys={"item": "_id", "part": "_id", "fragment": "location", "reading": "value", "witness": "value"},
    paths=frozenset({"fragment", "reading", "witness"}),
    inline=frozenset({"part.content"}),
    embedded=frozenset({"content"}),
    first_of={("part", "fragment"): ("fragments", "content.fragments")},
)
THESAURI = nested.Options(root="thesaurus", elements={("thesaurus", "entries"): "entry"}, declared=frozenset({"entry"}), keys={"thesaurus": "id", "entry": "id"})


def item_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, nested.Graph]:
    found = nested.nodes(table(spark, d, "item_dump"), "doc", ITEMS)
    return found, nested.schema_graph(found, ITEMS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, graph = item_nodes(spark, d)
    thesauri = nested.nodes(table(spark, d, "thesauri").select(F.to_json(F.struct("id", "entries")).alias("doc")), "doc", THESAURI)
    rows = nested.links(items, graph.tables()).unionByName(nested.links(thesauri, nested.schema_graph(thesauri, THESAURI).tables()))
    kids = rows.where(F.col("tab").isin("part", "fragment", "reading", "witness", "entry"))
    return kids.select(F.col("tab").alias("child"), "parent_key", "ord", F.col("row_key").alias("child_key")).distinct()


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of the dump: (tab, parent_tab, row_key, parent_key, ord, cols) with cols as JSON, without repeats."""
    items, graph = item_nodes(spark, d)
    entry = F.array_sort(F.map_entries("cols"))
    return nested.shred(items, graph.tables()).select("tab", "parent_tab", "row_key", "parent_key", "ord", F.to_json(F.map_from_entries(entry)).alias("cols")).distinct()


def p1_table(spark: SparkSession, d: str, element: str) -> DataFrame:
    """The flat table of one element, with a column per inlined path."""
    items, graph = item_nodes(spark, d)
    return nested.table_of(nested.shred(items, graph.tables()), graph, nested.columns_of(items), element).distinct()


def p1_item_table(spark: SparkSession, d: str) -> DataFrame:
    return p1_table(spark, d, "item")


def p1_part_table(spark: SparkSession, d: str) -> DataFrame:
    return p1_table(spark, d, "part")


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Why documents of the dump have no rows, and how many they are."""
    return nested.rejected(item_nodes(spark, d)[0])


_SLICES = 3


def p2_tracker(spark: SparkSession, d: str) -> orphans.OrphanTracker:
    """The references and parents of a folder, played in slices of their time of arrival."""
    ref = lambda df, field, key, row, period=F.lit(""), at=F.lit(None).cast("long"): df.select(F.lit(field).alias("field"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"), F.col(row).cast("string").alias("row_key"), period.alias("period"), at.alias("at"))
    parent = lambda df, field, key, op, at=F.lit(None).cast("long"): df.select(F.lit(field).alias("field"), F.col(key).cast("string").alias("key"), op.alias("op"), at.alias("at"))
    parts, items, log = table(spark, d, "parts"), table(spark, d, "items"), table(spark, d, "history_items")
    triple, node, thesauri = table(spark, d, "triple"), table(spark, d, "node"), table(spark, d, "thesauri")
    lo, hi = parts.select(F.min(micros(parts, "arrivedAt")), F.max(micros(parts, "arrivedAt"))).first()
    lo, hi = (0, 1) if lo is None else (lo, max(hi, lo + 1))
    slice_of = lambda df: F.coalesce(F.greatest(F.lit(0), F.least(F.lit(_SLICES - 1), F.floor((micros(df, "arrivedAt") - lo) * _SLICES / F.lit(hi - lo)))), F.lit(0))
    target = F.when(F.col("targetId") == "", F.lit(None)).when(F.col("targetId").contains("@"), F.col("targetId")).otherwise(F.concat("targetId", F.lit("@en")))
    tracker = orphans.OrphanTracker(spark, workspace(spark, "orphans"))
    for i in range(_SLICES):
        refs = ref(parts.where(slice_of(parts) == i), "parts.itemId", "itemId", "_id", F.coalesce(F.date_format(F.to_date("timeModified"), "yyyy-MM"), F.lit("")), micros(parts, "arrivedAt"))
        up = parent(items.where(slice_of(items) == i), "parts.itemId", "_id", F.lit("present")).unionByName(
            parent(log.where(slice_of(log) == i), "parts.itemId", "referenceId", F.when(F.col("status") == 2, F.lit("tombstone")).otherwise(F.lit("seen")), micros(log, "arrivedAt"))
        )
        if i == 0:  # tables without a time of arrival
            refs = refs.unionByName(ref(triple, "triple.s_id", "s_id", "id")).unionByName(ref(triple, "triple.o_id", "o_id", "id")).unionByName(ref(thesauri, "thesauri.targetId", target, "id"))
            up = up.unionByName(parent(node, "triple.s_id", "id", F.lit("present"))).unionByName(parent(node, "triple.o_id", "id", F.lit("present"))).unionByName(parent(thesauri, "thesauri.targetId", "id", F.lit("present")))
        tracker.apply(refs, up)
    return tracker


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = p2_tracker(spark, d).report()
    at = F.split("field", "\\.")
    return found.select(at[0].alias("tab"), at[1].alias("field"), "row_key", "period", "reason").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return csvload.read_thesaurus_records(table(spark, d, "thesaurus_csv")).where("reason is not null").select("file_no", "line_no", "reason").distinct()


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return csvload.read_thesaurus_records(table(spark, d, "thesaurus_csv")).where("reason is null").select("file_no", "line_no", "thesaurus_id", "id", "value", "target_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.widen(table(spark, d, "triple"), table(spark, d, "property")).cells()


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.widen(table(spark, d, "triple"), table(spark, d, "property")).rows()


def p4_wide_text(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with every value as text."""
    wide = p4_wide(spark, d)
    return wide.select("s_id", *[F.col(c).cast("string").alias(c) for c in wide.columns if c != "s_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans = history.validity(table(spark, d, "history_items"))
    millis = lambda c: F.expr(f"{c} div 1000")
    return spans.select(F.col("referenceId").alias("reference_id"), millis("valid_from").alias("valid_from"), F.coalesce(millis("valid_to"), F.lit(-1)).alias("valid_to"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """The periods with the attributes that held in them; valid_to is -1 where they still do."""
    return history.validity(table(spark, d, "history_items")).withColumn("valid_to", F.coalesce("valid_to", F.lit(-1)))


def p6_table(spark: SparkSession, d: str, coll: str) -> DataFrame:
    """The rows of one collection after all its changes."""
    return cdc.replay(spark, table(spark, d, coll), workspace(spark, coll)).current()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = [p6_table(spark, d, c).select(F.lit(c).alias("coll"), F.col("referenceId").alias("reference_id"), F.col("_id").alias("rec_id")) for c in ("history_items", "history_parts")]
    return out[0].unionByName(out[1])


def p6_routed(spark: SparkSession, d: str) -> DataFrame:
    """The items after the changes of all months but the last, and then of that one, which meets only some of 256 buckets."""
    log = table(spark, d, "history_items")
    last = F.date_format(F.col("arrivedAt").cast("date"), "yyyy-MM") == log.select(F.date_format(F.max("arrivedAt").cast("date"), "yyyy-MM")).first()[0]
    out = cdc.BucketedTable(spark, workspace(spark, "routed"), buckets=256)
    out.apply(log.where(~F.coalesce(last, F.lit(False))), "before")
    out.apply(log.where(last), "last month")
    return out.current().select(F.col("referenceId").alias("reference_id"), F.col("_id").alias("rec_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    records = None
    for coll in ("items", "parts", "history_parts"):
        rows = intake.arrivals(table(spark, d, coll), coll)
        records = rows if records is None else records.unionByName(rows)
    taken = intake.assign_intervals(table(spark, d, "load_runs"))
    return intake.locate(spark, records, "arrivedAt", taken).select("coll", "rec_id", "run_id").distinct()


def p7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The rows of items, taken by three runs over a ledger; some rows show up only a run after they arrived."""
    rows = table(spark, d, "items").select(F.col("_id").alias("rec_id"), "arrivedAt").where("arrivedAt is not null").distinct()
    at = micros(rows, "arrivedAt")
    visible = (1 + F.when(F.expr("cast(arrivedAt as date)") >= F.lit(_RUNS[1]).cast("date"), 1).otherwise(0) + F.when(F.expr("cast(arrivedAt as date)") >= F.lit(_RUNS[2]).cast("date"), 1).otherwise(0) + (F.pmod(F.expr("x div 1000"), F.lit(7)) == 0).cast("int")).cast("int")
    rows = rows.withColumn("x", at).withColumn("run", visible)
    ledger, out = intake.Ledger(spark, workspace(spark, "ledger")), workspace(spark, "taken")
    parts = [intake.take(spark, ledger, rows.where(F.col("run") <= n), "arrivedAt", 2**62, f"{out}/{n}").select("rec_id", F.lit(n).alias("run_id")) for n in (1, 2, 3, 4)]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("rec_id", "run_id").agg(F.count("*").alias("n"))


#: the days from which on rows of p7_ledger arrive in its first, second and third run
_RUNS = ("1970-01-01", "2024-03-01", "2024-06-01")


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_item_table, p1_part_table, p1_rejected, p2_found, p3_found, p3_loaded, p4_found, p4_wide, p4_wide_text, p5_found, p5_history, p6_found, p6_routed, p7_found, p7_ledger)}

#: fixed values: the same questions in DuckDB's SQL
_P6 = """select '{0}' as coll, "referenceId" as reference_id, _id as rec_id from (
  select *, row_number() over (partition by "referenceId" order by "timeModified" desc nulls last, _id desc nulls last) as r
  from {0} where "referenceId" is not null) where r = 1 and status is distinct from 2"""
_P7 = """select distinct '{0}' as coll, rec_id, (select min(run_id) from load_runs l where l.coll = '{0}' and l.outcome = 'ok' and l."readUpTo" >= a) as run_id
  from (select _id as rec_id, "timeModified", min("arrivedAt") as a from {0} group by all)
  where exists (select 1 from load_runs l where l.coll = '{0}' and l.outcome = 'ok' and l."readUpTo" >= a)"""
_DAYS = r"((0[13578]|1[02])-(0[1-9]|[12]\d|3[01])|(0[469]|11)-(0[1-9]|[12]\d|30)|02-(0[1-9]|1\d|2[0-8]))"
_ZONE = r"(Z|[+-]((0\d|1[0-3]):[0-5]\d|14:00))?"

ORACLES = {
    "p2_found": """
with i as (select distinct _id from items where _id is not null),
h as (select "referenceId" as k, min("arrivedAt") as first_at, bool_or(status = 2) as dead from history_items group by 1),
p as (select 'parts' as tab, 'itemId' as field, parts._id as row_key, coalesce(strftime("timeModified", '%Y-%m'), '') as period,
  case when i._id is null and coalesce(h.dead, false) then 'deleted' when i._id is null then 'missing'
       when h.first_at > parts."arrivedAt" then 'late' end as reason
  from parts left join i on i._id = parts."itemId" left join h on h.k = parts."itemId" where parts."itemId" <> '')
select distinct * from p where reason is not null
union select distinct 'triple', 's_id', cast(id as varchar), '', 'missing' from triple where s_id is not null and s_id not in (select id from node where id is not null)
union select distinct 'triple', 'o_id', cast(id as varchar), '', 'missing' from triple where o_id is not null and o_id not in (select id from node where id is not null)
union select distinct 'thesauri', 'targetId', id, '', 'missing' from thesauri where "targetId" <> ''
  and case when contains("targetId", '@') then "targetId" else "targetId" || '@en' end not in (select id from thesauri where id is not null)""",
    "p4_found": rf"""
with k as (select p_id, coalesce(own, lit, 'string') as typ from (
  select p_id, mode(case lower(split_part(o_lit_type, ':', 2)) when 'int' then 'integer' when 'long' then 'integer' else lower(split_part(o_lit_type, ':', 2)) end) as lit from triple where o_lit is not null group by 1)
  left join (select id, case lower(split_part(data_type, ':', 2)) when 'int' then 'integer' when 'long' then 'integer' else lower(split_part(data_type, ':', 2)) end as own from property) on id = p_id),
c as (select s_id, p_id, typ, id, case when typ = 'string' then o_lit else trim(o_lit, E' \t\r\n') end as v from triple join k using (p_id) where o_lit is not null and s_id is not null),
g as (select *, row_number() over (partition by s_id, p_id order by id, v) as r from c where case typ
  when 'string' then true when 'integer' then regexp_full_match(v, '[+-]?\d+') when 'decimal' then regexp_full_match(v, '[+-]?(\d+(\.\d*)?|\.\d+)')
  when 'boolean' then v in ('true', 'false', '1', '0')
  else regexp_full_match(v, '\d{{4}}-{_DAYS}{_ZONE}') or regexp_full_match(v, '\d\d(0[48]|[2468][048]|[13579][26])-02-29{_ZONE}') or regexp_full_match(v, '([02468][048]|[13579][26])00-02-29{_ZONE}') end)
select s_id, p_id, typ, case typ when 'string' then v when 'integer' then cast(cast(v as hugeint) as varchar) when 'decimal' then cast(cast(v as decimal(30, 4)) as varchar)
  when 'boolean' then case when v in ('true', '1') then 'true' else 'false' end else left(v, 10) end as val from g where r = 1""",
    "p5_found": """
with v as (select * from (select *, row_number() over (partition by "referenceId", "timeModified" order by _id desc) as r from history_items where "referenceId" is not null and "timeModified" is not null) where r = 1),
s as (select "referenceId" as k, "timeModified" as t, coalesce(status = 2, false) as gone, row(title, description, "facetId", "groupId", "sortKey", flags) as a,
  lag(coalesce(status = 2, false)) over w as g0, lag(row(title, description, "facetId", "groupId", "sortKey", flags)) over w as a0
  from v window w as (partition by "referenceId" order by "timeModified")),
e as (select *, lead(t) over (partition by k order by t) as t1 from s where g0 is null and not gone or g0 is not null and (gone <> g0 or not gone and a is distinct from a0))
select k as reference_id, epoch_ms(t) as valid_from, coalesce(epoch_ms(t1), -1) as valid_to from e where not gone""",
    "p5_history": """
with v as (select * from (select *, row_number() over (partition by "referenceId", "timeModified" order by _id desc) as r from history_items where "referenceId" is not null and "timeModified" is not null) where r = 1),
s as (select *, coalesce(status = 2, false) as gone, row(title, description, "facetId", "groupId", "sortKey", flags) as a,
  lag(coalesce(status = 2, false)) over w as g0, lag(row(title, description, "facetId", "groupId", "sortKey", flags)) over w as a0 from v window w as (partition by "referenceId" order by "timeModified")),
e as (select *, lead("timeModified") over (partition by "referenceId" order by "timeModified") as t1 from s where g0 is null and not gone or g0 is not null and (gone <> g0 or not gone and a is distinct from a0))
select "referenceId", epoch_us("timeModified") as valid_from, coalesce(epoch_us(t1), -1) as valid_to, case when coalesce(g0, true) then 'inserted' else 'changed' end as change, title, description, "facetId", "groupId", "sortKey", flags from e where not gone""",
    "p6_found": f"{_P6.format('history_items')} union all {_P6.format('history_parts')}",
    "p6_routed": f"select reference_id, rec_id from ({_P6.format('history_items')})",
    "p7_ledger": """select rec_id, run_id, count(*) as n from (select distinct _id as rec_id, "arrivedAt", cast(1 + cast("arrivedAt" >= timestamp '2024-03-01' as int) + cast("arrivedAt" >= timestamp '2024-06-01' as int)
  + cast((epoch_us("arrivedAt") // 1000) % 7 = 0 as int) as int) as run_id from items where "arrivedAt" is not null) group by all""",
    "p7_found": " union all ".join(_P7.format(c) for c in ("items", "parts", "history_parts")),
}

_ARRAY = "case json_type({0}) when 'ARRAY' then from_json({0}, '[\"JSON\"]') when 'OBJECT' then [{0}] else cast([] as json[]) end"


def _children(source: str, list_sql: str, keep: str) -> str:
    """SQL of (keep, ord, x): the objects of an array of source, with their places."""
    return f"select {keep}, ord - 1 as ord, x from (select {keep}, unnest(range(1, len(l) + 1)) as ord, unnest(l) as x from (select *, {_ARRAY.format(list_sql)} as l from {source})) where json_type(x) = 'OBJECT'"


ORACLES["p1_found"] = f"""
with d as (select cast(doc as json) as j from item_dump), i as (select unnest(case when json_exists(j, '$.items') then {_ARRAY.format("json_extract(j, '$.items')")} else [j] end) as it from d),
p as ({_children("i", "json_extract(it, '$._parts')", "it ->> '$._id' as pk")}),
pc as (select pk, ord, x, x ->> '$._id' as id, case json_type(x, '$.content') when 'VARCHAR' then cast(x ->> '$.content' as json) else json_extract(x, '$.content') end as content from p),
f as ({_children("(select *, case when json_exists(x, '$.fragments') then json_extract(x, '$.fragments') else json_extract(content, '$.fragments') end as fs from pc)", "fs", "id")}),
r as ({_children("(select id || '/' || ord as pk, x as y from f)", "json_extract(y, '$.entries')", "pk")}),
w as ({_children("(select pk || '/' || ord as pk, x as y from r)", "json_extract(y, '$.witnesses')", "pk")}),
e as (select id, ord - 1 as ord, en.id as k from (select id, unnest(range(1, len(entries) + 1)) as ord, unnest(entries) as en from thesauri) where en is not null)
select distinct 'part' as child, pk as parent_key, cast(ord as int) as ord, id as child_key from pc union select 'fragment', id, ord, x ->> '$.location' from f
union select 'reading', pk, ord, x ->> '$.value' from r union select 'witness', pk, ord, x ->> '$.value' from w union select 'entry', id, ord, k from e""".replace("select it ->> '$._id' as pk, ord - 1 as ord, x from (select it ->> '$._id' as pk", "select pk, ord - 1 as ord, x from (select it ->> '$._id' as pk")



def _text_sql(j: str, member: str) -> str:
    """SQL of a member as text: wrapped numbers and dates as plain ones, arrays with a space after each comma."""
    at = f"json_extract({j}, '$.{member}')"
    inner = lambda w: f"json_extract({at}, '$.\"{w}\"')"
    millis = f"try_cast(coalesce(json_extract_string({inner('$date')}, '$.\"$numberLong\"'), json_extract_string({inner('$date')}, '$')) as bigint)"
    date = f"coalesce(strftime(make_timestamp_ms({millis}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', json_extract_string({inner('$date')}, '$'))"
    wrapped = ", ".join(f"json_extract_string({inner(w)}, '$')" for w in ("$numberInt", "$numberLong", "$numberDouble", "$numberDecimal", "$oid"))
    array = f"'[' || array_to_string(list_transform(from_json({at}, '[\"JSON\"]'), lambda e: cast(e as varchar)), ', ') || ']'"
    return f"case json_type({at}) when 'OBJECT' then coalesce({wrapped}, {date}) when 'ARRAY' then {array} else json_extract_string({at}, '$') end"


def _flat_sql(j: str, columns: dict[str, tuple[str, str]]) -> str:
    return ", ".join(f'{_text_sql(source, member)} as "{name}"' for name, (source, member) in columns.items())


_OWN = lambda *names: {n: ("x", n) for n in names}
_P1_ITEMS = ORACLES["p1_found"].partition("\np as (")[0].rstrip(",").replace("with d as", "with d as", 1)
_P1_PARTS = ORACLES["p1_found"].partition("\nf as (")[0].rstrip(",")
ORACLES["p1_item_table"] = f"""{_P1_ITEMS} select distinct cast(null as varchar) as parent_key, 0 as ord, x ->> '$._id' as row_key, {_flat_sql("x", _OWN("_id", "_status", "creatorId", "description", "facetId", "flags", "groupId", "sortKey", "timeCreated", "timeModified", "title", "userId"))}
from (select it as x from i where json_type(it) = 'OBJECT')"""
ORACLES["p1_part_table"] = f"""{_P1_PARTS} select distinct pk as parent_key, cast(ord as int) as ord, id as row_key, {_flat_sql("x", _OWN("_id", "_status") | {f"content_{n}": ("content", n) for n in ("categories", "citation", "tag", "text")} | _OWN("creatorId", "itemId", "roleId", "timeCreated", "timeModified", "typeId", "userId"))} from pc"""

_FIELD = ' *"(?:[^"]|"")*" *|[^",]*'
_P3 = rf"""
with r as (select distinct file_no, line_no, raw, regexp_replace(raw, '\r$', '') as t from thesaurus_csv),
h as (select file_no as hf, list_transform(string_split(replace(regexp_replace(regexp_replace(raw, '\r$', ''), '^\x{{FEFF}}', ''), '"', ''), ','), lambda x: lower(trim(x))) as names from (select distinct file_no, raw from thesaurus_csv where line_no = 1)),
b as (select *, regexp_full_match(t, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') as framed from r left join h on hf = file_no where line_no <> 1 and not regexp_full_match(t, '[ \r\n\t]*')),
s as (select *, case when framed then list_transform(regexp_extract_all(',' || t, '(?s),({_FIELD})', 1), lambda x: case when starts_with(trim(x, ' '), '"') then replace(trim(x, ' ')[2:-2], '""', '"') else trim(x, ' ') end) end as fs from b),
c as (select *, framed and len(fs) = len(names) as ok from s),
v as (select file_no, line_no, framed, ok, case when ok then nullif(fs[list_position(names, 'thesaurusid')], '') end as ti, case when ok then nullif(fs[list_position(names, 'id')], '') end as i,
  case when ok then nullif(fs[list_position(names, 'value')], '') end as va, case when ok then nullif(fs[list_position(names, 'targetid')], '') end as g from c),
n as (select *, last_value(ti ignore nulls) over (partition by file_no order by line_no rows between unbounded preceding and current row) as t from v),
o as (select *, case when not framed then 'quoting' when not coalesce(ok, false) then 'columns' when t is null or ti is not null and not regexp_full_match(ti, '[A-Za-z0-9._-]+@[a-z]{{2,3}}') or i is null and g is null or g is not null and (i is not null or va is not null)
  or i is not null and not regexp_full_match(i, '[A-Za-z0-9._-]+') or g is not null and not regexp_full_match(g, '[A-Za-z0-9._-]+(@[a-z]{{2,3}})?') or va is not null and regexp_matches(va, '[\x{{FFFD}}\x{{7F}}\x00-\x08\x0B\x0C\x0E-\x1F]') then 'value' end as reason from n)"""
ORACLES["p3_found"] = f"{_P3} select distinct file_no, line_no, reason from o where reason is not null"
ORACLES["p3_loaded"] = f"{_P3} select distinct file_no, line_no, t as thesaurus_id, i as id, va as value, g as target_id from o where reason is null"
_WIDE = {101: "varchar", 102: "varchar", 103: "bigint", 104: "decimal(38, 4)", 105: "decimal(38, 4)", 106: "boolean", 107: "date", 108: "bigint", 109: "varchar", 110: "boolean", 111: "date", 112: "decimal(38, 4)", 113: "bigint", 114: "bigint", 115: "date", 116: "varchar"}
#: typed columns, which engines hand over in different ways; the tests compare them
WIDE_SQL = f"select s_id, {', '.join(f'max(try_cast(val as {k})) filter (p_id = {p}) as p{p}' for p, k in _WIDE.items())} from ({ORACLES['p4_found']}) group by 1"
ORACLES["p4_wide_text"] = f"select s_id, {', '.join(f'cast(p{p} as varchar) as p{p}' for p in _WIDE)} from ({WIDE_SQL})"
ORACLES["p1_rejected"] = "select 'no JSON' as problem, count(*) as n from item_dump where trim(doc) <> '' and not json_valid(doc) having count(*) > 0"
