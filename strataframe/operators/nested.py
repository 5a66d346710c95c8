"""Deeply nested records into related flat tables by shared inlining.

Every object of a record becomes a node, with its element, its place below its parent and its scalar members. An element
is a member below its parent's element, so members of one name at different places are different elements, unless options
give them one name (shared) or an element occurs again within itself (recursive). The nodes are parsed out of the records
once and written; all that follows works on them without parsing again.

The schema graph has an edge per pair of parent and child element, marked with whether the child repeats. An element gets
a table of its own if it is a root, repeats, has several parents or contains itself; every other one is inlined into the
table above it, its members becoming columns named by path. Child rows hold the key of their parent row and their position.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe import storage

#: owner_...: the nearest object above that has a table for certain; up: the objects between it and the node, if there are
#: any; member: what holds the node there; many: it stands in an array; link: the name by which children point to it; cols:
#: its scalar members as a JSON object
_UP = "array<struct<node:long,element:string,member:string,link:string>>"
NODES = f"node long, owner_node long, owner_element string, owner_link string, up {_UP}, element string, member string, many boolean, ord int, row_key string, row_path string, link string, cols string, problem string"


_EPOCH = datetime.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Options:
    """How records are read.

    root: element name of the record itself. envelope: a root object with this member is only a wrapper of roots.
    elements: names of elements by (parent element, member), where one element occurs at several places or a short name is
    wanted; others are named `parent.member`. declared: elements that the schema says repeat, whatever the data at hand.
    keys: members that name a row; a row without one is named by its path. paths: elements whose children point to them by
    path, not by key. inline: elements that never have a table: their objects are inlined whatever other records hold
    there, and their arrays stay with the row, as JSON text. embedded: members whose text holds JSON. first_of: for
    (element, child element), paths within the row, `a.b`, of which only the first that is present counts, even if it is
    null or empty. wrappers: objects with one such member stand for its value.
    """

    root: str
    envelope: str | None = None
    elements: dict[tuple[str, str], str] = field(default_factory=dict)
    declared: frozenset[str] = frozenset()
    keys: dict[str, str] = field(default_factory=dict)
    paths: frozenset[str] = frozenset()
    inline: frozenset[str] = frozenset()
    embedded: frozenset[str] = frozenset()
    first_of: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)
    wrappers: frozenset[str] = frozenset({"$numberInt", "$numberLong", "$numberDouble", "$numberDecimal", "$date", "$oid"})

    def child(self, element: str, member: str, within: tuple[str, ...]) -> str:
        """The element of a member of element; one of the elements around it that ends in the same member is meant again."""
        named = self.elements.get((element, member))
        if named is not None:
            return named
        return next((e for e in (element, *within) if e.rpartition(".")[2] == member and "." in e and e not in self.inline), f"{element}.{member}")


def _plain(v, o: Options):
    """v without wrappers; a `$date` in milliseconds since 1970 comes out as the ISO 8601 text that others have."""
    date = False
    while isinstance(v, dict) and len(v) == 1 and next(iter(v)) in o.wrappers:
        date |= "$date" in v
        v = next(iter(v.values()))
    if date and not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, str) and re.fullmatch(r"-?\d{1,15}", v)):
        try:
            return (_EPOCH + datetime.timedelta(milliseconds=int(v))).isoformat(timespec="milliseconds") + "Z"
        except OverflowError:
            return v
    return v


def _loads(text: str):
    """The value of JSON text, or (None, reason)."""
    try:
        return json.loads(text), None
    except RecursionError:
        return None, "nested too deeply"
    except ValueError as e:
        return None, f"no JSON: {e}"[:200]


def _roots(doc: str | None, o: Options) -> tuple[list[dict], str | None]:
    """The root objects of a document, and why it has none or lacks some."""
    if doc is None or not doc.strip():
        return [], None
    v, problem = _loads(doc)
    if problem:
        return [], problem
    if isinstance(v, dict) and o.envelope is not None and o.envelope in v:
        v = v[o.envelope]
    found = v if isinstance(v, list) else [v]
    roots = [x for x in found if isinstance(x, dict)]
    return roots, None if all(x is None or isinstance(x, dict) for x in found) else "a record that is no object"


def _text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


_UP_NAMES = ("node", "element", "member", "link")


def nodes_of(root: dict, o: Options, number: int) -> list[tuple]:
    """The nodes of one record, as NODES without problem, parents before children; ids count from number."""
    out: list[tuple] = []
    # object, element, elements around it, objects above, member, in an array?, position, path
    stack: list[tuple] = [(root, o.root, (), (), None, False, 0, "")]
    while stack:
        obj, element, within, up, member, many, order, path = stack.pop()
        items: dict[str, tuple] = {}  # by path: value, element, elements around it
        inner = [(obj, element, within, "")]
        while inner:
            at, e, around, prefix = inner.pop()
            for name, v in at.items():
                if name in o.embedded and isinstance(v, str):
                    read, problem = _loads(v)
                    v = read if problem is None and isinstance(read, (dict, list)) else v
                v, child = _plain(v, o), o.child(e, name, around)
                if child in o.inline and isinstance(v, dict):
                    inner.append((v, child, (e, *around), f"{prefix}{name}."))
                items[f"{prefix}{name}"] = (v, child, (e, *around))
        named = o.keys.get(element)
        key = _text(items[named][0]) if named in items else None
        here = path or (key if key is not None else "")
        link = key if named and element not in o.paths else here
        below = here if element in o.paths or key is None else key
        passed: set[str] = set()
        for (e, _), choices in o.first_of.items():
            if e == element:
                chosen = next((c for c in choices if c in items), None)
                passed.update(c for c in choices if c != chosen)
        me = (number + len(out), element, member, link)
        # an element that repeats here, or is declared to, has a table whatever comes: no child looks further up
        above = (me,) if many or element == o.root or element in o.declared else (*up, me)
        cols: dict[str, str | None] = {}
        kids: list[tuple] = []
        for name, (v, child, around) in items.items():
            if name in passed or child in o.inline and isinstance(v, dict):
                continue
            array = isinstance(v, list) and child not in o.inline
            if isinstance(v, dict) or array and any(isinstance(x, dict) for x in v):
                for n, x in enumerate(v if array else [v]):
                    if isinstance(x, dict):
                        to = "" if child in o.keys and child not in o.paths else f"{below}/{n}" if child in o.paths else f"{below}/{name}/{n}"
                        kids.append((x, child, around, above, name, array, n, to))
            if isinstance(v, dict) or child in o.declared and (v is None or array) and not _scalars(v):
                continue
            if not (array and v) or _scalars(v):
                cols[name] = _text(v)
        owner = up[0] if up else (None, None, None, None)
        between = [dict(zip(_UP_NAMES, x)) for x in up[1:]] if len(up) > 1 else None
        out.append((me[0], owner[0], owner[1], owner[3], between, element, member, many, order, key if named else here, here, link, json.dumps(cols)))
        stack.extend(reversed(kids))
    return out


def _scalars(v) -> bool:
    """Whether an array holds more than objects and nulls."""
    return isinstance(v, list) and any(x is not None and not isinstance(x, dict) for x in v)


def nodes(docs: DataFrame, column: str, o: Options) -> DataFrame:
    """NODES of all records, parsed once and written to the shared folder.

    A document that can't be read, or that isn't an object, has a row with nothing but a problem; null, empty and blank
    ones have none. Repeated records repeat their nodes, with ids of their own.
    """
    up = pa.list_(pa.struct([("node", pa.int64()), ("element", pa.string()), ("member", pa.string()), ("link", pa.string())]))
    schema = pa.schema([("node", pa.int64()), ("owner_node", pa.int64()), ("owner_element", pa.string()), ("owner_link", pa.string()), ("up", up), ("element", pa.string()), ("member", pa.string()), ("many", pa.bool_()), ("ord", pa.int32()), ("row_key", pa.string()), ("row_path", pa.string()), ("link", pa.string()), ("cols", pa.string()), ("problem", pa.string())])
    nothing = (None,) * (len(schema) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for b in batches:
            for doc in b.column(0).to_pylist():
                roots, problem = _roots(doc, o)
                if problem:
                    rows.append((*nothing, problem))
                for r in roots:
                    found = nodes_of(r, o, number)
                    number += len(found)
                    rows.extend((*x, None) for x in found)
                if len(rows) > 5_000:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return storage.materialize(docs.select(F.col(f"`{column}`")).mapInArrow(run, NODES), storage.workspace(docs.sparkSession, "nodes"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    try:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
    except UnicodeEncodeError:  # half of a pair of surrogates, which JSON may spell and text can't hold
        plain = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else [{k: plain(v) for k, v in e.items()} for e in x] if isinstance(x, list) else x
        return _batch([tuple(map(plain, r)) for r in rows], schema)


def rejected(found: DataFrame) -> DataFrame:
    """(problem, n): why documents, or records in them, have no rows."""
    return found.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Graph:
    """The schema graph: edges (parent, child, member, repeats)."""

    edges: tuple[tuple[str, str, str, bool], ...]
    options: Options

    def tables(self) -> set[str]:
        """Elements with a table: the root, and those that repeat, are shared by several parents or contain themselves."""
        o = self.options
        parents: dict[str, set[str]] = {}
        down: dict[str, set[str]] = {}
        out = {o.root, *o.declared}
        for parent, child, _, repeats in self.edges:
            down.setdefault(parent, set()).add(child)
            parents.setdefault(child, set()).add(parent)
            if repeats:
                out.add(child)
        out |= {c for c, ps in parents.items() if len(ps) > 1}
        for e in parents:
            seen: set[str] = set()
            todo = [e]
            while todo:
                new = down.get(todo.pop(), set()) - seen
                seen |= new
                todo.extend(new)
            if e in seen:
                out.add(e)
        return out


def schema_graph(found: DataFrame, o: Options) -> Graph:
    """The graph of all nodes. It is aggregated per task before the shuffle and grows with the names in the data, not its rows."""
    all_ = found.where("element is not null")
    parent = F.coalesce(F.try_element_at("up", F.lit(-1))["element"], F.col("owner_element"))
    edges = all_.groupBy(parent.alias("parent"), "element", "member").agg(F.bool_or("many").alias("repeats")).where("parent is not null")
    return Graph(tuple(sorted(tuple(r) for r in edges.collect())), o)


def columns_of(found: DataFrame) -> list[tuple[str, str]]:
    """(element, member) of all scalar members."""
    return sorted(tuple(r) for r in found.where("element is not null").select("element", F.explode(F.map_keys(_members("cols"))).alias("member")).distinct().collect())


def _members(c: str) -> Column:
    return F.from_json(c, "map<string,string>")


def _owner(tables: set[str]) -> Column:
    """The nearest object above that has a row."""
    nearer = F.try_element_at(F.filter("up", lambda x: x["element"].isin(*tables)), F.lit(-1))
    certain = F.struct(F.col("owner_node").alias("node"), F.col("owner_element").alias("element"), F.lit(None).cast("string").alias("member"), F.col("owner_link").alias("link"))
    return F.coalesce(nearer, certain)


def links(found: DataFrame, tables: set[str]) -> DataFrame:
    """tab, parent_tab, parent_key, ord, row_key, row_path: the rows of all tables without their columns, in one narrow stage.

    A null in an array is no child but keeps its position; an object where an array is expected is its only child, at
    position 0. parent_key is null where the parent has no key.
    """
    own = found.where(F.col("element").isin(*tables)).withColumn("p", _owner(tables))
    return own.select(F.col("element").alias("tab"), F.col("p.element").alias("parent_tab"), F.col("p.link").alias("parent_key"), "ord", "row_key", "row_path")


def shred(found: DataFrame, tables: set[str]) -> DataFrame:
    """links with cols: the members of each row, those of inlined elements named by their path, `a.b`.

    Only inlined elements are shuffled, to the rows that hold them. Arrays of scalars stay as JSON text.
    """
    all_ = found.where("element is not null")
    inlined = all_.where(~F.col("element").isin(*tables)).withColumn("p", _owner(tables))
    between = F.coalesce("up", F.array().cast(_UP))
    depth = F.coalesce(F.array_position(F.transform(between, lambda x: x["node"]), F.col("p.node")), F.lit(0))  # 0: the certain one
    prefix = F.array_join(F.concat(F.transform(F.slice(between, (depth + 1).cast("int"), F.size(between)), lambda x: x["member"]), F.array("member")), ".")
    named = inlined.withColumn("prefix", prefix).select(F.col("p.node").alias("row"), F.transform(F.map_entries(_members("cols")), lambda e: F.struct(F.concat("prefix", F.lit("."), e["key"]).alias("key"), e["value"].alias("value"))).alias("more"))
    more = named.groupBy("row").agg(F.flatten(F.collect_list("more")).alias("more"))
    own = all_.where(F.col("element").isin(*tables)).withColumn("p", _owner(tables)).join(more, F.col("node") == F.col("row"), "left")
    entries = F.concat(F.map_entries(_members("cols")), F.coalesce("more", F.array().cast("array<struct<key:string,value:string>>")))
    return own.select(F.col("element").alias("tab"), F.col("p.element").alias("parent_tab"), F.col("p.link").alias("parent_key"), "ord", "row_key", "row_path", F.map_from_entries(entries).alias("cols"))


def table_of(rows: DataFrame, graph: Graph, columns: list[tuple[str, str]], element: str) -> DataFrame:
    """The flat table of one element: its keys, position and one column per inlined path, as text."""
    tables, names = graph.tables(), []

    def walk(e: str, prefix: tuple[str, ...]) -> None:
        names.extend((*prefix, m) for owner, m in columns if owner == e)
        for p, c, member, _ in graph.edges:
            if p == e and c not in tables:
                walk(c, (*prefix, member))

    walk(element, ())
    fixed = ["parent_key", "ord", "row_key"]
    paths = {".".join(n): "_".join(n).replace(".", "_") for n in names}
    return rows.where(F.col("tab") == element).select(*fixed, *[F.col("cols")[n].alias(c if c not in fixed else f"{c}_") for n, c in paths.items()])
