"""Graph reads: decoding of dictionary-encoded triples, names, statistics, checks and class closure."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe import storage

#: fixed value: a name that XML allows for an element
XML_NAME = r"\A[\p{L}_][\p{L}\p{Nd}._-]*\z"


def namespaces(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """(id, uri, ord) of a prefix map, which keeps its order."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(mapping.items())], "id string, uri string, ord int")


def _map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")


def expand(uri: Column, mapping: dict[str, str]) -> Column:
    """prefix:local as the full URI; what has no colon or no known prefix stays."""
    ns = F.try_element_at(_map(mapping), F.substring_index(uri, ":", 1))
    return F.when(uri.contains(":") & ns.isNotNull(), F.concat(ns, F.regexp_replace(uri, r"\A[^:]*:", ""))).otherwise(uri)


def is_curie(uri: Column) -> Column:
    """Whether a URI is written with its prefix, as it goes into Turtle without brackets."""
    return uri.contains(":") & ~uri.startswith("http")


def uris(nodes: DataFrame) -> DataFrame:
    """(id, uri) of each node with a label; of repeated ids the least label."""
    return nodes.where("label is not null and id is not null").groupBy("id").agg(F.min("label").alias("uri"))


def page(triples: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of triples by id, for callers that want one; exports read all at once and need none."""
    out = triples.orderBy("id").offset(offset)
    return out if limit is None else out.limit(limit)


def is_uri(c: Column) -> Column:
    """Whether a text is an absolute URI: a scheme, a colon and something without spaces."""
    return F.coalesce(c.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+\z"), F.lit(False))


def escape_uri(c: Column) -> Column:
    """A text percent-encoded, with spaces as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def tagged(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.where(F.col("tag").isin(list(tags))) if tags else df


def decode(triples: DataFrame, uri: DataFrame, strict: bool = False) -> DataFrame:
    """triples with s, p and o: the URIs of their ids. strict: an unmapped id is an error, else it is null.

    The URI table is joined three times; Spark broadcasts it where it is small and sorts otherwise. The triple side is
    left, so a hot object class is split by skew handling.
    """
    out = triples
    for c, name in (("s_id", "s"), ("p_id", "p"), ("o_id", "o")):
        u = uri.select(F.col("id").alias(f"__{name}"), F.col("uri").alias(name))
        out = out.join(u, F.col(c) == F.col(f"__{name}"), "left").drop(f"__{name}")
        if strict:
            out = out.withColumn(name, F.when(F.col(c).isNotNull() & F.col(name).isNull(), F.raise_error(F.concat(F.lit("no URI for id "), F.col(c)))).otherwise(F.col(name)))
    return out


def referenced_nodes(nodes: DataFrame, triples: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Nodes that are the subject or object of a triple; predicates alone don't count."""
    ids = triples.select(F.col("s_id").alias("k")).union(triples.select("o_id")).where("k is not null").distinct()
    return tagged(nodes, tags).join(ids, F.col("id") == F.col("k"), "left_semi")


def statistics(decoded: DataFrame) -> DataFrame:
    """One row: triples, literals, resources, distinct subjects, predicates and objects."""
    lit = F.col("o_lit").isNotNull() & (F.col("o_lit") != "")
    return decoded.agg(F.count("*").alias("triples"), F.count_if(lit).alias("literals"), F.count_if(~F.coalesce(lit, F.lit(False)) & F.col("o_id").isNotNull()).alias("resources"), F.countDistinct("s_id").alias("subjects"), F.countDistinct("p_id").alias("predicates"), F.countDistinct("o_id").alias("objects"))


def invalid(triples: DataFrame, uri: DataFrame) -> DataFrame:
    """(id, place, ref): references of triples to ids without a URI."""
    refs = triples.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(c).alias("ref")) for p, c in (("subject", "s_id"), ("predicate", "p_id"), ("object", "o_id"))])).alias("x")).select("id", "x.place", "x.ref").where("ref is not null").distinct()
    return refs.join(uri.select(F.col("id").alias("__u")), F.col("ref") == F.col("__u"), "left_anti")


def find(decoded: DataFrame, mapping: dict[str, str], s: str | None = None, p: str | None = None, o: str | None = None, lit: str | None = None, tag: str | None = None) -> DataFrame:
    """Triples by subject, predicate, object, literal or tag; URIs are given short or in full."""
    tests = [(F.col(c) == v) | (expand(F.col(c), mapping) == v) for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    tests += [F.col(c) == v for c, v in (("o_lit", lit), ("tag", tag)) if v is not None]
    for t in tests:
        decoded = decoded.where(t)
    return decoded


def contains(decoded: DataFrame, s: str, p: str, o: str | None = None, lit: str | None = None) -> bool:
    return bool(decoded.where((F.col("s") == s) & (F.col("p") == p) & F.col("o").eqNullSafe(F.lit(o)) & F.col("o_lit").eqNullSafe(F.lit(lit))).limit(1).count())


def split_name(uri: Column, mapping: dict[str, str], ns_table: DataFrame | None = None) -> tuple[Column, Column]:
    """(namespace, local name) for an XML element: by prefix, else by the first namespace that leaves a valid name.

    What fits none is split after its last `#` or `/`; a name that XML doesn't allow becomes `predicate_` and a checksum.
    """
    prefix, rest = F.substring_index(uri, ":", 1), F.regexp_replace(uri, r"\A[^:]*:", "")
    short = is_curie(uri) & F.try_element_at(_map(mapping), prefix).isNotNull()
    ns, local = F.lit(None).cast("string"), F.lit(None).cast("string")
    for value in reversed(list(mapping.values())):
        tail = F.substring(uri, len(value) + 1, 2**30)
        ok = uri.startswith(value) & tail.rlike(XML_NAME)
        ns, local = F.when(ok, F.lit(value)).otherwise(ns), F.when(ok, tail).otherwise(local)
    tail = F.regexp_extract(uri, r"[/#]([^/#]+)\z", 1)
    head = F.regexp_extract(uri, r"\A(.*[/#])[^/#]+\z", 1)
    split = tail.rlike(XML_NAME)
    ns = F.when(short, F.try_element_at(_map(mapping), prefix)).when(ns.isNotNull(), ns).when(split, head).otherwise(F.lit("http://unknown.namespace/"))
    local = F.when(short, rest).when(local.isNotNull(), local).when(split, tail).otherwise(F.concat(F.lit("predicate_"), F.hex(F.crc32(uri))))
    return ns, local


def class_closure(triples: DataFrame, a_id: int, sub_id: int, flush: int = 16) -> DataFrame:
    """(id, class_id, level): the classes of each instance, by its types and their superclasses, at the least level.

    Super-class edges are closed level by level, each level a join of the newest pairs with the edges; a pair that is
    already known isn't followed again, so cycles end, and it goes on until a level adds no pair. Levels are written to
    the shared folder, and every flush levels as one table, which bounds the plan.
    """
    spark = triples.sparkSession
    typed = triples.where((F.col("p_id") == a_id) & F.col("o_id").isNotNull() & F.col("s_id").isNotNull()).select(F.col("s_id").alias("id"), F.col("o_id").alias("class_id")).distinct()
    edges = triples.where((F.col("p_id") == sub_id) & F.col("o_id").isNotNull() & F.col("s_id").isNotNull()).select(F.col("s_id").alias("sub"), F.col("o_id").alias("super")).distinct()
    # closure over classes only, as there are far fewer of them than instances
    folder = storage.workspace(spark, "closure")
    reach = storage.materialize(typed.select("class_id").distinct().select(F.col("class_id").alias("start"), F.col("class_id").alias("at"), F.lit(1).alias("level")), f"{folder}/1")
    newest, paths = reach, [reach]
    for level in itertools.count(2):
        step = newest.join(edges, F.col("at") == F.col("sub")).select("start", F.col("super").alias("at"), F.lit(level).alias("level")).distinct()
        for known in paths:
            step = step.join(known.select("start", "at"), ["start", "at"], "left_anti")
        newest = storage.materialize(step.select("start", "at", "level"), f"{folder}/{level}")
        if newest.isEmpty():
            break
        paths.append(newest)
        if len(paths) > flush:
            paths = [storage.materialize(functools.reduce(DataFrame.unionByName, paths), f"{folder}/to-{level}")]
    reach = functools.reduce(DataFrame.unionByName, paths)
    return typed.join(reach, F.col("class_id") == F.col("start")).groupBy("id", F.col("at").alias("class_id")).agg(F.min("level").alias("level"))


def node_labels_by_prefix(uri: DataFrame, ns: DataFrame) -> DataFrame:
    """(id, uri, prefix): the first namespace, in its order, that starts a URI and leaves a valid XML name.

    A URI is cut at each length that a namespace has, of which there are few, and the cuts are joined by equality; so a
    namespace may end in any character, and no URI meets all namespaces. The driver gets the distinct lengths.
    """
    lengths = sorted(r[0] for r in ns.select(F.length("uri")).where("uri is not null").distinct().collect())
    cut = F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n < F.length("uri")))
    left = uri.withColumn("__cut", cut).where(F.substr("uri", F.col("__cut") + 1).rlike(XML_NAME)).withColumn("__head", F.substr("uri", F.lit(1), F.col("__cut")))
    names = ns.select(F.col("uri").alias("__ns"), F.col("id").alias("prefix"), "ord")
    first = left.join(names, F.col("__head") == F.col("__ns")).groupBy("id", "uri").agg(F.min_by("prefix", "ord").alias("prefix"))
    return first.select("id", "uri", "prefix")


def namespaces_of(lookup: DataFrame) -> DataFrame:
    """(id, uri, ord) of a table namespace_lookup (id, uri), in the order of ids; of repeated ids the least URI."""
    one = lookup.where("id is not null and uri is not null").groupBy("id").agg(F.min("uri").alias("uri"))
    return one.withColumn("ord", F.col("id"))


def uris_of(lookup: DataFrame) -> DataFrame:
    """(id, uri) of a table uri_lookup (id, uri), as decode() wants it; of repeated ids the least URI."""
    return lookup.where("id is not null and uri is not null").groupBy("id").agg(F.min("uri").alias("uri"))
