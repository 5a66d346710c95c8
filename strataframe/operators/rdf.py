"""Serialisations of decoded triples: one row per line or per subject, and whole files with head and foot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.graph import expand, is_curie, split_name

#: fixed values: escapes of literals, and aliases of the formats
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
FORMATS = {"turtle": "turtle", "ttl": "turtle", "ntriples": "ntriples", "nt": "ntriples", "rdfxml": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml", "rdfowlxml": "owlxml", "owlxml": "owlxml", "owl": "owlxml", "jsonld": "jsonld", "json-ld": "jsonld", "json": "jsonld", "ram": "ram", "test": "ram"}
RDF, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"


def has(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def escaped(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def literal(mapping: dict[str, str] | None = None) -> Column:
    """The object literal with its language, or else its datatype; mapping expands short datatypes to full ones."""
    text = F.concat(F.lit('"'), escaped(F.col("o_lit")), F.lit('"'))
    kind = F.col("o_lit_type")
    typed = F.when(is_curie(kind), kind if mapping is None else F.concat(F.lit("<"), expand(kind, mapping), F.lit(">"))).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    return F.when(has("o_lit_lang"), F.concat(text, F.lit("@"), F.col("o_lit_lang"))).when(has("o_lit_type"), F.concat(text, F.lit("^^"), typed)).otherwise(text)


def _term(c: str, mapping: dict[str, str]) -> Column:
    return F.when(is_curie(F.col(c)), F.col(c)).otherwise(F.concat(F.lit("<"), expand(F.col(c), mapping), F.lit(">")))


def _full(c: str, mapping: dict[str, str]) -> Column:
    return F.concat(F.lit("<"), expand(F.col(c), mapping), F.lit(">"))


def turtle(decoded: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, line). A triple with neither literal nor object has no line."""
    o = F.when(has("o_lit"), literal()).otherwise(_term("o", mapping))
    return decoded.select("id", F.concat(_term("s", mapping), F.lit(" "), _term("p", mapping), F.lit(" "), o, F.lit(" .")).alias("line")).where("line is not null")


def ntriples(decoded: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, line), with every URI in full, those of datatypes too."""
    o = F.when(has("o_lit"), literal(mapping)).otherwise(_full("o", mapping))
    return decoded.select("id", F.concat(_full("s", mapping), F.lit(" "), _full("p", mapping), F.lit(" "), o, F.lit(" .")).alias("line")).where("line is not null")


def json_text(c: Column) -> Column:
    """A JSON string; control characters that have no short escape get a numbered one."""
    text = numbered = escaped(c)
    for n in range(32):
        if chr(n) not in "\n\r\t":
            numbered = F.replace(numbered, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), numbered).otherwise(text), F.lit('"'))


def jsonld(decoded: DataFrame) -> DataFrame:
    """(s_id, node): one JSON object per subject, always, its predicates in the order of their first triple.

    A predicate with one value has it bare, one with several an array.
    """
    lang = F.when(has("o_lit_lang"), F.concat(F.lit(', "@language": '), json_text(F.col("o_lit_lang")))).when(has("o_lit_type"), F.concat(F.lit(', "@type": '), json_text(F.col("o_lit_type")))).otherwise(F.lit(""))
    value = F.when(has("o_lit"), F.concat(F.lit('{"@value": '), json_text(F.col("o_lit")), lang, F.lit("}"))).otherwise(F.concat(F.lit('{"@id": '), json_text(F.col("o")), F.lit("}")))
    rows = decoded.select("s_id", "s", "p", "id", value.alias("v")).where("v is not null and s is not null and p is not null")
    by_p = rows.groupBy("s_id", "s", "p").agg(F.min("id").alias("first"), F.array_sort(F.collect_list(F.struct("id", "v"))).alias("vs"))
    joined = F.array_join(F.transform("vs", lambda x: x["v"]), ", ")
    member = F.concat(json_text(F.col("p")), F.lit(": "), F.when(F.size("vs") == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]"))))
    by_s = by_p.select("s_id", "s", "first", "p", member.alias("m")).groupBy("s_id", "s").agg(F.array_sort(F.collect_list(F.struct("first", "p", "m"))).alias("ms"))
    return by_s.select("s_id", F.concat(F.lit('{"@id": '), json_text(F.col("s")), F.lit(", "), F.array_join(F.transform("ms", lambda x: x["m"]), ", "), F.lit("}")).alias("node"))


def xml_text(c: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_subjects(decoded: DataFrame, mapping: dict[str, str], element: str = "rdf:Description") -> DataFrame:
    """(s_id, xml): one element per subject, always, with its predicates in the order of their ids."""
    ns, local = split_name(F.col("p"), mapping)
    by_uri = {v: k for k, v in reversed(list(mapping.items()))}  # of equal namespaces the first prefix
    prefixes = F.create_map(*[F.lit(x) for kv in by_uri.items() for x in kv]) if by_uri else F.create_map().cast("map<string,string>")
    known = F.try_element_at(prefixes, F.col("ns"))
    rows = decoded.where("s is not null and p is not null").withColumn("ns", ns).withColumn("local", local)
    other = next(f"ns{i}" for i in range(1, len(mapping) + 2) if f"ns{i}" not in mapping)  # declared where it is used
    name = F.when(known.isNotNull(), F.concat(known, F.lit(":"), F.col("local"))).otherwise(F.concat(F.lit(f"{other}:"), F.col("local")))
    declared = F.when(known.isNull(), F.concat(F.lit(f' xmlns:{other}="'), xml_text(F.col("ns"), True), F.lit('"'))).otherwise(F.lit(""))
    kind = F.when(is_curie(F.col("o_lit_type")), expand(F.col("o_lit_type"), mapping)).otherwise(F.col("o_lit_type"))
    attr = F.when(has("o_lit_lang"), F.concat(F.lit(' xml:lang="'), xml_text(F.col("o_lit_lang"), True), F.lit('"'))).when(has("o_lit_type"), F.concat(F.lit(' rdf:datatype="'), xml_text(kind, True), F.lit('"'))).otherwise(F.lit(""))
    inner = (
        F.when(has("o_lit"), F.concat(F.lit("<"), name, declared, attr, F.lit(">"), xml_text(F.col("o_lit")), F.lit("</"), name, F.lit(">")))
        .when(F.col("o").isNotNull(), F.concat(F.lit("<"), name, declared, F.lit(' rdf:resource="'), xml_text(expand(F.col("o"), mapping), True), F.lit('" />')))
        .otherwise(F.concat(F.lit("<"), name, declared, F.lit(" />")))
    )
    grouped = rows.select("s_id", "s", "id", inner.alias("x")).groupBy("s_id", "s").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("xs"))
    about = xml_text(expand(F.col("s"), mapping), True)
    return grouped.select("s_id", F.concat(F.lit(f'<{element} rdf:about="'), about, F.lit('">'), F.array_join(F.transform("xs", lambda r: r["x"]), ""), F.lit(f"</{element}>")).alias("xml"))


@dataclass(frozen=True)
class Settings:
    """Head and foot of a file; stamp is the text of its export date, base the base URI."""

    prefixes: bool = True
    comments: bool = True
    base: str | None = None
    stamp: str = ""
    encoding: str = "utf-8"


def document(decoded: DataFrame, mapping: dict[str, str], form: str, settings: Settings = Settings()) -> DataFrame:
    """(n, line): the lines of a whole file in a format of FORMATS, to be written in the order of n."""
    kind = FORMATS[form.lower()]
    head: list[str] = []
    foot: list[str] = []
    stamped = ["RDF data exported from the graph", f"Export date: {settings.stamp}"]
    if kind == "turtle":
        head += [*(f"@prefix {k}: <{v}> ." for k, v in mapping.items()), ""] if settings.prefixes else []
        head += [f"@base <{settings.base}> .", ""] if settings.base else []
        head += [*(f"# {c}" for c in stamped), ""] if settings.comments else []
        foot += ["", "# End of RDF data"] if settings.comments else []
        body = turtle(decoded, mapping).select(F.col("id").cast("long").alias("k"), "line")
    elif kind in ("ntriples", "ram"):
        head += [f"# {c}" for c in stamped] if settings.comments else []
        foot += ["# End of RDF data"] if settings.comments else []
        body = ntriples(decoded, mapping).select(F.col("id").cast("long").alias("k"), "line")
    elif kind == "jsonld":
        context = [f'"{k}": "{v}"' for k, v in mapping.items()] + ([f'"@base": "{settings.base}"'] if settings.base else [])
        head += ["{", *([f'  "@comment": "{"; ".join(stamped)}",'] if settings.comments else []), '  "@context": {' + ", ".join(context) + "},", '  "@graph": [']
        foot += ["  ]", "}"]
        body = jsonld(decoded).select(F.col("s_id").cast("long").alias("k"), F.col("node").alias("line"))
    else:
        owl = kind == "owlxml"
        spaces = {"rdf": RDF, **({"owl": OWL} if owl else {})} | mapping
        head += [f'<?xml version="1.0" encoding="{settings.encoding}"?>', "<rdf:RDF " + " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items()) + (f' xml:base="{settings.base}"' if settings.base else "") + ">"]
        head += [f"<!-- {c} -->" for c in stamped] if settings.comments else []
        foot += ["</rdf:RDF>"]
        body = xml_subjects(decoded, spaces, "owl:NamedIndividual" if owl else "rdf:Description").select(F.col("s_id").cast("long").alias("k"), F.col("xml").alias("line"))
    spark = decoded.sparkSession
    body = body.withColumn("part", F.lit(1))
    if kind == "jsonld":  # every node but the last ends with a comma; the last is known without making any
        last = decoded.where("s is not null and p is not null").where(has("o_lit") | F.col("o").isNotNull()).agg(F.max("s_id")).first()[0]
        body = body.withColumn("line", F.when(F.col("k") == F.lit(last).cast("long"), F.col("line")).otherwise(F.concat("line", F.lit(","))))
    ends = spark.createDataFrame([(i, x, 0) for i, x in enumerate(head)] + [(i, x, 2) for i, x in enumerate(foot)], "k long, line string, part int")
    return ends.unionByName(body).select(F.struct("part", "k").alias("n"), "line")


def line_statistics(lines: DataFrame) -> DataFrame:
    """One row: the header, output and footer lines of a document."""
    count = lambda part, name: F.count_if(F.col("n.part") == part).alias(name)
    return lines.agg(count(0, "header_lines"), count(1, "output_lines"), count(2, "footer_lines"))
