"""Commands over a folder of tables: dump, dump-thesauri, export-rdf, render and json-to-xml."""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataframe import registry
from strataframe.functions import arrow
from strataframe.functions.predicates import FrameFilter
from strataframe.operators import framing, graph, rdf, render, texts, thesaurus
from strataframe.sources import sinks
from strataframe.storage import table


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataframe")
    sub = top.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dump", help="a frame of items as JSON")
    d.add_argument("folder"), d.add_argument("output")
    for name in ("title", "description", "facet-id", "group-id", "user-id", "min-time", "max-time"):
        d.add_argument(f"--{name}")
    d.add_argument("--flags", type=int), d.add_argument("--flag-match", default="all_set", choices=["all_set", "any_set", "all_clear", "any_clear"])
    d.add_argument("--white", action="append", default=[]), d.add_argument("--black", action="append", default=[])
    d.add_argument("--no-deleted", action="store_true"), d.add_argument("--no-parts", action="store_true"), d.add_argument("--no-part-date", action="store_true")
    d.add_argument("--page", type=int), d.add_argument("--page-size", type=int, default=20), d.add_argument("--max-per-file", type=int, default=100_000)
    t = sub.add_parser("dump-thesauri", help="vocabularies as JSON")
    t.add_argument("folder"), t.add_argument("output")
    r = sub.add_parser("export-rdf", help="triples in an RDF format")
    r.add_argument("folder"), r.add_argument("output"), r.add_argument("--format", default="turtle", choices=sorted(rdf.FORMATS))
    r.add_argument("--prefixes", default="{}", help="JSON object of prefixes"), r.add_argument("--tag", action="append", default=[]), r.add_argument("--base"), r.add_argument("--no-comments", action="store_true"), r.add_argument("--referenced-only", action="store_true")
    e = sub.add_parser("render", help="texts of items by group")
    e.add_argument("folder"), e.add_argument("output"), e.add_argument("--as", dest="kind", default="tei-off", choices=["text", "json", "tei-off", "tei-app", "tei-parallel"]), e.add_argument("--max", type=int)
    e.add_argument("--config", help="JSON file of components; its composer is used instead of --as"), e.add_argument("--composer", default="default", help="the composer's key")
    x = sub.add_parser("json-to-xml", help="JSON files, one document a line, as XML")
    x.add_argument("input"), x.add_argument("output"), x.add_argument("--root", default="root"), x.add_argument("--numbered", action="store_true"), x.add_argument("--skip", action="append", default=[], choices=["null", "false", "zero"])
    return top


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    if a.command == "dump":
        f = FrameFilter(a.title, a.description, a.facet_id, a.group_id, a.user_id, a.flags, a.flag_match, a.min_time, a.max_time, tuple(a.white), tuple(a.black), a.page, a.page_size)
        frame = framing.frame(table(spark, a.folder, "history_items"), table(spark, a.folder, "history_parts"), f, not a.no_parts, not a.no_part_date, not a.no_deleted)
        sinks.envelope_lines(frame, a.output, a.max_per_file, {k: v for k, v in vars(a).items() if k not in ("command", "folder", "output")}, now)
    elif a.command == "dump-thesauri":
        sinks.ordered_lines(thesaurus.documents(table(spark, a.folder, "thesauri")), a.output, "n", "json")
    elif a.command == "export-rdf":
        triples, nodes = graph.tagged(table(spark, a.folder, "triple").distinct(), a.tag), table(spark, a.folder, "node")
        decoded = graph.decode(triples, graph.uris(graph.referenced_nodes(nodes, triples) if a.referenced_only else nodes))
        sinks.ordered_lines(rdf.document(decoded, json.loads(a.prefixes), a.format, rdf.Settings(comments=not a.no_comments, base=a.base, stamp=now)), a.output)
    elif a.command == "render":
        items = framing.snapshot(table(spark, a.folder, "history_items"), FrameFilter(), False)
        if a.max:
            items = items.orderBy("sortKey", "_id").limit(a.max)
        if a.config:
            with open(a.config, encoding="utf-8-sig") as f:
                configuration = registry.Configuration.parse(f.read())
            for key in configuration.keys("itemIdCollectors"):
                ids = configuration.get("itemIdCollectors", key)(table(spark, a.folder, "items")).toDF("__k")
                items = items.join(ids, F.col("_id") == F.col("__k"), "left_semi")
            return sinks.text_flows(configuration.compose(a.composer, items, table(spark, a.folder, "parts")), a.output)
        base, frs, segments = texts.layered(table(spark, a.folder, "parts"))
        pieces = texts.with_lines(texts.block_lines(segments))
        kinds = {
            "text": lambda: base.select("item_id", "text"),
            "json": lambda: render.payload_lines(pieces),
            "tei-off": lambda: render.tei_standoff(pieces),
            "tei-app": lambda: render.tei_apparatus(pieces, render.apparatus(segments, texts.apparatus_entries(frs))),
            "tei-parallel": lambda: render.tei_parallel(texts.version_tree(texts.versions(segments, texts.apparatus_entries(frs)))),
        }
        sinks.text_flows(render.composed(items, kinds[a.kind]()), a.output)
    else:
        o = arrow.XmlOptions(a.root, numbered=a.numbered, skip=frozenset(a.skip))
        spark.read.text(a.input).select(arrow.json_to_xml_filter(o)("value").alias("value")).where("value is not null").write.text(a.output)


def main() -> None:
    run(SparkSession.builder.appName("strataframe").config("spark.sql.session.timeZone", "UTC").getOrCreate())


if __name__ == "__main__":
    main()
