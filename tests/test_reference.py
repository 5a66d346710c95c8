"""Known answers of framing, layered texts, renditions, text functions and vocabularies, as small inline tables."""

import datetime
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from strataframe import cli, registry
from strataframe.functions import arrow, codes, jsonpath, scalars
from strataframe.functions.predicates import FrameFilter
from strataframe.operators import cdc, framing, graph, rdf, render, texts, thesaurus
from strataframe.plans import reference
from strataframe.sources import readers, sinks
from strataframe.storage import workspace
from strataframe.streaming import feeds
from tests import brute

D = lambda m, d: datetime.datetime(2023, m, d)
PREFIXES = {"a": "http://a.org/", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def history(spark):
    items = [("h1", "i1", 0, 1, 1), ("h2", "i2", 0, 2, 1), ("h3", "i2", 1, 4, 2), ("h4", "i3", 0, 3, 5), ("h5", "i4", 0, 2, 2), ("h6", "i4", 2, 5, 10), ("h7", "i5", 0, 5, 15)]
    parts = [("p1", "i1", "q1", 0, 1, 1, "note", None), ("p2", "i2", "q2", 0, 2, 1, "token", None), ("p3", "i2", "q3", 0, 2, 1, "note", None), ("p4", "i2", "q3", 1, 5, 8, "note", None), ("p5", "i3", "q4", 0, 3, 5, "token", "sample"), ("p6", "i4", "q5", 0, 2, 2, "note", None), ("p7", "i4", "q5", 2, 5, 10, "note", None)]
    hi = spark.createDataFrame([(i, r, s, D(m, d), f"title {r}", f"k{r}", "default" if r != "i3" else "other", int(r[1])) for i, r, s, m, d in items], "_id string, referenceId string, status int, timeModified timestamp_ntz, title string, sortKey string, facetId string, flags int")
    hp = spark.createDataFrame([(i, it, r, s, D(m, d), t, ro, "{}") for i, it, r, s, m, d, t, ro in parts], "_id string, itemId string, referenceId string, status int, timeModified timestamp_ntz, typeId string, roleId string, content string")
    return hi, hp


def frame(history, f=FrameFilter(), **o):
    return {r._id: (r._status, sorted(p._id for p in r._parts)) for r in framing.frame(*history, f, **o).collect()}


def test_snapshots(history):
    assert frame(history) == {"i1": (0, ["q1"]), "i2": (1, ["q2", "q3"]), "i3": (0, ["q4"]), "i4": (2, ["q5"]), "i5": (0, [])}
    assert frame(history, with_deleted=False) == {"i1": (0, ["q1"]), "i2": (1, ["q2", "q3"]), "i3": (0, ["q4"]), "i5": (0, [])}
    assert frame(history, FrameFilter(max_time="2023-03-01 00:00:00")) == {"i1": (0, ["q1"]), "i2": (0, ["q2", "q3"]), "i4": (0, ["q5"])}
    assert set(frame(history, FrameFilter(facet_id="default"))) == {"i1", "i2", "i4", "i5"}
    assert frame(history, FrameFilter(white_types=("token",)))["i3"] == (0, [])
    assert frame(history, FrameFilter(white_types=("token:sample",)))["i3"] == (0, ["q4"])
    assert frame(history, FrameFilter(black_types=("token",)))["i2"] == (1, ["q3"])
    pages = [framing.snapshot(history[0], FrameFilter(page=p, page_size=2)).select("_id").collect() for p in (1, 2, 3)]
    assert [[r[0] for r in p] for p in pages] == [["i1", "i2"], ["i3", "i4"], ["i5"]]
    assert FrameFilter().is_empty and not FrameFilter(title="x").is_empty


def test_incremental_frames(history):
    f = FrameFilter(min_time="2023-05-01 00:00:00", max_time="2023-05-20 00:00:00")
    assert frame(history, f) == {"i2": (1, ["q3"]), "i4": (2, ["q5"]), "i5": (0, [])}
    assert set(frame(history, f, part_date=False)) == {"i4", "i5"}
    early = FrameFilter(min_time="2023-02-01 00:00:00", max_time="2023-02-01 12:00:00")
    assert frame(history, early)["i2"] == (1, ["q2", "q3"])  # the last version, though later than the interval


def test_an_item_is_one_row_however_many_parts_it_has(spark, history):
    items = framing.snapshot(history[0], FrameFilter())
    parts = framing.parts_of(history[1], FrameFilter()).where("_id = 'q1'").withColumn("_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: i.cast("string"))))
    rows = framing.nest(items, parts)
    assert rows.count() == items.count() and rows.where("_id = 'i1'").select(F.size("_parts")).first()[0] == 50_000
    assert framing.child_parts(items, parts).count() == 50_000


def test_imports(spark, tmp_path):
    items = spark.createDataFrame([("a", None, "", None, None, "", None, D(1, 1), D(1, 1)), ("b", "T 1", "d", "f", "k", "u", "w", D(1, 1), D(1, 1))], "_id string, title string, description string, facetId string, sortKey string, creatorId string, userId string, timeCreated timestamp_ntz, timeModified timestamp_ntz")
    got = {r._id: r for r in framing.items_patched(items).collect()}
    assert (got["a"].title, got["a"].facetId, got["a"].userId, got["a"].description) == ("a", "default", "zeus", "") and got["b"].title == "T 1"
    parts = spark.createDataFrame([("p", "a", "t", None, D(1, 1))], "_id string, itemId string, typeId string, roleId string, timeModified timestamp_ntz")
    assert {(r.itemId, r.typeId) for r in framing.ensure_parts(items, parts, "t").collect()} == {("a", "t"), ("b", "t")}
    sinks.append_import(items, parts, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/history_items.parquet").where("status = 0").count() == 2
    text = sinks.markdown_items(framing.items_patched(items), 1).orderBy("file").collect()
    assert [r.file for r in text] == ["d00001.md", "d00002.md"] and "#### T 1" in text[1].text


LINES = ["que bixit", "annos XX"]


@pytest.fixture(scope="module")
def layered(spark):
    base = spark.createDataFrame([("i", "t", LINES, "\n".join(LINES)), ("empty", "u", [], "")], "item_id string, part_id string, lines array<string>, text string")
    locs = ["1.1@3", "1.2@1", "1.1@3-1.2@1", "1.2-2.1", "9.9", "x", "0.1", "1.0", "2.1-9.1", "99999999999.1", None]
    frs = spark.createDataFrame([("i", f"fr{i + 1}", x) for i, x in enumerate(locs)], "item_id string, fr_id string, location string")
    return base, texts.flatten(base, frs)


def test_locations(layered):
    assert {r.fr_id: (r.start, r.end) for r in layered[1].collect()} == {"fr1": (2, 2), "fr2": (4, 4), "fr3": (2, 4), "fr4": (4, 14)}


def test_consecutive_ranges(layered):
    got = [(r.start, r.end, r.fragment_ids, r.text) for r in texts.consecutive(*layered).orderBy("n").collect()]
    assert got == [(0, 1, [], "qu"), (2, 2, ["fr1", "fr3"], "e"), (3, 3, ["fr3"], " "), (4, 4, ["fr2", "fr3", "fr4"], "b"), (5, 14, ["fr4"], "ixit\nannos"), (15, 17, [], " XX")]


def test_ranges_tile_a_long_text(spark):
    n = 5000
    base = spark.createDataFrame([("i", "ab\n" * n)], "item_id string, text string")
    ranges = spark.range(2000).select(F.lit("i").alias("item_id"), F.concat(F.lit("r"), F.col("id")).alias("fr_id"), (F.col("id") * 7 % (3 * n)).cast("int").alias("start"), (F.col("id") * 7 % (3 * n) + F.col("id") % 50 - 3).cast("int").alias("end")).where("end >= start")
    rows = texts.consecutive(base, ranges).orderBy("start").collect()
    assert rows[0].start == 0 and rows[-1].end == 3 * n - 1 and all(a.end + 1 == b.start for a, b in zip(rows, rows[1:]))
    some = ranges.collect()
    for r in rows[::97]:
        assert r.fragment_ids == sorted(x.fr_id for x in some if x.start <= r.start and x.end >= r.end)


def test_standoff_golden(layered):
    pieces = texts.with_lines(texts.block_lines(texts.consecutive(*layered)))
    assert [(r.text, r.eol) for r in pieces.orderBy("n", "k").collect()] == [("qu", False), ("e", False), (" ", False), ("b", False), ("ixit", True), ("annos", False), (" XX", False)]
    ns = 'xmlns="http://www.tei-c.org/ns/1.0"'
    want = f'<p source="^i" n="1" {ns}>qu<seg xml:id="seg1">e</seg><seg xml:id="seg2"> </seg><seg xml:id="seg3">b</seg><seg xml:id="seg4">ixit</seg></p><p source="^i" n="2" {ns}><seg xml:id="seg4">annos</seg> XX</p>'
    assert render.tei_standoff(pieces).first().xml == want
    lines = json.loads(render.payload_lines(pieces).first().json)
    assert [[x["text"] for x in y] for y in lines] == [["qu", "e", " ", "b", "ixit"], ["annos", " XX"]]


def segments(spark, *parts):
    return spark.createDataFrame([("i", n, t, [("x", v)] if v else []) for n, (t, v) in enumerate(parts, 1)], f"item_id string, n int, text string, features {scalars.FEATURES}")


def test_preview(spark):
    rows = [("t", "i", "x.token-text", "any", json.dumps({"lines": [{"y": i + 1, "text": x} for i, x in enumerate(LINES)]})), ("l", "i", "x.layer", "fr.a", json.dumps({"fragments": [{"location": "1.1@3"}, {"location": "1.2@1"}]})), ("m", "i", "x.layer", "fr.b", json.dumps({"fragments": {"location": "1.2-2.1"}}))]
    parts = spark.createDataFrame([(*r, D(1, 1), D(1, 1)) for r in rows], "_id string, itemId string, typeId string, roleId string, content string, timeModified timestamp_ntz, arrivedAt timestamp_ntz")
    got = [(r.text, r.eol) for r in texts.preview(parts, "t", ["l", "m"]).orderBy("n", "k").collect()]
    assert got == [("qu", False), ("e", False), (" ", False), ("b", False), ("ixit", True), ("annos", False), (" XX", False)]
    assert [r.text for r in texts.preview(parts, "t", ["l"]).orderBy("n", "k").collect()] == ["qu", "e", " ", "b", "ixit", "annos XX"]


def test_merge_linear(spark):
    got = lambda *p, **o: [r.text for r in texts.merge_linear(segments(spark, *p), **o).orderBy("n").collect()]
    assert got(("A", "1"), ("B\n", "1"), ("C", "1")) == ["AB\n", "C"]
    assert got(("A", "1"), ("B\n", "1"), ("C", "1"), break_at_lf=False) == ["AB\nC"]
    assert got(("A", "1"), ("B", None), ("C", None), ("D", "1")) == ["A", "BC", "D"]
    assert got(("A\n", "1"), ("", "1"), ("B", "1")) == ["A\n", "B"]
    assert got(("A", "1"), ("B", "2"), names=("y",)) == ["AB"]


@pytest.mark.parametrize(
    ("parts", "want"),
    [(["ab"], [("ab", False)]), (["a\n", "b"], [("a", True), ("b", False)]), (["a", "\n", "b"], [("a", True), ("b", False)]), (["a", "\nb"], [("a", True), ("b", False)]), (["a\n\n\nb"], [("a", True), ("b", False)]), (["\n\na"], [("a", False)]), (["\n"], []), (["a\nb\nc\n"], [("a", True), ("b", True), ("c", True)]), ([None, "a"], [("a", False)]), (["a", "", "b"], [("a", False), ("b", False)])],
)
def test_block_lines(spark, parts, want):
    df = segments(spark, *[(p, "1") for p in parts])
    assert [(r.text, r.eol) for r in texts.block_lines(df).orderBy("n", "k").collect()] == want


def test_runs_and_ids(spark):
    df = segments(spark, ("a", None), ("b", "1"), ("c", "1"), ("d", None), ("e", "1"))
    assert texts.first_run(df, F.size("features") > 0).first() == ("i", 2, 3)
    ids = texts.dense_ids(spark.createDataFrame([("m", "z", 1), ("m", "y", 2), ("m", "z", 3), ("o", "y", 1)], "g string, k string, n int"), ["g"], "k", ["n"])
    assert {tuple(r) for r in ids.collect()} == {("m", "z", 1), ("m", "y", 2), ("o", "y", 1)}


@pytest.fixture(scope="module")
def apparatus(spark):
    fr = lambda i: f"t:fr.apparatus@{i}"
    segs = spark.createDataFrame([("i", 1, "illuc", [fr(0)], False), ("i", 2, " unde negant redire ", [], False), ("i", 3, "quemquam", [fr(1)], False)], "item_id string, n int, text string, fragment_ids array<string>, eol boolean")
    w = lambda *xs: json.dumps([{"value": x} for x in xs])
    one = [{"type": 0, "value": "illuc", "isAccepted": True, "witnesses": w("O1")}, {"type": 0, "value": "illud", "witnesses": w("O", "G", "R")}, {"type": 0, "value": "illic", "authors": json.dumps([{"value": "Fruterius", "note": "(†1566) 1605a 388"}])}]
    two = [{"type": 3, "isAccepted": True, "witnesses": w("O", "G")}, {"type": 0, "value": "umquam", "note": "some note", "witnesses": json.dumps({"value": "R"})}]
    frs = spark.createDataFrame([("i", "p", "fr.apparatus", i, fr(i), None, json.dumps(e)) for i, e in enumerate((one, two))], "item_id string, part_id string, role_id string, fr_index int, fr_id string, tag string, entries string")
    return segs, texts.apparatus_entries(frs)


def test_apparatus_golden(apparatus):
    segs, entries = apparatus
    pieces = texts.with_lines(texts.block_lines(segs))
    got = render.tei_apparatus(pieces, render.apparatus(segs, entries)).first().xml
    assert got == (
        '<p source="^i" n="1" xmlns="http://www.tei-c.org/ns/1.0"><app n="1"><lem n="1" wit="#O1">illuc</lem><rdg n="2" wit="#O #G #R">illud</rdg><rdg n="3" xml:id="rdg1" resp="#Fruterius">illic</rdg>'
        '<witDetail target="#rdg1" resp="#Fruterius">(†1566) 1605a 388</witDetail></app> unde negant redire <app n="2"><lem n="1" wit="#O #G">quemquam</lem><rdg n="2" wit="#R">umquam<note>some note</note></rdg></app></p>'
    )
    standoff = render.apparatus(segs, entries, located=True).orderBy("fr_id").first().xml
    assert standoff.startswith('<app n="1" loc="#seg1">')


def test_parallel_golden(apparatus):
    tree = texts.version_tree(texts.versions(*apparatus))
    got = {(r.n, r.text, tuple(r.tags)) for r in tree.collect()}
    assert (1, "illuc", ("", "w:O1")) in got and (1, "illud", ("w:G", "w:O", "w:R")) in got and (1, "illic", ("a:Fruterius",)) in got
    assert (3, "umquam", ("w:R",)) in got and (3, "quemquam", ("w:G", "w:O")) in got and (2, " unde negant redire ", ("a:Fruterius",)) in got
    assert render.tei_parallel(tree).first().xml == '<p n="1" xmlns="http://www.tei-c.org/ns/1.0"><app><lem>illuc</lem><rdg>illud</rdg><rdg>illic</rdg></app> unde negant redire <app><rdg>quemquam</rdg><rdg>umquam</rdg></app></p>'


def test_token_extraction(spark):
    base = spark.createDataFrame([("i", LINES, "\n".join(LINES))], "item_id string, lines array<string>, text string")
    df = spark.createDataFrame([("i", "see @{1.2} and @{1.1@3}, @{7.7}."), ("z", "@{1.1}"), ("i", None)], "item_id string, text string")
    assert {tuple(r) for r in texts.extract_tokens(df, base).collect()} == {("i", "see bixit and qu[e], ."), ("z", "@{1.1}"), ("i", None)}


def test_code_names(spark):
    assert value(spark, scalars.iso639(), "a ^^eng, ^^xyz and ^^ita") == "a English, xyz and Italian"
    assert value(spark, scalars.iso639(r"\^\^([a-z]{2})", 2), "^^en") == "English"
    f = scalars.bcp47(custom={"x-foo": "Foo", "EN": "Anglic"})
    assert value(spark, f, "^^de-AT ^^grc ^^zh-TW ^^en ^^ZZ") == "German (Austria) Ancient Greek Chinese (Traditional) Anglic ZZ"
    assert len(codes.iso639(3)) == 184 and value(spark, f, None) is None and value(spark, f, "") == ""


@pytest.mark.parametrize(("text", "want"), [("Hello... world?!", "Hello...\nworld?!\n"), ("No end", "No end\n"), ("It is (see p. 4) here. Yes!", "It is (see p. 4) here.\nYes!\n"), ("", ""), (None, None), ("One.\r\nTwo\u037e three", "One.\nTwo\u037e\nthree\n"), ("A (b. c", "A (b. c\n")])
def test_sentences(spark, text, want):
    assert value(spark, scalars.split_sentences(), text) == want


def test_very_long_sentences(spark):
    assert value(spark, scalars.split_sentences(), "word (x. y) " * 50_000 + "end. next").count("\n") == 2


def test_small_functions(spark):
    v = lambda f, x: value(spark, f, x)
    assert v(scalars.append("!"), "a") == "a!" and v(scalars.append("!"), "") == "" and v(scalars.append("!"), None) is None
    assert v(scalars.source_ids({"seg/x": 3}), "#[seg/x]# #[seg/y]#") == "seg3 seg/y" and v(scalars.source_ids({}, omit=True), "a #[seg/y]#.") == "a ."
    for plural, want in {"cities": "city", "wolves": "wolf", "heroes": "hero", "boxes": "box", "churches": "church", "dishes": "dish", "Children": "child", "items": "item", "glass": None, "s": None, " ": None, "entries": "entry", "data": "datum"}.items():
        assert v(scalars.singular, plural) == want == scalars.singular_text(plural)
    assert v(lambda c: scalars.fill_template("{a}-{b}-{c}", {"a": c, "b": F.lit(None)}), "x") == "x--{c}"
    assert v(lambda c: scalars.file_name(c), 'a/b:c?. ') == "a_b_c_" and v(scalars.strip_quotes, '"q"') == "q"
    assert v(scalars.chain(scalars.append("s"), scalars.replacements([("a", "b", False), (r"(b)(s)", "$2$1", True)])), "a") == "sb"
    f = scalars.add_feature(scalars.add_feature(F.array().cast(scalars.FEATURES), "n", "1"), "n", "1")
    row = spark.range(1).select(F.size(f), F.size(scalars.add_feature(f, "n", "2")), F.size(scalars.add_feature(f, "n", "2", True)), scalars.has_feature(f, "n", "1"), scalars.has_feature(scalars.remove_features(f, "n"), "n"), F.size(scalars.remove_features(f))).first()
    assert tuple(row) == (1, 2, 1, True, False, 0)


MARK = [("plain", "plain"), ("<_md>This **is** MD!</_md> plain", "<p>This <strong>is</strong> MD!</p>\n plain"), ("plain <_md>This **is** MD!</_md>", "plain <p>This <strong>is</strong> MD!</p>\n"), ("<_md>at *start*</_md> and <_md>b</_md>", "<p>at <em>start</em></p>\n and <p>b</p>\n"), ("<_md>This **is** MD! plain", "<p>This <strong>is</strong> MD! plain</p>\n"), ("", ""), (None, None)]


@pytest.mark.parametrize(("text", "want"), MARK)
def test_markdown(spark, text, want):
    assert value(spark, arrow.markdown_filter("<_md>", "</_md>"), text) == want


def test_markdown_blocks():
    assert arrow.markdown("# T\n\n- a\n- `b<`\n\n> q\n\n[l](u) _e_ a_b_c") == '<h1>T</h1>\n<ul>\n<li>a</li>\n<li><code>b&lt;</code></li>\n</ul>\n<blockquote>\n<p>q</p>\n</blockquote>\n<p><a href="u">l</a> <em>e</em> a_b_c</p>\n'
    assert arrow.markdown_regions("<_md>at *start*</_md> and", "<_md>", "</_md>", True) == "at start\n and"


def test_json_to_xml():
    x = arrow.json_to_xml
    assert x("{}") == "<root />" and x("nonsense") is None
    assert x('{"name":"Jo & co","age":30,"ok":true,"n":null}') == "<root><name>Jo &amp; co</name><age>30</age><ok>true</ok><n /></root>"
    assert x('{"items":["a","b"],"people":[{"x":1.50}]}', arrow.XmlOptions(numbered=True)) == '<root><items><item n="1">a</item><item n="2">b</item></items><people><person n="1"><x>1.50</x></person></people></root>'
    o = arrow.XmlOptions("d", {"fr": "f"}, skip=frozenset({"null", "false", "zero"}))
    assert x('{"a":null,"b":false,"c":0,"d":0.0,"e":1,"fr":[0]}', o) == "<d><e>1</e><fr><f>0</f></fr></d>"


def test_json_paths():
    s = lambda p, **o: arrow.select_json('{"root":{"citation":"CIL 1,23","xs":[{"a":1},{"a":2},{"b":[3,[4]]}]}}', p if isinstance(p, tuple) else (p,), **o)
    assert s("root.citation", strip=True) == "CIL 1,23" and s("root.citation") == '"CIL 1,23"'
    assert s("root.xs[*].a") == "[1, 2]" and s("root.xs[-1].b[0]") == "3" and s("root.xs[*].b[]") == "[3, [4]]"
    assert s("root.xs[0].{k: a, c: b}") == '{"k": 1, "c": null}' and s("root | xs | [0].a") == "1" and s("nothing.at.all") == "null"
    assert s(("root", "xs", "[1]")) == '{"a": 2}'
    for bad in ("a.?b", "", "a..b[", "{a}", "a b", "nope(a)", "a[1:2:0]", "a["):
        with pytest.raises(ValueError):
            jsonpath.compile_path(bad)
    assert arrow.template_json('{"t":"a<","xs":[1,2]}', {"root": "<b>{.}</b>", "x": "({.})"}) == "<b>a&lt;(1)(2)</b>"


def entries(spark, d):
    return spark.createDataFrame([(t, i, k, v) for t, kv in d.items() for i, (k, v) in enumerate(kv.items())], "thesaurus_id string, ord int, id string, value string")


def merged(df):
    out = {}
    for r in df.orderBy("thesaurus_id", "ord").collect():
        out.setdefault(r.thesaurus_id, []).append((r.id, r.value))
    return out


def test_vocabulary_merges(spark):
    s, t = entries(spark, {"x": {"b": "B", "c": "C"}, "n": {"z": "Z"}}), entries(spark, {"x": {"a": "a", "b": "b"}, "y": {"q": "q"}})
    rest = {"n": [("z", "Z")], "y": [("q", "q")]}
    assert merged(thesaurus.merged(s, t, "replace")) == {"x": [("b", "B"), ("c", "C")]} | rest
    assert merged(thesaurus.merged(s, t, "patch")) == {"x": [("a", "a"), ("b", "B"), ("c", "C")]} | rest
    assert merged(thesaurus.merged(s, t, "synch")) == {"x": [("b", "B"), ("c", "C")]} | rest
    with pytest.raises(ValueError):
        thesaurus.merged(s, t, "other")


def test_vocabulary_rows_aliases_and_dump(spark):
    rows = spark.createDataFrame([(1, 1, "x@en", "a", "A", None), (1, 2, "", "b", "B", None), (1, 3, None, "c", "C", None), (1, 4, "y@en", None, None, "x@en"), (1, 5, "x@en", "d", "D", None), (1, 6, "e@en", None, None, None)], "file_no int, line_no int, thesaurus_id string, id string, value string, target_id string")
    got = [(r.thesaurus_id, r.target_id, [e.id for e in r.entries]) for r in thesaurus.group_rows(rows).orderBy("first").collect()]
    assert got == [("x@en", None, ["a", "b", "c"]), ("y@en", "x@en", []), ("x@en", None, ["d"])]
    th = spark.createDataFrame([("b@en", [("k", "v")], None), ("model-types@en", [("m", "w")], None), ("a@en", None, "b"), ("b@en", [("k", "v")], None)], "id string, entries array<struct<id:string,value:string>>, targetId string")
    docs = [(r.id, r.json) for r in thesaurus.documents(th).orderBy("n").collect()]
    assert docs == [("model-types@en", '{"id":"model-types@en","entries":[{"id":"m","value":"w"}]}'), ("a@en", '{"id":"a@en","targetId":"b"}'), ("b@en", '{"id":"b@en","entries":[{"id":"k","value":"v"}]}')]
    want = spark.createDataFrame([("a@en", "v"), ("b@en", "v"), ("b@en", "none")], "thesaurus_id string, value string")
    assert {tuple(r) for r in thesaurus.entry_ids(want, thesaurus.entries_of(th), thesaurus.aliases_of(th)).collect()} == {("a@en", "v", "k"), ("b@en", "v", "k"), ("b@en", "none", None)}


@pytest.fixture(scope="module")
def triples(spark):
    t = spark.createDataFrame([(1, 1, 2, 3, None, None, None, "g"), (2, 1, 2, None, 'say "hi"\n', None, "en", None), (3, 1, 4, None, "5", "xsd:int", None, None), (4, 9, 2, 3, None, None, None, None)], "id int, s_id int, p_id int, o_id int, o_lit string, o_lit_type string, o_lit_lang string, tag string")
    return t, spark.createDataFrame([(1, "a:x"), (2, "a:p"), (3, "http://o.org/y"), (4, "b:q")], "id int, uri string")


def test_rdf_lines(triples):
    d = graph.decode(*triples)
    lines = [r.line for r in rdf.turtle(d, PREFIXES).orderBy("id").collect()]
    assert lines == ["a:x a:p <http://o.org/y> .", 'a:x a:p "say \\"hi\\"\\n"@en .', 'a:x b:q "5"^^xsd:int .']
    lines = [r.line for r in rdf.ntriples(d, PREFIXES).orderBy("id").collect()]
    assert lines[0] == "<http://a.org/x> <http://a.org/p> <http://o.org/y> ." and lines[2].endswith('"5"^^<http://www.w3.org/2001/XMLSchema#int> .')
    node = json.loads(rdf.jsonld(d).where("s_id = 1").first().node)
    assert node["@id"] == "a:x" and len(node["a:p"]) == 2 and node["b:q"] == {"@value": "5", "@type": "xsd:int"}
    xml = rdf.xml_subjects(d, PREFIXES).where("s_id = 1").first().xml
    assert xml.startswith('<rdf:Description rdf:about="http://a.org/x"><a:p rdf:resource="http://o.org/y" /><a:p xml:lang="en">say "hi"')
    whole = "".join(r.line for r in rdf.document(d, PREFIXES, "json-ld").orderBy("n").collect())
    assert len(json.loads(whole)["@graph"]) == 1
    from xml.etree import ElementTree

    for form in ("rdf", "owl"):
        assert len(ElementTree.fromstring("".join(r.line for r in rdf.document(d, PREFIXES, form).orderBy("n").collect()))) == 1
    many = d.where("id = 1").withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(150_000))))
    assert [len(json.loads(r.node)["a:p"]) for r in rdf.jsonld(many).collect()] == [150_000] and rdf.xml_subjects(many, PREFIXES).count() == 1
    odd = d.where("id = 2").withColumn("o_lit", F.lit("a\x01b\x1f\t"))
    assert json.loads(rdf.jsonld(odd).first().node)["a:p"]["@value"] == "a\x01b\x1f\t"
    with pytest.raises(Exception, match="no URI for id 9"):
        graph.decode(*triples, strict=True).collect()
    assert graph.contains(d, "a:x", "a:p", "http://o.org/y") and not graph.contains(d, "a:x", "a:p", None, "z")
    assert graph.invalid(*triples).first() == (4, "subject", 9)


def test_closure_with_a_cycle(spark):
    t = spark.createDataFrame([(1, 1, 10, 100), (2, 100, 20, 101), (3, 101, 20, 102), (4, 102, 20, 100), (5, 2, 10, 102)], "id int, s_id int, p_id int, o_id int")
    got = {tuple(r) for r in graph.class_closure(t, 10, 20).collect()}
    assert got == {(1, 100, 1), (1, 101, 2), (1, 102, 3), (2, 102, 1), (2, 100, 2), (2, 101, 3)}


def test_closure_of_a_long_chain(spark):
    chain = [(i, 100 + i, 20, 101 + i) for i in range(67)]
    t = spark.createDataFrame([(999, 1, 10, 100), *chain], "id int, s_id int, p_id int, o_id int")
    assert {tuple(r) for r in graph.class_closure(t, 10, 20).collect()} == {(1, 100 + i, i + 1) for i in range(68)}


def test_scalars_over_all_rows(spark, small):
    names = codes.iso639(2)
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    want = {k: v and re.sub(r"\^\^([a-z]{2})", lambda m: names.get(m[1], m[1]), f"in ^^{v}.") for k, v in langs.items()}
    assert {r[0]: r[1] for r in reference.QUERIES["scalar_iso639"](spark, small).collect()} == want
    entries = thesaurus.entries_of(spark.read.parquet(f"{small}/thesauri.parquet")).select("thesaurus_id", "ord", "id", "value").collect()
    known = {}
    for t, _, i, v in entries:
        known[t, i] = min((x for x in (known.get((t, i)), v) if x is not None), default=None)
    value_of = lambda m: known.get((m[1], m[2])) if known.get((m[1], m[2])) is not None else m[2]
    want = sorted((f"{t}|{o}", re.sub(r"\$([@_a-zA-Z0-9.-]+):([_a-zA-Z0-9.-]+)", value_of, f"see ${t}:{i}; $no@en:none.")) for t, o, i, _ in entries if i is not None and t is not None)
    got = sorted(tuple(r) for r in reference.QUERIES["scalar_thesaurus_references_all"](spark, small).collect() if r[0] is not None)
    assert got == want


def test_flag_metadata(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (9,), (None,)], "flags int")
    got = [r.metadata for r in framing.flag_metadata(df, "flags", {"1": "a=x", "h8": "b=y", "2": "a"}, {"1": "a=off"}).collect()]
    assert got == [{}, {"a": "x"}, {"a": "off"}, {"a": "x", "b": "y"}, {}]


def test_registry(spark):
    conf = registry.Configuration.parse(json.dumps({"TextFilters": [{"Keys": "up", "Id": "a.b.text-filter.str.appender", "Options": {"Text": "!"}}, {"Keys": "off", "Id": "text-filter.str.appender", "Options": {"Text": "?", "IsDisabled": True}}]}))
    assert conf.keys("textFilters") == ["up", "off"] and conf.get("textFilters", "off") is None
    assert len(registry.COMPONENTS) == 31
    with pytest.raises(KeyError):
        registry.create("text-filter.str.nothing")
    for tag in registry.COMPONENTS:
        assert callable(registry.create(tag))


@pytest.mark.parametrize("tag", sorted(registry.COMPONENTS))
def test_unknown_options_are_errors(tag):
    with pytest.raises(TypeError):
        registry.create(tag, {"NoSuchOption": 1})


def test_sentence_options(spark):
    split = lambda text, **o: value(spark, registry.create("text-filter.str.sentence-split", o), text)
    assert split("One. Two (a. b) x! Three") == "One. \nTwo (a. b) x! \nThree\n"
    assert split("One.  Two\r\nx", Trimming=True, CrLfRemoval=True) == "One.\nTwo x\n"
    assert split("One [a. b]. Two", BlackOpeners="[", BlackClosers="]", Trimming=True) == "One [a. b].\nTwo\n"
    assert split("a; b. c", EndMarkers=";", NewLine="|") == "a; |b. c|"


def test_sentences_against_a_plain_scan(spark, small):
    texts_ = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts_)], "i int, x string")
    for trimming in (False, True):
        got = {r.i: r.y for r in df.select("i", scalars.split_sentences(scalars.MARKS, "\n|", trimming=trimming)(F.col("x")).alias("y")).collect()}
        assert got == {i: brute.split_sentences(x, scalars.MARKS, "\n|", trimming) for i, x in enumerate(texts_)}


def test_merge_options(spark):
    f = lambda *vs: [("role", v) for v in vs]
    df = spark.createDataFrame([("i", 1, "a", f("x:1"), ["t"], [1], "k"), ("i", 2, "b", f("x:2"), ["t", "u"], [2], "l"), ("i", 3, "c\n", f("y"), None, None, "m"), ("i", 4, "d", f("y"), ["v"], [3], "n")], "item_id string, n int, text string, features array<struct<name:string,value:string>>, tags array<string>, payloads array<int>, other string")
    merge = lambda **o: [tuple(r)[1:] for r in registry.create("text-tree-filter.merge-linear", o)(df).orderBy("n").collect()]
    assert [r[1] for r in merge()] == ["a", "b", "c\n", "d"]
    got = merge(Features=["role"], ValueFilters=[{"Find": ":.*", "Replace": "", "IsRegex": True}], BreakAtLF=False)
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [("ab", ["t", "u"], [1, 2], "k"), ("c\nd", ["v"], [3], "m")]
    assert [r[1] for r in merge(ValueFilters=[{"Find": ":1", "Replace": ""}, {"Find": ":2", "Replace": ""}])] == ["ab", "c\n", "d"]


def test_token_extractor_options(spark):
    base = spark.createDataFrame([("i", "p", ["dixit que"], "dixit que")], "item_id string, part_id string, lines array<string>, text string")
    df = spark.createDataFrame([("i", "@{1.2@2x1}")], "item_id string, text string")
    cut = lambda **o: registry.create("text-filter.str.mongo-token-extractor", o)(df, base).first().text
    assert cut() == "u" and cut(WholeToken=True) == "q[u]e" and cut(WholeToken=True, StartMarker="<", EndMarker=">", TextTemplate="({text})") == "(q<u>e)"
    assert value(spark, lambda c: scalars.cut_text(c, 10, 4, 4), "alpha beta gamma delta") == "alpha beta..." and value(spark, lambda c: scalars.cut_text(c, 10), "short") == "short"


def test_block_options(spark, apparatus):
    segs, entries = apparatus
    pieces = texts.with_lines(texts.block_lines(segs)).withColumns({"start": F.lit(0), "end": F.lit(0)})
    make = lambda tag, **o: registry.create(tag, o)
    xml = make("text-tree-renderer.tei-off-linear", IsRootIncluded=True, RootElement="tei:body", BlockElements={"default": "l"}, IsIndented=True, NoItemSource=True)(pieces).first().xml
    assert xml.startswith('<body xmlns="http://www.tei-c.org/ns/1.0">\n  <l n="1">') and xml.endswith("</l>\n</body>")
    poem = make("text-tree-renderer.tei-off-linear", BlockElements={"poetry": "tei:l"}, BlockType="poetry", NoNAttribute=True)(pieces).first().xml
    assert poem.startswith('<l source="^') and " n=" not in poem.split(">")[0]
    mixed = render.tei_standoff(pieces, render.Blocks(elements={"default": "tei:p", "poetry": "tei:l"}, block_type=F.lit("poetry"))).first().xml
    assert mixed.startswith("<l ")
    inside = make("text-tree-renderer.tei-app-linear", WitDetailAsChild=True)(pieces, segs, entries).first().xml
    assert ("</witDetail></rdg>" in inside or "</witDetail></lem>" in inside) or "witDetail" not in inside
    with pytest.raises(ValueError):
        make("text-tree-renderer.tei-off-linear", RootElement="q:x")(pieces)
    both = make("text-tree-renderer.composite", Renderers=[{"id": "text-tree-renderer.tei-off-linear"}, {"id": "text-tree-renderer.payload-linear", "options": {"FlattenLines": True}}])(pieces).first().text
    assert both.startswith("<p ") and both.endswith("]") and "[[" not in both


def test_decorated_fragments(spark):
    text = json.dumps({"typeId": "t", "roleId": "fr.x", "n": 1, "fragments": [{"location": "1.1"}, {}]})
    got = json.loads(value(spark, registry.create("json-renderer.xslt", {"FrDecoration": True}), text))
    assert got == {"typeId": "t", "roleId": "fr.x", "n": 1, "fragments": [{"_key": "t:fr.x@0", "location": "1.1"}, {"_key": "t:fr.x@1"}]}
    assert value(spark, registry.create("json-renderer.xslt", {"FrDecoration": True}), '{"a":1}') == '{"a":1}'


def test_render_from_a_configuration(spark, small, tmp_path):
    conf = {
        "TextPartFlatteners": [{"Keys": "flat", "Id": "a.b.text-flattener.token"}],
        "TextTreeFilters": [{"Keys": "lines", "Id": "a.b.text-tree-filter.block-linear"}],
        "TextTreeRenderers": [{"Keys": "tei", "Id": "a.b.text-tree-renderer.tei-off-linear", "Options": {"NoItemSource": True, "GroupHeadTemplate": "<g n='{group}'/>"}}],
        "ItemIdCollectors": [{"Keys": "ids", "Id": "a.b.item-id-collector.mongo", "Options": {"FacetId": "default"}}],
        "ItemComposers": [{"Keys": "default", "Id": "a.b.item-composer.txt.fs", "Options": {"TextPartFlattenerKey": "flat", "TextTreeFilterKeys": ["lines"], "TextTreeRendererKey": "tei", "ItemGrouping": True, "ItemHead": "<!-- {item-title} {item-nr} -->", "OutputDirectory": "x"}}],
    }
    (tmp_path / "c.json").write_text(json.dumps(conf))
    cli.run(spark, ["render", small, f"{tmp_path}/o", "--config", f"{tmp_path}/c.json"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/o").collect()]
    assert any(x.startswith("<g n='") for x in lines) and any("<!-- " in x and "<p n=" in x for x in lines)
    with pytest.raises(KeyError):
        cli.run(spark, ["render", small, f"{tmp_path}/p", "--config", f"{tmp_path}/c.json", "--composer", "none"])


def test_configured_chain(spark):
    conf = registry.Configuration.parse(json.dumps({"TextFilters": [{"keys": "a", "id": "x.y.text-filter.str.iso639"}, {"keys": "b", "id": "x.y.text-filter.str.appender", "options": {"text": "."}}]}))
    assert value(spark, conf.chain(["a", "b"]), "^^lat") == "Latin."


def test_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "a@en", "entries": [{"id": "x", "value": "y"}]}, {"id": "b@en", "targetId": "a"}]))
    assert {r.id for r in readers.json_thesauri(spark, f"{tmp_path}/t.json").collect()} == {"a@en", "b@en"}
    assert readers.json_documents(spark, f"{tmp_path}/t.json").count() == 2
    (tmp_path / "t.csv").write_text('thesaurusId,id,value,targetId\nx@en,a,"two\nlines",\n')
    assert [(r.line_no, r.raw) for r in readers.csv_records(spark, f"{tmp_path}/t.csv").orderBy("line_no").collect()] == [(1, "thesaurusId,id,value,targetId"), (2, 'x@en,a,"two\nlines",')]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>x@en</t></si><si><r><t>al</t></r><r><t>pha</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>head</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>b</t></is></c></row><row r="5"><c r="A5"><v>9</v></c></row></sheetData></worksheet>')
    rows = readers.xlsx_thesaurus_rows(spark, f"{tmp_path}/b.xlsx", row_offset=1)
    assert [tuple(r)[1:] for r in rows.orderBy("line_no").collect()] == [(2, "x@en", "alpha", "7", None), (3, None, "b", None, None)]
    grouped = thesaurus.group_rows(rows).first()
    assert grouped.thesaurus_id == "x@en" and [e.id for e in grouped.entries] == ["alpha", "b"]


def test_records_of_split_files(spark, tmp_path):
    r = random.Random(6)
    field = lambda: r.choice(["a", "", ' "x, y" ', '"two\nlines"', '"q""q"', '"\n\n"', "b c", 'bro"ken', '"shut" x', "é"])
    for f in ("p", "q"):
        records = [",".join(field() for _ in range(r.randint(1, 4))) + r.choice(["", "\r"]) for _ in range(300)]
        (tmp_path / f"{f}.csv").write_bytes(("\n".join(records) + "\n" + '"open\nto the end').encode())
    want = {}
    for f in ("p", "q"):
        record, out = [], []
        for line in (tmp_path / f"{f}.csv").read_bytes().decode().split("\n"):
            record.append(line)
            if brute.quote_is_open("\n".join(record)):
                continue
            out.append("\n".join(record))
            record = []
        out += ["\n".join(record)] if record else []
        want |= {(f, i + 1): x for i, x in enumerate(out)}
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {(x.file.rsplit("/", 1)[1][0], x.line_no): x.raw for x in readers.csv_records(spark, f"{tmp_path}/*.csv").collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_commands(spark, small, tmp_path):
    cli.run(spark, ["dump", small, f"{tmp_path}/d", "--max-per-file", "10", "--no-deleted"])
    docs = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/d", wholetext=True).collect()]
    assert all(len(d["items"]) == 10 for d in docs if d["chunk"] < max(x["chunk"] for x in docs))
    cli.run(spark, ["dump-thesauri", small, f"{tmp_path}/t"])
    cli.run(spark, ["export-rdf", small, f"{tmp_path}/r", "--format", "nt", "--prefixes", json.dumps({"lv": "http://l/"}), "--no-comments"])
    assert spark.read.text(f"{tmp_path}/r").where("value like '% <http://l/%'").count() > 0
    for kind in ("text", "json", "tei-off", "tei-app", "tei-parallel"):
        cli.run(spark, ["render", small, f"{tmp_path}/{kind}", "--as", kind, "--max", "5"])
        assert spark.read.option("wholetext", True).text(f"{tmp_path}/{kind}").count() > 0
    spark.createDataFrame([('{"a":1}',), ("x",)], "value string").coalesce(1).write.text(f"{tmp_path}/j")
    cli.run(spark, ["json-to-xml", f"{tmp_path}/j", f"{tmp_path}/x"])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/x").collect()] == ["<root><a>1</a></root>"]


def test_json_chunks(spark, history, tmp_path):
    sinks.json_chunks(framing.snapshot(history[0], FrameFilter()), f"{tmp_path}/c", 2)
    got = spark.read.text(f"{tmp_path}/c").groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 2), (2, 1)]


def test_streams(spark, history, tmp_path):
    log = history[0].withColumn("arrivedAt", F.col("timeModified"))
    for i, cond in enumerate(("_id < 'h4'", "_id >= 'h4'")):
        log.where(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        target = cdc.BucketedTable(spark, f"file://{tmp_path}/table", buckets=3)
        feeds.maintain(stream, target, f"{tmp_path}/check").awaitTermination()
    assert {r.referenceId for r in target.current().collect()} == {"i1", "i2", "i3", "i5"}
    q = feeds.changes_by_window(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), window="30 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").selectExpr("sum(changes)").first()[0] == 7


def test_numbers_over_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("string"))).alias("k"), (F.col("id") * 7919 % 5003).alias("o"), F.col("id").alias("__from"))
    got = framing.numbered(df.drop("__from"), ["k"], ["o"]).repartition(1).collect()
    want = {}
    for r in sorted(got, key=lambda r: (r.k or "", r.o)):
        want[r.k] = want.get(r.k, 0) + 1
        assert r.nr == want[r.k]
    assert len(got) == 5000 and sorted(r.nr for r in framing.numbered(df.drop("__from"), [], ["o"]).collect()) == list(range(1, 5001))
    assert framing.numbered(df.drop("__from").limit(0), [], ["o"]).count() == 0


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("a", 1), ('"b c"', 2), ("xs[0]", {"n": "p", "v": 3}), ("xs[-1].n", "r"), ("xs[9]", None), ("xs[*].v", [3, 1, 2]), ("xs[1:].n", ["q", "r"]), ("xs[::-1].v", [2, 1, 3]), ("xs[?v > `1`].n", ["p", "r"]), ("xs[?n == 'q'] | [0].v", 1), ("xs[?v >= `2` && n != 'p'].n", ["r"]), ("xs[?!k].n | length(@)", 3),
        ("o.*.z", [7, 8]), ("*.z", []), ("o.* | [0]", {"z": 7}), ("deep[].x[]", [1, 2, 3]), ("deep[*].x", [[1, 2], [3]]), ("deep[*].x | []", [1, 2, 3]), ("deep[*].x[*]", [[1, 2], [3]]), ("[a, xs[0].v]", [1, 3]), ("{p: a, q: o.k.z}", {"p": 1, "q": None}), ("xs[*].{m: n}", [{"m": "p"}, {"m": "q"}, {"m": "r"}]),
        ("missing || a", 1), ("a && o.i.z", 7), ("`[1, 2]`[1]", 2), ("'raw'", "raw"), ("length(xs)", 3), ("join('-', xs[*].n)", "p-q-r"), ("sort_by(xs, &v)[*].n", ["q", "r", "p"]), ("max_by(xs, &v).n", "p"), ("sum(xs[*].v)", 6), ("keys(o)", ["i", "j"]), ("contains(xs[*].n, 'q')", True), ("not_null(missing, a)", 1), ("map(&v, xs)", [3, 1, 2]),
        ("type(xs)", "array"), ("to_string(a)", "1"), ("to_number('12')", 12), ("abs(missing)", None), ("(a)", 1), ("@.a", 1), ("reverse(xs)[0].n", "r"), ("xs[].v", [3, 1, 2]), ("a.b.c", None), ("a == `1`", True), ("a == `true`", False), ("xs[*].v | sort(@)", [1, 2, 3]),
    ],
)
def test_jmespath(path, want):
    v = {"a": 1, "b c": 2, "xs": [{"n": "p", "v": 3}, {"n": "q", "v": 1}, {"n": "r", "v": 2}], "o": {"i": {"z": 7}, "j": {"z": 8}}, "deep": [{"x": [1, 2]}, {"x": [3]}]}
    assert jsonpath.compile_path(path)(v) == want
