"""The operators of the general problems against plain versions, and their defined results for odd input."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.times import micros
from strataframe.operators import cdc, csvload, eav, history, intake, nested, orphans
from strataframe.plans import problems
from tests import brute

T = datetime.datetime


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_p1_against_brute_force(spark, small):
    docs = [r[0] for r in spark.read.parquet(f"{small}/item_dump.parquet").select("doc").collect()]
    thesauri = spark.read.parquet(f"{small}/thesauri.parquet").select("id", "entries").collect()
    got = problems.p1_found(spark, small).collect()
    assert rows(problems.p1_found(spark, small)) == brute.children(docs, thesauri) and len(got) == len(set(got))
    tables = problems.p1_tables(spark, small)
    assert tables.where("tab = 'fragment'").select("parent_key", "ord").distinct().count() == len({x[1:3] for x in brute.children(docs, []) if x[0] == "fragment"})


def shredded(spark, docs, o):
    found = nested.nodes(spark.createDataFrame([(d, 1) for d in docs], "doc string, tab int"), "doc", o)
    graph = nested.schema_graph(found, o)
    return found, graph, nested.shred(found, graph.tables())


def test_shared_inlining_of_recursive_shared_and_inlined_elements(spark):
    doc = {"_id": "a", "place": {"name": "x", "geo": {"lat": {"$numberInt": "1"}}}, "kids": [{"v": 1, "kids": [{"v": 2}]}, None, {"v": 3}], "note": {"by": {"who": "p"}}, "by": {"who": "q"}}
    o = nested.Options(root="r", keys={"r": "_id"}, elements={("r", "by"): "by", ("r.note", "by"): "by"})
    found, graph, out = shredded(spark, [json.dumps(doc), None, "", "nonsense", "[]", "3", '{"_id": null}'], o)
    assert graph.tables() == {"r", "r.kids", "by"}  # kids repeats and holds itself, by is shared; place, geo and note are inlined
    got = {(r.tab, r.parent_key, r.ord, r.row_key) for r in out.collect()}
    assert {("r.kids", "a", 0, "a/kids/0"), ("r.kids", "a", 2, "a/kids/2"), ("r.kids", "a/kids/0", 0, "a/kids/0/kids/0")} <= got
    table = nested.table_of(out, graph, nested.columns_of(found), "r")
    assert table.where("row_key = 'a'").select("place_name", "place_geo_lat").first() == ("x", "1")
    assert rows(out.where("tab = 'by'").select("parent_key", F.col("cols")["who"])) == {("a", "p"), ("a", "q")}
    assert shredded(spark, ['{"_id": "\\ud800x", "v": "\\udc00"}'], o)[2].first().row_key == "?x"
    assert {r.problem[:7] for r in nested.rejected(found).collect()} == {"no JSON", "a recor"}


def test_members_of_one_name_are_elements_of_their_own(spark):
    doc = {"_id": "a", "meta": {"entries": [{"value": "m"}]}, "_parts": [{"_id": "p", "entries": [{"value": "q"}], "fragments": {"location": "1", "entries": [{"value": "r"}, None]}}]}
    found, graph, out = shredded(spark, [json.dumps(doc)], problems.ITEMS)
    assert {"item.meta.entries", "part.entries"} < graph.tables() and "item.meta" not in graph.tables()
    got = rows(nested.links(found, graph.tables()).where("tab <> 'item'").select("tab", "parent_tab", "parent_key", "ord", "row_key"))
    assert got == {("item.meta.entries", "item", "a", 0, "a/meta/0/entries/0"), ("part", "item", "a", 0, "p"), ("part.entries", "part", "p", 0, "p/entries/0"), ("fragment", "part", "p", 0, "1"), ("reading", "fragment", "p/0", 0, "r")}


ODD = [[], [{"fragments": [{"location": "9"}]}], "[1]", '[{"x": {"y": 1}}]', None, "text", {"content": {"fragments": [{"location": "8"}]}}]


@pytest.mark.parametrize("odd", [{"_parts": [{"_id": "q", "content": c}]} for c in ODD] + [{"content": {"a": 1}}, {"meta": {"content": [{"b": 1}]}, "content": {"a": 1}}])
def test_p1_one_odd_record_changes_no_other(spark, tmp_path, odd):
    part = lambda k, c: {"_id": k, "content": c}
    frs = lambda loc: {"note": "n", "fragments": [{"location": loc, "entries": [{"value": "v", "witnesses": [{"value": "w"}]}]}]}
    doc = json.dumps({"_id": "a", "_parts": [part("p", frs("1")), part("r", json.dumps(frs("2")))]})
    spark.createDataFrame([(1, doc), (2, json.dumps({"_id": "b", **odd}))], "dump_id long, doc string").write.parquet(f"{tmp_path}/item_dump.parquet")
    spark.createDataFrame([], "id string, entries array<struct<id string, value string>>").write.parquet(f"{tmp_path}/thesauri.parquet")
    want = {("part", "a", 0, "p"), ("part", "a", 1, "r")} | {x for k, loc in (("p", "1"), ("r", "2")) for x in (("fragment", k, 0, loc), ("reading", f"{k}/0", 0, "v"), ("witness", f"{k}/0/0", 0, "w"))}
    assert rows(problems.p1_found(spark, str(tmp_path))) == want | ({("part", "b", 0, "q")} if "_parts" in odd else set())
    assert rows(problems.p1_part_table(spark, str(tmp_path)).where("parent_key = 'a'").select("row_key", "content_note")) == {("p", "n"), ("r", "n")}


def test_arrays_of_an_inlined_member_stay_as_text(spark):
    docs = [json.dumps({"_id": "a", "_parts": [{"_id": "p", "content": [{"x": {"y": 1}}]}, {"_id": "q", "content": []}]})]
    found, graph, out = shredded(spark, docs, problems.ITEMS)
    assert rows(nested.table_of(out, graph, nested.columns_of(found), "part").select("row_key", "content")) == {("p", '[{"x": {"y": 1}}]'), ("q", "[]")}


def test_spellings_of_one_value_agree():
    o = problems.ITEMS
    same = ["2023-10-02T02:05:09.178Z", {"$date": "2023-10-02T02:05:09.178Z"}, {"$date": {"$numberLong": "1696212309178"}}, {"$date": 1696212309178}]
    assert {nested._plain(v, o) for v in same} == {same[0]}
    assert nested._plain({"$numberInt": "7"}, o) == "7" and nested._plain({"$date": "x"}, o) == "x" and nested._plain({"$date": 10**40}, o) == 10**40
    assert nested._plain({"$date": {"$numberLong": "-1"}}, o) == "1969-12-31T23:59:59.999Z"


def test_nested_empty_table(spark):
    found, graph, out = shredded(spark, [], problems.ITEMS)
    assert graph.edges == () and out.count() == 0 and nested.links(found, graph.tables()).count() == 0


def test_nested_very_deep_and_long(spark):
    deep = lambda n: '{"kids":' * n + "{}" + "}" * n
    o = nested.Options(root="r", keys={"r": "_id"})
    found, _, out = shredded(spark, [deep(60), deep(200_000), json.dumps({"_id": "b", "t": "x" * 2_000_000})], o)
    assert out.where("tab = 'r.kids'").count() == 60
    assert rows(nested.rejected(found)) == {("nested too deeply", 1)}


def refs(spark, data):
    return spark.createDataFrame(data, orphans.REFERENCES).selectExpr("*", "1 as present", "2 as late", "3 as __bucket")


def parents(spark, data):
    return spark.createDataFrame(data, orphans.PARENTS).selectExpr("*", "1 as put", "2 as removed")


def test_orphans_wait_resolve_and_reopen(spark):
    t = orphans.OrphanTracker(spark, storage.workspace(spark, "o"))
    t.apply(refs(spark, [("f", "k1", "r1", "p", 5), ("f", "k2", "r2", "p", 5), ("f", "", "r3", "p", 1), ("f", None, "r4", "p", 1), ("f", "k1", "r1", "p", 5)]), parents(spark, [("f", "k1", "present", 4)]))
    assert rows(t.report()) == {("f", "k2", "r2", "p", "missing")}
    t.apply(refs(spark, []), parents(spark, [("f", "k2", "present", 9)]))  # arrives later than its reference
    assert rows(t.report()) == {("f", "k2", "r2", "p", "late")}
    t = orphans.OrphanTracker(spark, t.path)  # another session goes on
    counts = t.apply(refs(spark, []), parents(spark, [("f", "k1", "remove", 10)]))
    assert rows(t.report()) == {("f", "k2", "r2", "p", "late"), ("f", "k1", "r1", "p", "deleted")}
    assert rows(counts.select("reason", "n")) == {("late", 1), ("deleted", 1)}
    t.apply(refs(spark, []), parents(spark, [("f", "k1", "present", 11)]))
    t.apply(refs(spark, []), parents(spark, [("f", "k1", "remove", 12)]))
    assert t.report().where("row_key = 'r1'").count() == 1
    t.apply(refs(spark, [("g", "k1", "r9", "", None)]), parents(spark, [("g", "k1", "tombstone", None)]))
    assert rows(t.report().where("field = 'g'")) == {("g", "k1", "r9", "", "deleted")}


def test_orphans_whose_parent_has_its_first_arrival_later(spark):
    t = orphans.OrphanTracker(spark, storage.workspace(spark, "o"))
    refs = lambda *x: spark.createDataFrame(list(x), orphans.REFERENCES)
    ups = lambda *x: spark.createDataFrame(list(x), orphans.PARENTS)
    t.apply(refs(("f", "a", "1", "", 5), ("f", "a", "2", "", 20), ("f", "b", "3", "", 5)), ups(("f", "a", "present", None), ("f", "b", "present", None)))
    assert t.report().count() == 0
    t.apply(refs(), ups(("f", "a", "seen", 10), ("f", "c", "seen", 10)))
    assert [(r.row_key, r.reason) for r in t.report().collect()] == [("1", "late")]
    t.apply(refs(), ups(("f", "a", "remove", 30)))
    assert sorted((r.row_key, r.reason) for r in t.report().collect()) == [("1", "deleted"), ("2", "deleted")]
    t.apply(refs(), ups(("f", "a", "present", 40)))
    assert [(r.row_key, r.reason) for r in t.report().collect()] == [("1", "late")]


def test_orphan_state_stays_bounded_and_touches_few_buckets(spark):
    t = orphans.OrphanTracker(spark, storage.workspace(spark, "o"), buckets=64, pieces=3)
    refs = lambda *x: spark.createDataFrame(list(x), orphans.REFERENCES)
    ups = lambda *x: spark.createDataFrame(list(x), orphans.PARENTS)
    t.apply(refs(*[("f", f"k{i}", f"r{i}", "p", 100) for i in range(40)]), ups())
    kept = {b: list(p) for b, p in t._logs["waiting"].items()}
    t.apply(refs(), ups(("f", "k7", "present", 4)))
    assert sum(t._logs["waiting"][b] != kept[b] for b in kept) == 1  # one key, one bucket
    assert t.report().count() == 39 and rows(t.counts()) == {("f", "p", "missing", 39)}
    state = {f"k{i}": i != 7 for i in range(40)}
    r = random.Random(1)
    for step in range(10):
        k, there = f"k{r.randint(0, 3)}", r.random() < 0.5
        got = t.apply(refs(("f", "k7", "r7", "p", 100), ("f", "k7", f"s{step}", "q", 5)), ups(("f", k, "present" if there else "remove", 10 + step)))
        state[k] = not there
        assert {(x.period, x.reason): x.n for x in got.collect()} == {(x.period, x.reason): x["count"] for x in t.report().groupBy("period", "reason").count().collect()}
    assert {x.key for x in t.report().collect()} == {k for k, orphan in state.items() if orphan}
    assert max(len(p) for log in t._logs.values() for p in log.values()) <= 3
    assert len(storage.manifests(spark, f"{t.path}/manifests")) == 1
    live = {p for log in t._logs.values() for ps in log.values() for p in ps}
    assert {x for x in storage.list_names(spark, t.path) if x.startswith("step-")} == {next(y for y in p.split("/") if y.startswith("step-")) for p in live} | {f"step-{t.step}"}
    again = orphans.OrphanTracker(spark, t.path)
    assert again.step == t.step and rows(again.report()) == rows(t.report())


def test_orphans_by_slices_as_at_once(spark, small):
    want = rows(problems.p2_found(spark, small))
    kept, problems._SLICES = problems._SLICES, 1
    try:
        assert rows(problems.p2_found(spark, small)) == want
    finally:
        problems._SLICES = kept


def test_p3_against_brute_force(spark, small):
    raw = spark.read.parquet(f"{small}/thesaurus_csv.parquet").collect()
    got = problems.p3_found(spark, small).collect()
    assert rows(problems.p3_found(spark, small)) == brute.csv_failures([tuple(r) for r in raw]) and len(got) == len(set(got))


def test_tokenizer_is_the_same_for_all_chunk_sizes():
    r = random.Random(4)
    records = ["".join(r.choice('a",  é\n\r') for _ in range(r.randint(0, 40))) for _ in range(800)] + [None, "", "x" * 5000, '"' + "a,b" * 2000 + '"']
    want = [brute.csv_record(x) if x is not None and x.strip(" \r\n\t") else None for x in records]
    for chunk in (1, 3, 64, 4096):
        got = csvload.tokenize(records, chunk=chunk)
        assert [g[0] for g in got] == want
        assert all((g[1] is None) == (g[0] is not None or x is None or not x.strip(" \r\n\t")) for g, x in zip(got, records, strict=True))
    assert csvload.tokenize(['ab"c'])[0][1:] == ("quote in an unquoted field", 2)


def test_bad_rows_edge_cases(spark):
    data = [(1, 1, "﻿ThesaurusId,ID,value,targetId\r"), (1, 2, ",a,b,"), (1, 3, "t@en,a,b,"), (1, 3, "t@en,a,b,"), (1, 4, ",c,�,"), (1, 5, ""), (1, 6, None), (1, 7, ",d,e"), (2, 1, '"broken'), (2, 2, "t@en,a,b,"), (3, 5, "t@en,a,b,"), (1, 8, ' "x"" y" , c , d ,'), (1, 9, ",c,d,"), (1, 10, "T@en,,,u")]
    df = spark.createDataFrame(data, "file_no int, line_no int, raw string").selectExpr("*", "1 as fields", "2 as error", "3 as names")
    got = {(r.file_no, r.line_no): r.reason for r in csvload.read_thesaurus_records(df).collect()}
    assert got == {(1, 2): "value", (1, 3): None, (1, 4): "value", (1, 7): "columns", (2, 2): "columns", (3, 5): "columns", (1, 8): "value", (1, 9): None, (1, 10): None}
    assert csvload.read_thesaurus_records(df.limit(0)).count() == 0


def test_fill_down_over_blocks(spark):
    df = spark.createDataFrame([(g, i, str(i) if i % 7 == g else None) for g in (0, 1) for i in range(60)] + [(None, 1, "n"), (None, 2, None)], "g int, i int, v string")
    got = {(r.g, r.i): r.o for r in csvload.fill_down(df, "g", "i", "v", "o", block=5).collect()}
    for g in (0, 1):
        last = None
        for i in range(60):
            last = str(i) if i % 7 == g else last
            assert got[(g, i)] == last
    assert got[(None, 2)] == "n"


def test_typed_to_the_bounds_of_the_types(spark):
    cases = [("integer", 2**63 - 1), ("integer", -(2**63)), ("integer", 10**18), ("decimal", "9" * 34 + ".9999"), ("decimal", "-" + "9" * 34 + ".9999"), ("integer", 2**63), ("integer", -(2**63) - 1), ("integer", "9" * 5000), ("decimal", "1" + "0" * 34)]
    triples = spark.createDataFrame([(i, 1, i, str(x), None) for i, (_, x) in enumerate(cases)], "id int, s_id int, p_id int, o_lit string, o_lit_type string")
    kinds = spark.createDataFrame([(i, f"xsd:{k}") for i, (k, _) in enumerate(cases)], "id int, data_type string")
    got = [str(x) for x in eav.widen(triples, kinds).rows().first()[1:]]
    assert got == [*(str(x) for _, x in cases[:5]), "None", "None", "None", "None"]
    assert {r.p_id for r in eav.widen(triples, kinds).misfits().collect()} == {5, 6, 7, 8}


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("integer", {"+07": "7", " -0\t": "0", "-12": "-12", "9" * 40: "9" * 40}, ["1.0", "", "1 2", "x", "+-1", "１"]),
        ("decimal", {".5": "0.5000", "-.50": "-0.5000", "3.": "3.0000", "00.00004": "0.0000", "2.00005": "2.0001"}, ["1e3", ".", "", "1,5", "INF"]),
        ("boolean", {"1": "true", " false\n": "false"}, ["TRUE", "yes", ""]),
        ("date", {"2024-02-29": "2024-02-29", "2000-02-29Z": "2000-02-29", "1999-12-31+14:00": "1999-12-31", "-0044-03-15": "-0044-03-15"}, ["2023-02-29", "1900-02-29", "2024-13-01", "2024-1-1", "2024-01-01T00:00:00", "02024-01-01", "2024-04-31", "2024-01-01+15:00"]),
    ],
)
def test_forms(spark, kind, good, bad):
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r.x: r.ok for r in df.select("x", eav.valid(F.col("x"), F.lit(kind)).alias("ok")).collect()}
    assert got == {x: True for x in good} | dict.fromkeys(bad, False)
    assert {x: eav.canonical(x, kind) for x in good} == good


def test_wide_table(spark):
    t = spark.createDataFrame([(2, 1, 7, "5", None, "z"), (1, 1, 7, "x", None, "z"), (3, 1, 7, "6", None, "z"), (3, 1, 7, "6", None, "z"), (4, 2, 8, "yes", "xs:boolean", "z"), (5, 2, 8, " 1 ", "xsd:boolean", "z"), (None, 3, 9, "b", None, "z"), (9, 3, 9, "a", None, "z"), (6, None, 7, "1", None, "z"), (7, 4, None, "1", None, "z"), (8, 4, 7, None, None, "z"), (10, 5, 10, "", None, "z")], "id int, s_id int, p_id int, o_lit string, o_lit_type string, typ string")
    p = spark.createDataFrame([(7, "xsd:int", "q"), (9, None, "q"), (None, "x", "q")], "id int, data_type string, slot string")
    w = eav.widen(t, p)
    assert rows(w.cells()) == {(1, 7, "integer", "5"), (2, 8, "boolean", "true"), (3, 9, "string", "a"), (5, 10, "string", "")}
    assert w.rows().where("s_id = 1").select("p7", "p8", "p9").first() == (5, None, None)
    assert eav.widen(t.limit(0), p).cells().count() == 0
    assert rows(eav.widen(t, p, max_columns=1).cells()) == rows(w.cells())
    with pytest.raises(ValueError):
        eav.widen(t, p, max_columns=1).rows()


LOG = "_id string, referenceId string, timeModified timestamp_ntz, status int, title string, arrivedAt timestamp_ntz, p string, k string"


def log(spark, data):
    return spark.createDataFrame([(i, r, t, s, x, a, "p", "k") for i, r, t, s, x, a in data], LOG)


def periods(data):
    out = set()
    for ref in {d[1] for d in data if d[1] is not None}:
        last = {}
        for d in sorted((d for d in data if d[1] == ref and d[2] is not None), key=lambda d: (d[2], d[0] or "")):
            last[d[2]] = d
        start = state = None
        for t, d in sorted(last.items()):
            now = None if d[3] == 2 else ("v", d[4])
            if now != state:
                if state is not None:
                    out.add((ref, start, t, state[1]))
                start, state = t, now
        if state is not None:
            out.add((ref, start, None, state[1]))
    return out


def test_history_against_brute_force(spark):
    r = random.Random(3)
    base = T(2024, 1, 1)
    data = [(f"v{r.randint(0, 999)}", r.choice(["a", "b", "c", None, "hot", "hot", "hot"]), base + datetime.timedelta(hours=r.randint(0, 300)) if r.random() > 0.02 else None, r.choice([0, 1, 1, 2, None]), r.choice([None, "x", "y"]), base) for _ in range(500)]
    data += data[:40]
    by_id = {d[0]: d for d in data}
    data = [by_id[d[0]] for d in data]  # an _id names one version
    want = periods(data)
    for hot in (10**6, 150, 20):
        got = history.validity(log(spark, data), attributes=("title",), hot=hot).collect()
        micros = lambda t: None if t is None else int((t - T(1970, 1, 1)).total_seconds()) * 10**6
        assert {(g[0], g[1], g[2], g[4]) for g in got} == {(a, micros(b), micros(c), d) for a, b, c, d in want} and len(got) == len(want)
    assert history.validity(log(spark, []), attributes=("title",)).count() == 0


def test_times_in_any_session_zone(spark):
    data = [("1960-03-01 00:00:00.000001",), ("2024-03-31 02:30:00",), ("2024-10-27 02:30:00.5",), (None,), ("x",)]
    df = spark.createDataFrame(data, "s string").withColumn("n", F.col("s").try_cast("timestamp_ntz"))
    want = [-310435199999999, 1711852200000000, 1729996200500000, None, None]
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Rome", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in df.select(micros(df, "n"), micros(df, "s")).collect()] == [(w, w) for w in want]
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("b", 2, None), ("c", 3, "z"), ("d", 4, "w")], "k string, v int, change string")
    b = spark.createDataFrame([(None, 1, "q"), ("b", None, None), ("d", 4, "w"), ("e", 5, "w")], "k string, v int, change string")
    assert rows(history.snapshot_diff(a, b, ["k"], ["v"])) == {("b", "changed", None), ("c", "deleted", None), ("e", "inserted", 5)}


def test_feeds_in_any_order_and_again(spark):
    r = random.Random(5)
    data = []
    for i in range(300):
        data.append((f"v{i:03}", r.choice(["a", "b", "c", "d", None, *["hot"] * 4]), T(2024, 1, r.randint(1, 20)) if r.random() > 0.05 else None, r.choice([0, 1, 1, 2]), f"t{i}", T(2024, 2, r.randint(1, 9))))
    want = {}
    for d in sorted((d for d in data if d[1] is not None), key=lambda d: (d[2] or T(1, 1, 1), d[0])):
        want[d[1]] = d
    want = {(k, d[0]) for k, d in want.items() if d[3] != 2}
    r.shuffle(data)
    table = cdc.BucketedTable(spark, storage.workspace(spark, "t"), buckets=5)
    assert table.current() is None
    for i in range(4):
        table.apply(log(spark, data[i * 75 : (i + 1) * 75]), f"f{i}")
    before = table.manifest()
    assert table.apply(log(spark, data[:75]), "f0") == before  # again: nothing happens
    table.apply(log(spark, [d for d in data if d[1] == "a"]), "again a")
    after = table.manifest()
    assert sum(after["files"][b] != before["files"][b] for b in before["files"]) == 1  # only one bucket is rewritten
    table.apply(log(spark, data[:9]), "s", 0)
    assert table.apply(log(spark, data), "s", 0)["version"] == table.manifest()["version"] == after["version"] + 1
    table.vacuum()
    assert len(storage.manifests(spark, f"{table.path}/manifests")) == 1
    assert rows(table.current().select("referenceId", "_id")) == want
    assert set(table.current().columns) == set(LOG.replace(" string", "").replace(" timestamp_ntz", "").replace(" int", "").split(", "))
    assert cdc.replay(spark, log(spark, data), storage.workspace(spark, "t"), feeds=3).current().select("referenceId", "_id").distinct().count() == len(want)
    assert cdc.replay(spark, log(spark, []), storage.workspace(spark, "t")).current().count() == 0


def test_a_feed_of_one_key_reads_and_writes_one_bucket(spark):
    data = [(f"v{i:03}", f"k{i % 50}", T(2024, 1, 1 + i % 20), 1, f"t{i}", T(2024, 2, 1)) for i in range(200)]
    table = cdc.BucketedTable(spark, storage.workspace(spark, "t"), buckets=16)
    before = table.apply(log(spark, data), "a")["files"]
    assert all(len(p) == 1 for p in before.values())
    after = table.apply(log(spark, [("w", "k7", T(2024, 3, 1), 1, "new", T(2024, 3, 1))]), "b")["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.current().where("referenceId = 'k7'").first().title == "new" and table.current().count() == 50
    base = cdc.bucketed(spark, [p for ps in after.values() for p in ps], table.current().schema, "referenceId", 16)
    plan = table._merged(base, cdc.last_change(log(spark, data), "referenceId", ["timeModified", "_id"]))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FullOuter") :].split("FileScan")[0]
    assert "Bucketed: true" in plan and "Exchange" not in scan  # the base isn't shuffled
    for i in range(12):
        table.apply(log(spark, [(f"x{i}", f"k{i}", T(2024, 4, 1), 1, "n", T(2024, 4, 1))]), "s", i)
        table.vacuum()
    files = [n for v in storage.list_names(spark, f"{table.path}/data") for n in storage.list_names(spark, f"{table.path}/data/{v}") if n.endswith(".parquet")]
    assert len(files) == len(before) and table.current().count() == 50


def test_intervals():
    r = random.Random(2)
    for _ in range(300):
        parts = [(None if r.random() < 0.1 else (a := r.randint(0, 30)), r.randint(0, 40)) for _ in range(r.randint(0, 6))]
        parts = [(a, b) for a, b in parts if a is None or a < b]
        done = intake.merge(parts)
        inside = lambda n, xs: any((a is None or n > a) and n <= b for a, b in xs)
        assert all(inside(n, done) == inside(n, parts) for n in range(-5, 50))
        assert all(a[1] < b[0] for a, b in zip(done, done[1:]))
        gap = intake.subtract((None, 25), done)
        assert all(inside(n, gap) == (n <= 25 and not inside(n, done)) for n in range(-5, 50))


def test_runs_take_every_record_once(spark):
    ledger = intake.Ledger(spark, storage.workspace(spark, "l"))
    base = T(1970, 1, 1)
    df = spark.createDataFrame([(i, base + datetime.timedelta(seconds=i)) for i in range(10)] + [(99, None)], "id int, at timestamp_ntz")
    out = storage.workspace(spark, "out")
    got = lambda n: sorted(r.id for r in spark.read.parquet(f"{out}/{n}").collect())
    intake.take(spark, ledger, df.where("id < 4 and id <> 2"), "at", 5 * 10**6, f"{out}/1")
    df.write.parquet(f"{out}/failed")  # a run that failed before its commit isn't seen
    assert got(1) == [0, 1, 3]
    intake.take(spark, ledger, df.where("id < 8"), "at", 6 * 10**6, f"{out}/2")  # 2 shows up late, with an arrival before what is done
    assert got(2) == [2, 4, 5, 6]
    intake.take(spark, ledger, df, "at", 9 * 10**6, f"{out}/3", complete=8 * 10**6)
    assert got(3) == [7, 8, 9] and ledger.complete() == 8 * 10**6
    assert rows(ledger.open().select("lo", "hi")) == {(9 * 10**6 - 1, 9 * 10**6)}
    intake.take(spark, ledger, df, "at", 9 * 10**6, f"{out}/4")
    assert got(4) == [] and sorted(r.id for r in spark.read.parquet(*ledger.outputs()).select("id").collect()) == list(range(10))
    with pytest.raises(FileExistsError):
        ledger.commit(spark.createDataFrame([(1,)], "n long"), after=0)


def test_open_intervals_against_sets(spark):
    r = random.Random(8)
    day = intake.DAY
    ledger = intake.Ledger(spark, storage.workspace(spark, "l"))
    want = set()
    for _ in range(3):
        seen = {r.choice([0, day, -day]) + r.randint(-6, 6) for _ in range(12)} - want
        want |= seen
        ledger.commit(spark.createDataFrame([(n,) for n in seen], "n long"))
    got = [n for _, lo, hi in ledger.open().collect() for n in range(lo + 1, hi + 1)]
    assert sorted(got) == sorted(want)
    probe = spark.createDataFrame([(n,) for n in range(-9, 10)], "n long")
    assert rows(ledger.pending(probe, F.col("n")).select("n")) == {(n,) for n in range(-9, 10) if n not in want}


def test_manifests_are_ordered_as_numbers(spark):
    path = storage.workspace(spark, "m")
    for n in (99_999, 100_000, 100_001):
        storage.commit_json(spark, storage.manifest_path(path, n), {"n": n})
    assert storage.newest(spark, path) == (100_001, {"n": 100_001})
    with pytest.raises(FileExistsError):
        storage.commit_json(spark, storage.manifest_path(path, 99_999), {})


def test_runs_in_odd_order(spark):
    day = datetime.timedelta(days=1)
    runs = spark.createDataFrame([(2, "c", T(2024, 1, 5), "ok", 0), (1, "c", T(2024, 1, 9), "failed", 0), (3, "c", T(2024, 1, 3), "ok", 0), (4, "c", T(2024, 1, 7), "ok", 0), (4, "c", T(2024, 1, 7), "ok", 0), (5, "c", None, "ok", 0), (6, None, T(2025, 1, 1), "ok", 0)], "run_id int, coll string, readUpTo timestamp_ntz, outcome string, __lo int")
    taken = intake.assign_intervals(runs)
    assert [r.run_id for r in taken.orderBy("run_id").collect()] == [2, 4]
    recs = spark.createDataFrame([("c", "a", T(2023, 1, 1)), ("c", "b", T(2024, 1, 5)), ("c", "d", T(2024, 1, 5) + day / 2), ("c", "e", T(2024, 1, 8)), ("x", "f", T(2024, 1, 1)), ("c", "g", None)], "coll string, rec_id string, arrivedAt timestamp_ntz")
    assert rows(intake.locate(spark, recs, "arrivedAt", taken).select("rec_id", "run_id")) == {("a", 2), ("b", 2), ("d", 4)}
    assert intake.locate(spark, recs, "arrivedAt", intake.assign_intervals(runs.limit(0))).count() == 0
