"""Readers: every source as a DataFrame, its rows told apart by file and place where the format has an order."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe import storage
from strataframe.functions.predicates import FrameFilter


def load(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """A table by path and format: parquet, json, csv, orc, text or jdbc (path is then the table)."""
    if form == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    if form == "json":
        options.setdefault("multiLine", True)  # an array of objects or one object a file
    if form == "csv":
        options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True} | options
    return spark.read.format(form).options(**options).load(path)


def item_ids(items: DataFrame, f: FrameFilter) -> DataFrame:
    """The ids of items that pass a filter's attributes and times; no pages, as nothing is fetched by page."""
    return items.where(f.attributes() & f.until(True) & F.col("_id").isNotNull()).select("_id").distinct()


_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?: *+"{_INSIDE}" *+|[^",]*+),)*+'
#: a line after which a quoted field is still open, if none was open before it, and if one was
OPENS = rf'(?s)\A{_FIELDS} *+"{_INSIDE}\z'
STAYS = rf'(?s)\A(?:{_INSIDE}|{_INSIDE}" *+,{_FIELDS} *+"{_INSIDE})\z'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, line_no, raw): the records of CSV files, which may hold line breaks within quotes.

    Files are split as Spark splits text. A line maps the state before it, within quotes or not, to that after it: it keeps
    it, turns it or sets it. A run of lines does the same, so each split gives one such map, and a window over the splits of
    a file tells each in which state it begins. A line with broken quoting ends its record, as in tokenize(). line_no
    counts records; a final CR stays. No task holds more of a file than a split, but for a record that is longer.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("id", F.monotonically_increasing_id())
    opens, stays = F.col("value").rlike(OPENS), F.col("value").rlike(STAYS)
    mapped = lines.withColumn("set", F.when(opens == stays, opens.cast("int"))).withColumn("turns", (opens & ~stays).cast("int"))
    mapped = storage.materialize(mapped, storage.workspace(spark, "lines"))
    in_block = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    told = mapped.withColumn("t", F.sum("turns").over(in_block))
    told = told.withColumn("last", F.last(F.when(F.col("set").isNotNull(), F.struct(F.col("set").alias("v"), F.col("t").alias("t"))), True).over(in_block))
    # of each split, whether its end is set to a state or how often that at its beginning turns
    ends = told.groupBy("file", "block").agg(F.max_by("last", "id").alias("last"), F.max("t").alias("t"))
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col("last").isNotNull(), F.pmod(F.col("last.v") + F.col("t") - F.col("last.t"), F.lit(2)))
    blocks = ends.withColumn("v", value).withColumn("turn", F.when(F.col("v").isNull(), F.col("t")).otherwise(0)).withColumn("turned", F.coalesce(F.sum("turn").over(of_file), F.lit(0)))
    known = F.last(F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("v"), (F.col("turned") + F.col("turn")).alias("t"))), True).over(of_file)
    starts = blocks.withColumn("known", known).select(F.col("file").alias("f"), F.col("block").alias("b"), F.pmod(F.coalesce(F.col("known.v"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("known.t"), F.lit(0)), F.lit(2)).alias("begin"))
    after = F.when(F.col("last").isNotNull(), F.pmod(F.col("last.v") + F.col("t") - F.col("last.t"), F.lit(2))).otherwise(F.pmod(F.col("begin") + F.col("t"), F.lit(2)))
    placed = told.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("after", after)
    w = Window.partitionBy("file", "block").orderBy("id")
    fresh = placed.withColumn("new", (F.coalesce(F.lag("after").over(w), F.col("begin")) == 0).cast("int")).withColumn("r", F.sum("new").over(in_block))
    counts = fresh.groupBy("file", "block").agg(F.max("r").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(of_file), F.lit(0))).select(F.col("file").alias("f"), F.col("block").alias("b"), "before")
    numbered = fresh.drop("f", "b").join(counts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("line_no", (F.col("r") + F.col("before")).cast("int"))
    records = numbered.groupBy("file", "line_no").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("ls"))
    return records.select("file", F.xxhash64("file").alias("file_no"), "line_no", F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("raw"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet_rows(content: bytes, sheet: int) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
        if sheet >= len(sheets):
            return
        last = 0
        for row in ElementTree.fromstring(z.read(sheets[sheet])).iter(f"{{{_NS['m']}}}row"):
            number = int(row.get("r", last + 1))
            for _ in range(last + 1, number):
                yield []
            last = number
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1 if letters else len(cells)
                cells += [None] * (at - len(cells))
                v = c.find("m:v", _NS)
                kind = c.get("t")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                elif v is None or v.text is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(v.text)] if kind == "s" else v.text)
            yield cells


def xlsx_thesaurus_rows(spark: SparkSession, path: str, sheet: int = 0, row_offset: int = 0, column_offset: int = 0) -> DataFrame:
    """(file_no, line_no, thesaurus_id, id, value, target_id) of sheets; an empty row ends a sheet.

    ValueError, within the task, for a sheet that begins without a thesaurus id, and for a row with neither id nor target.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for n, cells in enumerate(_sheet_rows(bytes(content), sheet)):
                    if n >= row_offset:
                        own = (cells[column_offset : column_offset + 4] + [None] * 4)[:4]
                        if not any(own):
                            break
                        if not rows and not own[0]:
                            raise ValueError(f"no thesaurus id at row {n + 1} of {p}")
                        if own[3] is None and own[1] is None:
                            raise ValueError(f"no entry id at row {n + 1} of {p}")
                        rows.append((p, n + 1, *own))
                yield pd.DataFrame(rows, columns=["file", "line_no", "thesaurus_id", "id", "value", "target_id"])

    out = files.mapInPandas(run, "file string, line_no int, thesaurus_id string, id string, value string, target_id string")
    return out.select(F.xxhash64("file").alias("file_no"), "line_no", "thesaurus_id", "id", "value", "target_id")


def json_thesauri(spark: SparkSession, path: str) -> DataFrame:
    """Thesauri (id, entries, targetId) of JSON files that hold one or an array of them."""
    schema = "id string, entries array<struct<id:string,value:string>>, targetId string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc): facets, settings and other JSON objects as text, one row per object of a file or of its array."""
    whole = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    many = F.try_variant_get(v, "$", "array<variant>")
    return whole.select(F.explode(F.coalesce(many, F.array(v))).alias("v")).where("v is not null").select(F.to_json("v").alias("doc"))
