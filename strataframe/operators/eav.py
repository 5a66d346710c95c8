"""Entity, attribute, value rows into one typed row per entity: RDD.combineByKey with slot registers.

A register is a map from slot (the column's number) to the literal with the lowest row id so far. Merging registers is
associative and idempotent, so it runs on the map side: an entity with any number of rows sends one register a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

#: fixed values: column types by the local names of XML Schema datatypes
KINDS = {"string": "string", "integer": "integer", "int": "integer", "long": "integer", "decimal": "decimal", "boolean": "boolean", "date": "date"}
_YEAR = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})"
_LEAP = r"-?(?:[0-9]*(?:[0-9](?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00))"
_DAYS = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
_ZONE = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
#: lexical forms of XML Schema, between white space
FORMS = {
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "boolean": r"true|false|1|0",
    "date": rf"(?:{_YEAR}-{_DAYS}|(?={_YEAR}-){_LEAP}-02-29){_ZONE}",
}
_EXACT = Context(prec=10_000, rounding=ROUND_HALF_UP)


def valid(literal: Column, kind: Column) -> Column:
    """Whether literal has a lexical form of kind; any text is a string."""
    out = kind == "string"
    for k, form in FORMS.items():
        out = out | ((kind == k) & literal.rlike(rf"\A[ \t\r\n]*(?:{form})[ \t\r\n]*\z"))
    return out


def canonical(text: str, kind: str) -> str:
    """The canonical text of a valid literal."""
    if kind == "string":
        return text
    text = text.strip(" \t\r\n")
    if kind == "boolean":
        return "true" if text in ("true", "1") else "false"
    if kind == "date":
        return re.match(r"-?[0-9]+-[0-9]{2}-[0-9]{2}", text).group()
    if kind == "integer":
        digits = text.lstrip("+-").lstrip("0") or "0"
        return "-" + digits if text[0] == "-" and digits != "0" else digits
    number = Decimal(text).quantize(Decimal("0.0001"), context=_EXACT)
    return format(abs(number) if number == 0 else number, "f")


def typed(text: str, kind: str):
    """The value for a column of spark_type(kind); None if it is beyond that type, which the text in cells() isn't."""
    if kind == "boolean":
        return text == "true"
    if kind == "date":
        import datetime

        try:
            return datetime.date.fromisoformat(text)
        except ValueError:
            return None
    if kind == "integer":
        return number if len(text) <= 20 and -(2**63) <= (number := int(text)) < 2**63 else None
    if kind == "decimal":
        return Decimal(text) if len(text.lstrip("-")) <= 34 + len(".0000") else None
    return text


def spark_type(kind: str) -> DataType:
    return {"string": StringType(), "integer": LongType(), "decimal": DecimalType(38, 4), "boolean": BooleanType(), "date": DateType()}[kind]


@dataclass
class WideTable:
    spark: SparkSession
    columns: list[tuple[int, str]]
    max_columns: int
    registers: RDD

    def cells(self) -> DataFrame:
        """(s_id, p_id, typ, val): one row per filled cell, with its canonical text."""
        columns = self.columns
        flat = self.registers.flatMap(lambda r: [(r[0], columns[s][0], columns[s][1], canonical(v, columns[s][1])) for s, (_, v) in r[1].items()])
        return self.spark.createDataFrame(flat, "s_id int, p_id int, typ string, val string", verifySchema=False)

    def misfits(self) -> DataFrame:
        """(s_id, p_id, typ, val): the cells whose valid value is beyond its column's type and so null in rows()."""
        columns = self.columns
        values = lambda r: [(r[0], *columns[s], v) for s, (_, x) in r[1].items() if typed(v := canonical(x, columns[s][1]), columns[s][1]) is None]
        return self.spark.createDataFrame(self.registers.flatMap(values), "s_id int, p_id int, typ string, val string", verifySchema=False)

    def rows(self) -> DataFrame:
        """s_id and one typed column pN per property N; null where the entity has no valid literal."""
        columns = self.columns
        if len(columns) > self.max_columns:
            raise ValueError(f"more than {self.max_columns} properties")

        def encode(r):
            return (r[0], *[typed(canonical(r[1][s][1], kind), kind) if s in r[1] else None for s, (_, kind) in enumerate(columns)])

        schema = StructType([StructField("s_id", IntegerType()), *[StructField(f"p{p}", spark_type(k)) for p, k in columns]])
        return self.spark.createDataFrame(self.registers.map(encode), schema, verifySchema=False)


def column_kinds(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """(p_id, typ) of every property with literals.

    typ is that of the property's data_type; where this is null, the one most of the literals' o_lit_type name (of
    equally frequent ones the first in the alphabet), or `string`. Unknown datatypes count as string.
    """
    def kind(c: Column) -> Column:
        local = F.element_at(F.split(F.lower(F.trim(c)), ":"), -1)
        return F.when(c.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[local], F.lit("string")))

    named = triples.where("o_lit is not null and p_id is not null").groupBy("p_id", kind(F.col("o_lit_type")).alias("k")).agg(F.count("*").alias("n"))
    most = named.groupBy("p_id").agg(F.min_by("k", F.when(F.col("k").isNotNull(), F.struct(-F.col("n"), F.col("k")))).alias("k"))
    own = properties.where("id is not null").groupBy(F.col("id").alias("p_id")).agg(F.min(kind(F.col("data_type"))).alias("own"))
    return most.join(own, "p_id", "left").select("p_id", F.coalesce("own", "k", F.lit("string")).alias("typ"))


def widen(triples: DataFrame, properties: DataFrame, max_columns: int = 5_000, partitions: int | None = None) -> WideTable:
    """The wide table of triples (id, s_id, p_id, o_lit, o_lit_type) by the types of properties (id, data_type).

    A cell holds the literal with the lowest id among those valid for the column's type. Rows without subject, property
    or literal fill no cell; a null id is above all others; of equal ids the least text wins. Repeated rows change
    nothing. With more than max_columns properties, which no row could hold, there are cells() only, and rows() raises
    ValueError. The columns, one a property, are known to the driver; they are broadcast up to max_columns.
    """
    spark = triples.sparkSession
    columns = sorted(tuple(r) for r in column_kinds(triples, properties).collect())
    slots = spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(columns)], "p_id int, typ string, slot int")
    cells = triples.where("s_id is not null and o_lit is not null").select("id", "s_id", "p_id", "o_lit").join(F.broadcast(slots) if len(columns) <= max_columns else slots, "p_id").where(valid(F.col("o_lit"), F.col("typ"))).select("s_id", "slot", F.coalesce(F.col("id").cast("long"), F.lit(2**62)).alias("id"), "o_lit")

    def put(register: dict, x: tuple) -> dict:
        if x[0] not in register or x[1:] < register[x[0]]:
            register[x[0]] = x[1:]
        return register

    def merge(a: dict, b: dict) -> dict:
        for s, v in b.items():
            if s not in a or v < a[s]:
                a[s] = v
        return a

    pairs = cells.rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return WideTable(spark, columns, max_columns, pairs.combineByKey(lambda x: {x[0]: x[1:]}, put, merge, numPartitions=n))
