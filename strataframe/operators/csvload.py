"""Loading of delimited records with bad ones set apart: a quote-aware finite-state tokenizer over raw bytes.

The records of an Arrow batch form one byte stream, in which a record's end resets the state. The stream is cut into
chunks of equal length. For every chunk the composition of its byte transitions is built, a map from each state to a
state; a prefix scan over these maps gives the state in which each chunk begins; then all chunks run at once. A record
may span any number of chunks, so very long ones cost no more per byte than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strataframe import storage

START, UNQUOTED, QUOTED, QUOTE, AFTER, IN_UNQUOTED, AFTER_CLOSE = range(7)
_OTHER, _QUOTE, _COMMA, _SPACE, _END = range(5)
#: next state by byte class and state
_NEXT = np.array(
    [
        [UNQUOTED, UNQUOTED, QUOTED, AFTER_CLOSE, AFTER_CLOSE, IN_UNQUOTED, AFTER_CLOSE],
        [QUOTED, IN_UNQUOTED, QUOTE, QUOTED, AFTER_CLOSE, IN_UNQUOTED, AFTER_CLOSE],
        [START, START, QUOTED, START, START, IN_UNQUOTED, AFTER_CLOSE],
        [START, UNQUOTED, QUOTED, AFTER, AFTER, IN_UNQUOTED, AFTER_CLOSE],
        [START] * 7,
    ],
    np.int8,
)
ERRORS = {IN_UNQUOTED: "quote in an unquoted field", AFTER_CLOSE: "text after a closing quote", QUOTED: "quote not closed"}
CHUNK = 256


def states(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state after each byte of a stream that begins in START, by composition of chunk transitions."""
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, _OTHER, np.int8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # grid[j]: byte j of every chunk
    maps = np.tile(np.arange(7, dtype=np.int8), (rows, 1))
    for c in grid:
        maps = _NEXT[c[:, None], maps]
    # inclusive scan of the maps by doubling: after k rounds maps[i] composes the 2^k chunks that end with i
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    now = np.concatenate([np.zeros(1, np.int8), maps[:-1, START]])
    out = np.empty((chunk, rows), np.int8)
    for j, c in enumerate(grid):
        now = _NEXT[c, now]
        out[j] = now
    return out.T.reshape(-1)[:n]


def tokenize(records: list[str | None], delimiter: str = ",", quote: str = '"', chunk: int = CHUNK) -> list[tuple[list[str] | None, str | None, int | None]]:
    """(fields, error, byte offset of the error) of each record; (None, None, None) for null and blank ones."""
    kept = [(i, r[:-1] if r.endswith("\r") else r) for i, r in enumerate(records) if r is not None]
    out: list[tuple[list[str] | None, str | None, int | None]] = [(None, None, None)] * len(records)
    kept = [(i, r.encode("utf-8", "surrogatepass")) for i, r in kept if r.strip(" \r\n\t")]
    if not kept:
        return out
    table = np.zeros(256, np.int8)
    table[ord(quote)], table[ord(delimiter)], table[32] = _QUOTE, _COMMA, _SPACE
    stream = b"\n".join(r for _, r in kept) + b"\n"
    classes = table[np.frombuffer(stream, np.uint8)]
    ends = np.cumsum(np.fromiter((len(r) + 1 for _, r in kept), np.int64, len(kept))) - 1
    classes[ends] = _END  # line breaks within records stay ordinary bytes
    after = states(classes, chunk)
    before = np.concatenate([np.zeros(1, np.int8), after[:-1]])
    final = before[ends]
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.flatnonzero((classes == _COMMA) & (after == START) | (classes == _END))
    first = np.searchsorted(bounds, starts)
    stop = np.searchsorted(bounds, ends)
    wrong = np.flatnonzero((after >= IN_UNQUOTED) & (before < IN_UNQUOTED))
    opened = np.flatnonzero((after == QUOTED) & (before == START))
    q, qq = quote.encode(), quote.encode() * 2
    for k, (i, _) in enumerate(kept):
        if final[k] in ERRORS:
            at = opened[np.searchsorted(opened, ends[k]) - 1] if final[k] == QUOTED else wrong[np.searchsorted(wrong, starts[k])]
            out[i] = (None, ERRORS[int(final[k])], int(at - starts[k]))
            continue
        fields, a = [], int(starts[k])
        for b in bounds[first[k] : stop[k] + 1].tolist():
            x = stream[a:b].strip(b" ")
            fields.append((x[1:-1].replace(qq, q) if x[:1] == q else x).decode("utf-8", "surrogatepass"))
            a = b + 1
        out[i] = (fields, None, None)
    return out


def tokenized(df: DataFrame, raw: str, keep: list[str], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """keep..., fields ARRAY<STRING>, error STRING, error_at INT of each record; fields and error null for blank ones.

    Spaces around a field and a final CR don't count; a doubled quote within a quoted field is one. Null and blank
    records have neither fields nor an error. Extra columns are dropped; repeated rows stay.
    """
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add("fields", ArrayType(StringType())).add("error", "string").add("error_at", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = tokenize(b.column(len(keep)).to_pylist(), delimiter, quote)
            cols = [b.column(i) for i in range(len(keep))]
            cols += [pa.array([f for f, _, _ in done], pa.list_(pa.string())), pa.array([e for _, e, _ in done], pa.string()), pa.array([o for _, _, o in done], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{raw}`")).mapInArrow(run, schema)


#: fixed values: the names a header must have, and what their fields may hold
COLUMNS = ("thesaurusid", "id", "value", "targetid")
NAME = r"[A-Za-z0-9._-]+"
LANGUAGE = r"@[a-z]{2,3}"
BAD_VALUE = r"[\x{FFFD}\x{007F}\x00-\x08\x0B\x0C\x0E-\x1F]"


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def read_thesaurus_records(df: DataFrame) -> DataFrame:
    """file_no, line_no, reason, detail, detail_at, thesaurus_id, id, value, target_id of each record but headers and blanks.

    reason is null for a good record, else the first that applies of `quoting`, `columns` and `value`. Line 1 of a file
    is its header; in a file without one, or with one that can't be tokenized, every record fails as `columns`. An empty
    thesaurus_id is that of the last earlier record of the file, among those with the right number of fields, that has
    one. Empty fields come out as null. Repeated rows come out once. Records with a null file or line are kept, in a
    file of their own and after all others.
    """
    unmarked = F.when(F.col("line_no") == 1, F.regexp_replace("raw", "^\\x{FEFF}", "")).otherwise(F.col("raw"))
    once = tokenized(df.select("file_no", "line_no", unmarked.alias("raw")).distinct(), "raw", ["file_no", "line_no"])
    rows = storage.materialize(once, storage.workspace(df.sparkSession, "records"))  # read below for headers, bodies and blocks
    names = F.transform("fields", lambda x: F.lower(F.trim(x)))
    header = rows.where("line_no = 1").groupBy("file_no").agg(F.max(names).alias("names")).select(F.col("file_no").alias("h_file"), "names")
    body = rows.where("not (line_no <=> 1) and (fields is not null or error is not null)")
    body = body.join(header, F.col("file_no").eqNullSafe(F.col("h_file")), "left").drop("h_file")

    def field(name: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.nullif(F.get("fields", (at - 1).cast("int")), F.lit("")))

    body = body.withColumn("framed", F.col("error").isNull() & F.coalesce(F.size("fields") == F.size("names"), F.lit(False)))
    named = {"t": "thesaurusid", "i": "id", "v": "value", "g": "targetid"}
    body = body.select("file_no", "line_no", "error", "error_at", "framed", F.size("fields").alias("n"), F.size("names").alias("n_names"), *[F.when(F.col("framed"), field(name)).alias(c) for c, name in named.items()])
    body = fill_down(body, "file_no", "line_no", "t", "inherited")
    t, i, v, g = (F.col(c) for c in "tivg")
    problem = (
        F.when(t.isNotNull() & ~_is(t, NAME + LANGUAGE), F.lit("thesaurus id"))
        .when(t.isNull() & F.col("inherited").isNull(), F.lit("no thesaurus id"))
        .when(i.isNull() & g.isNull(), F.lit("neither id nor target"))
        .when(g.isNotNull() & (i.isNotNull() | v.isNotNull()), F.lit("target with id or value"))
        .when(i.isNotNull() & ~_is(i, NAME), F.lit("id"))
        .when(g.isNotNull() & ~_is(g, f"{NAME}(?:{LANGUAGE})?"), F.lit("target id"))
        .when(v.rlike(BAD_VALUE), F.lit("characters in the value"))
    )
    reason = F.when(F.col("error").isNotNull(), F.lit("quoting")).when(~F.col("framed"), F.lit("columns")).when(problem.isNotNull(), F.lit("value"))
    detail = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("framed"), F.concat(F.col("n"), F.lit(" fields, not "), F.coalesce(F.col("n_names").cast("string"), F.lit("known")))).otherwise(problem)
    return body.select("file_no", "line_no", reason.alias("reason"), detail.alias("detail"), F.col("error_at").alias("detail_at"), F.coalesce(t, F.col("inherited")).alias("thesaurus_id"), i.alias("id"), v.alias("value"), g.alias("target_id"))


def fill_down(df: DataFrame, group: str, order: str, value: str, out: str, block: int = 100_000, before: bool = False) -> DataFrame:
    """df with out: the last non-null value before or at each row of its group, in the order of an integer column.

    Rows go by blocks of the order, so a group with a third of all rows is spread over many tasks; only one row per
    block is seen by the window over a whole group. Rows with a null order come last. before: the row itself doesn't count.
    """
    if order not in df.columns or group not in df.columns:
        raise ValueError(f"{group} and {order} must be columns")
    b = F.coalesce(F.floor(F.col(order) / block), F.lit(2**40))
    df = df.withColumn("__b", b)
    ends = df.where(F.col(value).isNotNull()).groupBy(group, "__b").agg(F.max_by(value, F.coalesce(F.col(order).cast("long"), F.lit(2**62))).alias("__end"))
    blocks = df.select(group, "__b").distinct().join(ends.select(F.col(group).alias("__g"), F.col("__b").alias("__bb"), "__end"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__bb")), "left")
    over = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select(F.col(group).alias("__g"), F.col("__b").alias("__bb"), F.last("__end", True).over(over).alias("__before"))
    inside = Window.partitionBy(group, "__b").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    filled = df.withColumn("__in", F.last(value, True).over(inside))
    return filled.join(earlier, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__bb")), "left").withColumn(out, F.coalesce("__in", "__before")).drop("__b", "__bb", "__g", "__in", "__before")
