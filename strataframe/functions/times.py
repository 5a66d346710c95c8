"""Times as numbers, whatever time zone the session has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

DAY = 86_400_000_000


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a column of df: of instants as they are, of times without zone as if they were UTC.

    Other types are read as times without zone; null where that isn't possible.
    """
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if kind.simpleString() != "timestamp_ntz":
        c = c.try_cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
