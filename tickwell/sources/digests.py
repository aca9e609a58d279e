"""Digests of whole tables that depend on types, on order and on every value, and on nothing else.

A row's digest is the SHA-256 of its typed values; rows are cut by their position into ranges of 4096, a range's digest is that of its
rows' in order, and so on for ranges of ranges, which is a tree of three levels (of 64 thousand million rows). So a digest does not depend on
partitions, equal ranges have equal digests, and parts that cover whole ranges can be made apart and merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE, LEVELS = 4096, 3
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def tagged(name: str, kind: T.DataType) -> Column:
    """A value as text with its type: nothing is lost, and no two values of any types are told alike. Nested types raise."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        text = F.concat(F.length(c).cast("string"), F.lit(":"), c)
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(c))
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, _PLAIN):
        text = c.cast("string")
    else:
        raise TypeError(f"a column of type {kind.simpleString()} has no digest")
    return F.concat(F.lit(f"{kind.simpleString()}="), F.coalesce(text, F.lit("null")), F.lit(";"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ranges(df: DataFrame, position: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, range, digest) of each range of rows; ``position`` orders the rows of a group from 0 and is itself no value; rows of one position, of which there should be one, stand by their digests."""
    values = [f for f in df.schema.fields if f.name != position and f.name not in by]
    row = _sha(F.concat(F.lit(""), *[tagged(f.name, f.dataType) for f in values]))
    rows = df.select(*by, F.col(position).cast("long").alias("at"), row.alias("digest"))
    return _level(rows, by)


def _level(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    inside = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]))
    return rows.groupBy(*by, F.floor(F.col("at") / RANGE).cast("long").alias("range")).agg(_sha(inside).alias("digest"))


def merged(parts: DataFrame, schema: T.StructType, position: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, digest) from the ``ranges`` of all parts of a table of this schema."""
    for _ in range(LEVELS - 1):
        parts = _level(parts.withColumnRenamed("range", "at"), by)
    names = ";".join(f"{len(f.name)}:{f.name}={f.dataType.simpleString()}" for f in schema.fields if f.name != position and f.name not in by)
    group = parts.groupBy(*by) if by else parts.groupBy()
    first = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("range", "digest"))), lambda x: x["digest"]))
    out = group.agg(first.alias("all"), F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("a table of more rows than three levels hold"))).otherwise(_sha(F.concat(F.lit(f"table\0{names}\0"), F.col("all"))))
    return out.select(*by, one.alias("digest"))


def digest(df: DataFrame, position: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, digest) of the table, or of each of its groups."""
    return merged(ranges(df, position, by), df.schema, position, by)
