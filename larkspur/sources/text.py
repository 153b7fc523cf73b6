"""Text in and out: lenient decoding of text columns, and rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the declared types; what can't be read as its type is null, and so are columns that are missing."""
    cells = [(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return rows.select(*cells)


def as_text(value: Column, kind: T.DataType) -> Column:
    """A value's text: floating point with 4 decimals, booleans as t and f, null as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), F.format_string("%.4f", value))
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    return value.cast("string")


def text_rows(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
