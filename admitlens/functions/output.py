"""JSON reading and output typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_json(c: Column, schema: str | T.DataType, default: Column | None = None) -> Column:
    """JSON text as a value; NULL or the default when it cannot be read."""
    parsed = F.from_json(c, schema)
    # A permissive reader turns broken text into a struct of NULLs; ask for well-formed text first.
    good = F.when(F.try_parse_json(c).isNotNull(), parsed)
    return good if default is None else F.coalesce(good, default)


def output_types(df: DataFrame) -> DataFrame:
    """Decimals as double, dates and timestamps as ISO text; everything else unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micro = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            c = F.when(c == F.date_trunc("second", c), whole).otherwise(micro)
        out.append(c.alias(f.name))
    return df.select(*out)
