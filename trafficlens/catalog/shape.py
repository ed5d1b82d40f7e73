"""Output conventions of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
# Statistics of a few whole microseconds often end on a half just behind the sixth digit,
# where two engines may round to different sides.
SECONDS_DIGITS = 3
SECONDS_PREFIXES = ("flow_duration_", "inter_arrival_time_")


def digits_of(column: str) -> int:
    in_seconds = column.startswith(SECONDS_PREFIXES) and not column.endswith("_cv")
    return SECONDS_DIGITS if in_seconds else DIGITS


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column, so that two engines can be compared value by value."""
    return df.select(
        *[F.round(F.col(f.name), digits_of(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
          for f in df.schema.fields]
    )
