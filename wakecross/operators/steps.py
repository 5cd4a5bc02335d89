"""Named intermediate values for long expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(frame: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    A filter on a projected column is pushed below the projection with the
    column's expression written out at each use, and over several steps that
    grows until the generated code no longer compiles. A generated row is not
    seen through, and stays within whole-stage code.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return frame.select("*", F.inline(F.array(row)))
