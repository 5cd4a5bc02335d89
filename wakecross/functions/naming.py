"""Names for intermediate values inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(use: Callable[[Column], Column], **values: Column) -> Column:
    """``use`` of a struct of the values, each of which is computed once however often it is used.

    Written out at each use, values that build on one another double with every step, until the
    generated code no longer compiles. For whole frames ``let`` does the same, within generated code.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.transform(F.array(row), use)[0]
