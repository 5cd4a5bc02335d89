"""A square lon/lat grid whose cell ids sort in Z-order.

A cell of ``level`` has side 360 / 2**level degrees. Its id holds the level in
the bits from 56 up and the interleaved column and row numbers below, so that
the parent is a two-bit shift and neighbouring ids are neighbouring cells.
Levels up to 27 fit.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakecross.functions.naming import named

LEVEL_BIT = 56
CODE_MASK = (1 << LEVEL_BIT) - 1

# Shift and mask of each step that spreads the low 32 bits to the even bits.
SPREAD = [
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
]


def cell_side(level: int) -> float:
    """Side of a cell in degrees."""
    return 360.0 / (1 << level)


def column_index(lon: Column, level: int) -> Column:
    """Column number of a longitude; values west of -180 stay in column 0."""
    return F.greatest(F.floor((lon + 180.0) / cell_side(level)), F.lit(0).cast("long"))


def row_index(lat: Column, level: int) -> Column:
    """Row number of a latitude; values south of -90 stay in row 0."""
    return F.greatest(F.floor((lat + 90.0) / cell_side(level)), F.lit(0).cast("long"))


def _spread(value: Column) -> Column:
    for shift, mask in SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def _closer(shift: int, mask: int):
    return lambda x: x.v.bitwiseOR(F.shiftrightunsigned(x.v, shift)).bitwiseAND(F.lit(mask).cast("long"))


def _gather(code: Column) -> Column:
    value = code.bitwiseAND(F.lit(SPREAD[-1][1]).cast("long"))
    wider = [mask for _, mask in SPREAD[:-1]][::-1] + [0x00000000FFFFFFFF]
    for (shift, _), mask in zip(SPREAD[::-1], wider):
        # Written out twice at each step, the code would double five times.
        value = named(_closer(shift, mask), v=value)
    return value


def cell_id(ix: Column, iy: Column, level: int) -> Column:
    """Id of the cell in column ``ix`` and row ``iy`` (both bigint)."""
    code = _spread(ix).bitwiseOR(F.shiftleft(_spread(iy), 1))
    return code.bitwiseOR(F.lit(level << LEVEL_BIT).cast("long"))


def cell_of(lon: Column, lat: Column, level: int) -> Column:
    """Id of the cell that holds a point."""
    return cell_id(column_index(lon, level), row_index(lat, level), level)


def cell_level(cell: Column) -> Column:
    """Level of a cell."""
    return F.shiftrightunsigned(cell, LEVEL_BIT)


def cell_column(cell: Column) -> Column:
    """Column number of a cell."""
    return _gather(cell.bitwiseAND(F.lit(CODE_MASK).cast("long")))


def cell_row(cell: Column) -> Column:
    """Row number of a cell."""
    code = cell.bitwiseAND(F.lit(CODE_MASK).cast("long"))
    return _gather(F.shiftrightunsigned(code, 1))


def cell_parent(cell: Column, steps: int = 1) -> Column:
    """The cell ``steps`` levels up that contains this one."""
    code = F.shiftrightunsigned(cell.bitwiseAND(F.lit(CODE_MASK).cast("long")), 2 * steps)
    return F.shiftleft(cell_level(cell) - steps, LEVEL_BIT).bitwiseOR(code)


def cell_bounds(cell: Column) -> Column:
    """Outline of a cell as a struct of xmin, ymin, xmax, ymax."""

    def outline(x: Column) -> Column:
        return F.struct(
            (x.ix * x.side - 180.0).alias("xmin"),
            (x.iy * x.side - 90.0).alias("ymin"),
            ((x.ix + 1) * x.side - 180.0).alias("xmax"),
            ((x.iy + 1) * x.side - 90.0).alias("ymax"),
        )

    side = F.lit(360.0) / F.pow(F.lit(2.0), cell_level(cell))
    return F.when(cell.isNotNull(), named(outline, side=side, ix=cell_column(cell), iy=cell_row(cell)))


def cell_text(cell: Column) -> Column:
    """Id of a cell as lower-case hex text."""
    return F.lower(F.hex(cell))
