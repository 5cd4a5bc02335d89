"""Encounters between buffered trajectories of the same time window."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.functions.geometry import all_of
from wakecross.functions.grid import cell_column, cell_id, cell_level, cell_row, cell_side, column_index, row_index
from wakecross.functions.units import LINE_LEVEL, PING_LEVEL
from wakecross.operators.cover import FIRST_X, FIRST_Y, SLACK, box_keys, cell_box, compacted, outside_compacted
from wakecross.operators.hot_keys import KEY_ROWS, same_tile, tile_hot_keys
from wakecross.operators.joins import by_size
from wakecross.operators.segments import meeting, meeting_in_box, with_offsets, with_stretches
from wakecross.sources.tables import stored

# Long segments are keyed in pieces of at most this many cells a side.
PIECE_CELLS = 4

SEGMENT = ("x1", "y1", "x2", "y2")
BOX = ("west", "south", "east", "north")


def segment_keys(buffered: DataFrame, level: int) -> DataFrame:
    """Buffered segments keyed by the cells their bounding boxes touch.

    A long segment takes the boxes of its pieces instead of one large box. The
    row keeps the whole segment for the exact test.
    """
    x1, y1, x2, y2 = (F.col(c) for c in SEGMENT)
    longest = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    pieces = F.greatest(F.ceil(longest / (PIECE_CELLS * cell_side(level))), F.lit(1).cast("long"))
    cut = buffered.select(
        "ping_id", "mmsi", "window_start", "window_end", *SEGMENT, "r", pieces.alias("pieces")
    ).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    start, end = F.col("piece") / F.col("pieces"), (F.col("piece") + 1) / F.col("pieces")
    xa, xb, ya, yb = x1 + start * (x2 - x1), x1 + end * (x2 - x1), y1 + start * (y2 - y1), y1 + end * (y2 - y1)
    reach = F.col("r") * SLACK
    boxed = cut.select(
        *[c for c in cut.columns if c not in ("piece", "pieces")],
        (F.least(xa, xb) - reach).alias("west"), (F.least(ya, yb) - reach).alias("south"),
        (F.greatest(xa, xb) + reach).alias("east"), (F.greatest(ya, yb) + reach).alias("north"),
    )
    return box_keys(boxed, level, *(F.col(c) for c in BOX))


def _overlapping(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def _shared_cells(met: DataFrame, emit_level: int, level: int | None) -> DataFrame:
    """One row per cell of ``emit_level`` in which the buffers of a pair meet; of ``level``, only those in the key cell (ix, iy)."""

    def cells(key: str, low: Column, high: Column) -> Column:
        if level is not None:
            first = F.shiftleft(key, emit_level - level)
            low, high = F.greatest(low, first), F.least(high, first + ((1 << (emit_level - level)) - 1))
        return F.when(low <= high, F.sequence(low, high))

    south = row_index(F.greatest("south_1", "south_2"), emit_level)
    north = row_index(F.least("north_1", "north_2"), emit_level)
    west = column_index(F.greatest("west_1", "west_2"), emit_level)
    east = column_index(F.least("east_1", "east_2"), emit_level)
    p, q = (tuple(F.col(f"{c}_{n}") for c in SEGMENT) for n in ("1", "2"))
    buffers = (p, q, F.col("r_1"), F.col("r_2"))
    own_west, own_south, own_east, own_north = cell_box(emit_level)
    pairs = with_offsets(met, *buffers)
    rows = pairs.select(*[c for c in pairs.columns if c != "iy"], F.explode(cells("iy", south, north)).alias("iy"))
    # Cells of a row have their southern and northern edges on the same lines.
    rows = with_stretches(rows, *buffers, "x", south_=own_south, north_=own_north)
    found = rows.select(*[c for c in rows.columns if c != "ix"], F.explode(cells("ix", west, east)).alias("ix"))
    return meeting_in_box(with_stretches(found, *buffers, "y", west_=own_west, east_=own_east))


def line_encounters(
    buffered: DataFrame,
    level: int = LINE_LEVEL,
    emit: str = "shared",
    emit_level: int = PING_LEVEL,
    key_rows: int = KEY_ROWS,
    outside: DataFrame | None = None,
) -> DataFrame:
    """Pairs of vessels whose buffered lines of one window meet.

    ``buffered`` comes from ``buffered_segments``. ``emit="point"`` yields
    (vessel_1, vessel_2, window_start, window_end) once each. ``emit="shared"``
    adds ``index``, the cells of ``emit_level`` in which both buffered lines
    have a point in common.

    Segments are joined on coarse cell and window, each pair is tested once,
    and rows are made distinct before and after the last shuffle. ``outside`` is a frame of cells
    (of ``emit_level``, shared mode only) to leave out: full coarse cells among
    them are dropped before pairing, the others from the pairs' cells. Then each
    coarse cell that is left yields the small cells in it.
    """
    if emit not in ("point", "shared"):
        raise ValueError(f"unknown emit: {emit}")
    keyed = segment_keys(buffered, level)
    if outside is not None:
        if emit != "shared" or emit_level < level:
            raise ValueError("cells can be left out in shared mode only, and of a finer level than the join's")
        compact = stored(compacted(outside, emit_level, level))
        whole = compact.where(cell_level(F.col("cell")) == level)
        coarse = whole.select(cell_column(F.col("cell")).alias("ix"), cell_row(F.col("cell")).alias("iy"))
        keyed = keyed.join(by_size(coarse), ["ix", "iy"], "left_anti")
    tiled = tile_hot_keys(keyed, ["ix", "iy", "window_start"], "ping_id", key_rows)
    # Without the cell that would count a pair, every cell has to.
    once = FIRST_X + FIRST_Y if outside is None else 0
    tests = [
        *[F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("ix", "iy", "window_start", "tile")],
        F.col("a.first").bitwiseOR(F.col("b.first")).bitwiseAND(once) == once,
        same_tile(),
        F.col("a.mmsi") < F.col("b.mmsi"),
        _overlapping(F.col("a.west"), F.col("a.east"), F.col("b.west"), F.col("b.east")),
        _overlapping(F.col("a.south"), F.col("a.north"), F.col("b.south"), F.col("b.north")),
    ]
    carried = [*SEGMENT, "r", *(BOX if emit == "shared" else ())]
    near = tiled.alias("a").join(tiled.alias("b").hint("merge"), all_of(tests)).select(
        F.col("a.mmsi").alias("vessel_1"),
        F.col("b.mmsi").alias("vessel_2"),
        F.col("a.window_start").alias("window_start"),
        F.col("a.window_end").alias("window_end"),
        *[F.col(f"{side}.{c}").alias(f"{c}_{n}") for side, n in (("a", "1"), ("b", "2")) for c in carried],
        *([F.col("a.ix").alias("ix"), F.col("a.iy").alias("iy")] if emit == "shared" else ()),
    )
    p, q = (tuple(F.col(f"{c}_{n}") for c in SEGMENT) for n in ("1", "2"))
    met = meeting(near, p, q, F.col("r_1"), F.col("r_2"))
    keys = ["vessel_1", "vessel_2", "window_start", "window_end"]
    if emit == "point":
        return met.select(*keys).distinct()
    cells = _shared_cells(met, emit_level, None if outside is None else level)
    found = cells.select(*keys, cell_id(F.col("ix"), F.col("iy"), emit_level).alias("index"))
    if outside is not None:
        found = outside_compacted(found, compact, "index", emit_level, level)
    return found.distinct()
