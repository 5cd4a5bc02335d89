"""Splitting of join keys that hold too many rows for one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.operators.joins import by_size
from wakecross.sources.tables import stored

# A key above this many rows is split.
KEY_ROWS = 20_000


def hot_keys(rows: DataFrame, keys: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """Keys with more than ``key_rows`` rows, their size and number of parts.

    The sizes are counted with map-side combine. Every such key is listed,
    however large the input, so the list itself can be long: join it ``by_size``.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return sizes.where(F.col("size") > key_rows).withColumn("parts", F.ceil(F.col("size") / key_rows))


def found_hot_keys(rows: DataFrame, keys: list[str], key_rows: int = KEY_ROWS) -> DataFrame | None:
    """The hot keys, counted and stored at once; None where there are none.

    Knowing this before the plan is built keeps the usual plan, without hot
    keys, free of the joins that split them.
    """
    hot = stored(hot_keys(rows, keys, key_rows))
    return None if hot.isEmpty() else hot


def tile_hot_keys(rows: DataFrame, keys: list[str], row_id: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Prepares rows for a self-join on ``keys`` plus ``tile``.

    The rows of a hot key are hashed into blocks, and each row is repeated once
    per block of its key. Two rows of blocks i and j share the tile (i, j) and
    nothing but it counts them, see ``same_tile``. Both sides of the join are
    the same frame, so that one shuffle serves both. Other keys have one tile.
    """
    zero = F.lit(0).cast("long")
    hot = found_hot_keys(rows, keys, key_rows)
    if hot is None:
        return rows.select("*", zero.alias("block"), zero.alias("other"), zero.alias("tile"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    blocks = rows.join(by_size(hot.select(*keys, "parts")), keys, "left").select(
        *rows.columns, parts.alias("parts"), F.pmod(F.xxhash64(row_id), parts).alias("block"),
        F.explode(F.sequence(zero, parts - 1)).alias("other"),
    )
    tile = F.least("block", "other") * F.col("parts") + F.greatest("block", "other")
    return blocks.select(*rows.columns, "block", "other", tile.alias("tile"))


def same_tile(left: str = "a", right: str = "b") -> Column:
    """Whether the shared tile is the one that counts this pair.

    Written as one sum, not as two equalities: those would become join keys
    that differ between the sides, and each side would get its own shuffle.
    """
    off = F.abs(F.col(f"{left}.other") - F.col(f"{right}.block")) + F.abs(
        F.col(f"{right}.other") - F.col(f"{left}.block")
    )
    return off == 0
