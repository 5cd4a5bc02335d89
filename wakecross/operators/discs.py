"""Where two discs meet inside a box."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.functions.geometry import clamp, points_d2
from wakecross.operators.steps import let


# Room for rounding in a power, in square degrees; well under a micrometre.
TOUCH = 1e-15


def discs_meet_in_box(pairs: DataFrame, a, b, box) -> DataFrame:
    """Rows in which two discs and a box have a point in common.

    ``a`` and ``b`` are tuples (lon, lat, r) of columns, ``box`` is (xmin,
    ymin, xmax, ymax). Each disc is where its power, the squared distance less
    the squared radius, is at most zero. The larger of both powers is convex:
    over the box it is least at the box point nearest to one centre or, on the
    line of equal power, at the box point nearest to the line of centres.
    """
    columns = pairs.columns
    (ax, ay, ar), (bx, by, br) = a, b
    xmin, ymin, xmax, ymax = box
    zero = F.lit(0.0)

    def larger_power(x, y):
        return F.greatest(points_d2(ax, ay, x, y) - ar * ar, points_d2(bx, by, x, y) - br * br)

    steps = let(pairs, dx_=bx - ax, dy_=by - ay)
    dx, dy = F.col("dx_"), F.col("dy_")
    steps = let(steps, apart_=F.nullif(dx * dx + dy * dy, zero))
    share = (F.col("apart_") + ar * ar - br * br) / (2.0 * F.col("apart_"))
    steps = let(steps, share_=share)
    steps = let(steps, qx_=ax + F.col("share_") * dx, qy_=ay + F.col("share_") * dy)
    qx, qy = F.col("qx_"), F.col("qy_")
    # The line of equal power is (qx - s * dy, qy + s * dx); in the box, s is
    # between these ends. Levels along an axis set no end.
    level_x, level_y = F.nullif(dy, zero), F.nullif(dx, zero)
    steps = let(
        steps, sa_=(qx - xmin) / level_x, sb_=(qx - xmax) / level_x,
        sc_=(ymin - qy) / level_y, sd_=(ymax - qy) / level_y,
    )
    low = F.greatest(F.least("sa_", "sb_"), F.least("sc_", "sd_"))
    high = F.least(F.greatest("sa_", "sb_"), F.greatest("sc_", "sd_"))
    steps = let(steps, s_=clamp(zero, low, high))
    steps = let(
        steps,
        lx_=clamp(qx - F.col("s_") * dy, xmin, xmax), ly_=clamp(qy + F.col("s_") * dx, ymin, ymax),
        cax_=clamp(ax, xmin, xmax), cay_=clamp(ay, ymin, ymax),
        cbx_=clamp(bx, xmin, xmax), cby_=clamp(by, ymin, ymax),
    )
    lowest = F.least(
        larger_power(F.col("cax_"), F.col("cay_")),
        larger_power(F.col("cbx_"), F.col("cby_")),
        F.when(F.col("apart_").isNotNull(), larger_power(F.col("lx_"), F.col("ly_"))),
    )
    return steps.where(lowest <= TOUCH).select(*columns)
