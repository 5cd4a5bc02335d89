"""Speed, velocity and the time within which two pings can be one encounter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakecross.functions.units import KNOT_KMPH, ONE_METRE

# Fixed value: the heading that stands for "not available".
NO_HEADING = 511.0

# Limits in seconds of the corrected window.
SHORTEST_WINDOW = 60.0
LONGEST_WINDOW = 900.0

MODES = ("reference", "corrected")


def kmph(knots: Column) -> Column:
    """Knots to km/h, two decimals."""
    return F.round(knots * KNOT_KMPH, 2)


def velocity(speed: Column, heading: Column, mode: str = "reference") -> tuple[Column, Column]:
    """Velocity components of one ping.

    Reference mode takes the heading as radians. Corrected mode takes it as
    degrees and yields NULL where the heading is unknown.
    """
    if mode == "reference":
        angle = heading
    else:
        angle = F.radians(F.when(heading != NO_HEADING, heading))
    return speed * F.cos(angle), speed * F.sin(angle)


def window_of_velocities(first, second, radius: float, mode: str = "reference") -> Column:
    """Seconds two pings may lie apart; each is a tuple (speed, vx, vy)."""
    (s1, x1, y1), (s2, x2, y2) = first, second
    if mode == "reference":
        together = F.sqrt((x1 + x2) * (x1 + x2) + (y1 + y2) * (y1 + y2))
        return together * 1000.0 / radius / 3600.0
    against = F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    against = F.coalesce(against, F.abs(s1 - s2))
    seconds = (2.0 * radius / ONE_METRE) / F.nullif(against / 3.6, F.lit(0.0))
    seconds = F.coalesce(seconds, F.lit(LONGEST_WINDOW))
    return F.least(F.greatest(seconds, F.lit(SHORTEST_WINDOW)), F.lit(LONGEST_WINDOW))


def time_window(
    speed_1: Column, speed_2: Column, heading_1: Column, heading_2: Column, radius: float,
    mode: str = "reference",
) -> Column:
    """Seconds two pings may lie apart, from speeds (km/h) and headings.

    Reference mode grows with the sum of both velocities and is zero for two
    vessels at rest. Corrected mode is the time both discs need to pass each
    other, within limits.
    """
    return window_of_velocities(
        (speed_1, *velocity(speed_1, heading_1, mode)),
        (speed_2, *velocity(speed_2, heading_2, mode)),
        radius,
        mode,
    )


def half_window(speed: Column, radius: float, mode: str = "reference") -> Column:
    """Seconds one ping adds at most to the window of any pair it is in.

    The norm of a sum is at most the sum of norms, so the window of a pair
    never exceeds the halves of its two pings. One second more covers the
    truncation to whole seconds.
    """
    if mode == "reference":
        return F.abs(speed) * (1000.0 / radius / 3600.0 * (1 + 1e-9)) + 1.0
    return F.lit(LONGEST_WINDOW / 2 + 1.0)
