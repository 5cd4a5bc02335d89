"""Geodesic size of an extent on the WGS84 ellipsoid, and the map zoom for a size."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakecross.functions.naming import named

# WGS84 semi-major axis in metres and flattening.
SEMI_MAJOR = 6_378_137.0
FLATTENING = 1 / 298.257223563
ECCENTRICITY_2 = FLATTENING * (2 - FLATTENING)

# The largest extent in metres, exclusive, for zoom levels 18 to
# 1: the height of eight map tiles.
ZOOM_METRES = [
    (18, 21.2 * 8),
    (17, 42.3 * 8),
    (16, 84.6 * 8),
    (15, 169 * 8),
    (14, 339 * 8),
    (13, 677 * 8),
    (12, 1.35 * 1000 * 8),
    (11, 2.7 * 1000 * 8),
    (10, 5.4 * 1000 * 8),
    (9, 10.8 * 1000 * 8),
    (8, 21.7 * 1000 * 8),
    (7, 43.3 * 1000 * 8),
    (6, 86.7 * 1000 * 8),
    (5, 173 * 1000 * 8),
    (4, 347 * 1000 * 8),
    (3, 693 * 1000 * 8),
    (2, 1387 * 1000 * 8),
    (1, 2773 * 1000 * 8),
]

# Intervals of the Simpson rule along a meridian; even.
MERIDIAN_STEPS = 16


# Fixed value: from the equator to a pole along a meridian.
QUARTER_METRES = 10_001_965.729_312_7

# Rounds of the geodesic's fixed-point iteration. Each gains two digits or more, except near opposite points of the globe.
GEODESIC_ROUNDS = 24


def geodesic_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of the shortest line between two points on the ellipsoid, after Vincenty's inverse formula.

    The difference in longitude on the auxiliary sphere is iterated a fixed number of times, as a fold over a
    state, and the length follows from the last one. Name the result with ``let`` where it is used more than once. Near opposite points of the globe the
    iteration does not settle; the way over the nearer pole, at most 0.2 percent longer, stands for it there.
    """
    minor = SEMI_MAJOR * (1 - FLATTENING)
    zero, one = F.lit(0.0), F.lit(1.0)
    # The way around the globe that is shorter.
    turn = F.radians(lon2 - lon1)
    turn = turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi))
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    fixed = F.struct(
        turn.alias("turn"), (F.sin(u1) * F.sin(u2)).alias("ss"), (F.cos(u1) * F.cos(u2)).alias("cc"),
        (F.cos(u1) * F.sin(u2)).alias("cs"), (F.sin(u1) * F.cos(u2)).alias("sc"), F.cos(u2).alias("c2"),
    )

    def arc(known: Column, at: Column) -> dict[str, Column]:
        """Sine, cosine and size of the arc, and the azimuth's and the midpoint's cosines."""
        across, along = known.c2 * F.sin(at), known.cs - known.sc * F.cos(at)
        sine = F.sqrt(across * across + along * along)
        cosine = known.ss + known.cc * F.cos(at)
        azimuth = F.coalesce(known.cc * F.sin(at) / F.nullif(sine, zero), zero)
        squared = one - azimuth * azimuth
        middle = F.coalesce(cosine - 2.0 * known.ss / F.nullif(squared, zero), zero)
        return {"sine": sine, "cosine": cosine, "size": F.atan2(sine, cosine), "azimuth": azimuth, "squared": squared, "middle": middle}

    def step(state: Column, _: Column) -> Column:
        known, at = state.known, state.at
        following = named(lambda x: _next(known, x), **arc(known, at))
        return named(lambda x: F.struct(known.alias("known"), x.at.alias("at"), F.abs(x.at - at).alias("moved")), at=following)

    def _next(known: Column, x: Column) -> Column:
        c = FLATTENING / 16 * x.squared * (4.0 + FLATTENING * (4.0 - 3.0 * x.squared))
        inner = x.middle + c * x.cosine * (2.0 * x.middle * x.middle - 1.0)
        return known.turn + (one - c) * FLATTENING * x.azimuth * (x.size + c * x.sine * inner)

    def length(state: Column) -> Column:
        return named(_metres, **arc(state.known, state.at))

    def _metres(x: Column) -> Column:
        u = x.squared * (SEMI_MAJOR**2 - minor**2) / minor**2
        a = 1.0 + u / 16384.0 * (4096.0 + u * (u * (320.0 - 175.0 * u) - 768.0))
        b = u / 1024.0 * (256.0 + u * (u * (74.0 - 47.0 * u) - 128.0))
        m = x.middle * x.middle
        change = b * x.sine * (
            x.middle + b / 4.0 * (x.cosine * (2.0 * m - 1.0) - b / 6.0 * x.middle * (4.0 * x.sine * x.sine - 3.0) * (4.0 * m - 3.0))
        )
        return minor * a * (x.size - change)

    start = F.struct(fixed.alias("known"), turn.alias("at"), zero.alias("moved"))
    settled = F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_ROUNDS)), start, step, lambda s: F.when(s.moved < 1e-11, length(s)))
    # Over the nearer pole, by both points' ways from the equator.
    over = 2 * QUARTER_METRES - F.abs(meridian_metres(zero, lat1) + meridian_metres(zero, lat2))
    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(known, F.coalesce(settled, over))


def meridian_metres(south: Column, north: Column) -> Column:
    """Length of the arc of a meridian."""
    step = (north - south) / MERIDIAN_STEPS

    def added(total: Column, k: Column) -> Column:
        sine = F.sin(F.radians(south + k * step))
        ends = (k == 0) | (k == MERIDIAN_STEPS)
        weight = F.when(ends, 1.0).otherwise(2.0 + 2.0 * (k % 2))
        return total + weight / F.pow(1.0 - ECCENTRICITY_2 * sine * sine, F.lit(1.5))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(MERIDIAN_STEPS)), F.lit(0.0), added)
    return SEMI_MAJOR * (1.0 - ECCENTRICITY_2) * F.radians(step) / 3.0 * total


def zoom_level(metres: Column) -> Column:
    """Map zoom at which an extent of this size fills the view; 0 for the largest."""
    zoom = F.lit(0)
    for level, limit in ZOOM_METRES[::-1]:
        zoom = F.when(metres < limit, level).otherwise(zoom)
    return zoom
