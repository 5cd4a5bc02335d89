"""Geometry text and bytes: only the forms the operators read or write."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakecross.functions.naming import named

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
WKT_PAIR = rf"({NUMBER})\s+({NUMBER})"
GEOJSON_PAIR = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})"

# The bit of an EWKB type that says an SRID follows.
EWKB_SRID_BIT = 0x20000000


# Types of a walk through a WKB value: runs of points found, and where the walk stands.
RUNS = "array<struct<at: bigint, n: bigint, size: bigint, little: boolean>>"
STATE = f"struct<at: bigint, shapes: bigint, rings: bigint, size: bigint, little: boolean, runs: {RUNS}>"


def point_text(lon: Column, lat: Column) -> Column:
    """WKT of a point; x is the longitude."""
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def line_text(points: Column) -> Column:
    """WKT of a line through an array of structs with lon and lat."""
    pairs = F.transform(points, lambda p: F.concat_ws(" ", p.lon.cast("string"), p.lat.cast("string")))
    return F.concat(F.lit("LINESTRING("), F.array_join(pairs, ","), F.lit(")"))


def _numbers(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda n: n.cast("double"))


def _extent(text: Column, pattern: str) -> Column:
    xs, ys = _numbers(text, pattern, 1), _numbers(text, pattern, 2)
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def wkt_extent(text: Column) -> Column:
    """Extent of any WKT geometry as a struct of xmin, ymin, xmax, ymax."""
    return _extent(text, WKT_PAIR)


def geojson_extent(text: Column) -> Column:
    """Extent of any GeoJSON geometry as a struct of xmin, ymin, xmax, ymax."""
    return _extent(text, GEOJSON_PAIR)


def _unsigned(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def _in_order(digits: Column, size: int, little: Column) -> Column:
    """The hex digits of a number of ``size`` bytes, highest byte first, whatever the byte order they are stored in."""
    pieces = [F.substring(digits, 2 * k + 1, 2) for k in range(size)]
    return F.when(little, F.concat(*pieces[::-1])).otherwise(digits)


def _word(geometry: Column, at: Column, little: Column) -> Column:
    """Four bytes of a binary value, from byte ``at`` (counted from 1), as an unsigned number."""
    return _unsigned(_in_order(F.hex(geometry.substr(at, F.lit(4))), 4, little))


def _double(geometry: Column, at: Column, little: Column) -> Column:
    """Eight bytes of a binary value as the IEEE 754 double they hold; NULL for infinities and what is no number."""

    def value(word: Column) -> Column:
        exponent = F.shiftright(word.high, 20).bitwiseAND(F.lit(2047))
        mantissa = word.high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * float(1 << 32) + word.low
        # Below the smallest normal number there is no leading one.
        leading = F.when(exponent > 0, float(1 << 52)).otherwise(0.0)
        size = (leading + mantissa) * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1075)
        return F.when(exponent < 2047, F.when(word.high >= 1 << 31, -size).otherwise(size))

    def halves(x: Column) -> Column:
        return named(value, high=_unsigned(F.substring(x.digits, 1, 8)), low=_unsigned(F.substring(x.digits, 9, 8)))

    def ordered(x: Column) -> Column:
        return named(halves, digits=_in_order(x.digits, 8, little))

    return named(ordered, digits=F.hex(geometry.substr(at, F.lit(8))))


def double_bytes(value: Column) -> Column:
    """The eight bytes of a finite double, lowest first. NULL stays NULL; minus zero becomes zero."""

    def exact(x: Column) -> Column:
        # The logarithm can be off by one next to powers of two.
        over, under = x.size >= F.pow(F.lit(2.0), x.guess + 1), x.size < F.pow(F.lit(2.0), x.guess)
        shift = x.guess + F.when(over, 1).when(under, -1).otherwise(0)
        return named(scaled, value=x.value, size=x.size, exponent=F.greatest(shift, F.lit(-1022)))

    def scaled(x: Column) -> Column:
        # Two steps, since 2 to the power of more than 1023 is no double.
        half = F.floor(x.exponent / 2)
        whole = x.size * F.pow(F.lit(2.0), 26 - half) * F.pow(F.lit(2.0), 26 - (x.exponent - half))
        return named(packed, value=x.value, exponent=x.exponent, whole=F.coalesce(whole, F.lit(0.0)).cast("long"))

    def packed(x: Column) -> Column:
        field = F.when(x.whole >= 1 << 52, x.exponent + 1023).otherwise(0).cast("long")
        sign = F.when(x.value < 0, F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = F.shiftleft(field, 52).bitwiseOR(x.whole.bitwiseAND(F.lit((1 << 52) - 1))).bitwiseOR(sign)
        return named(lambda y: F.unhex(_in_order(y.digits, 8, F.lit(True))), digits=F.lpad(F.hex(bits), 16, "0"))

    def sized(x: Column) -> Column:
        return named(exact, value=x.value, size=F.abs(x.value), guess=F.floor(F.log2(F.when(x.value != 0, F.abs(x.value)))))

    return F.when(value.isNotNull(), named(sized, value=value))


def point_wkb(lon: Column, lat: Column, srid: int | None = None) -> Column:
    """WKB of points, lowest byte first; EWKB with a SRID."""
    if srid is None:
        head = "0101000000"
    else:
        head = "01" + (1 | EWKB_SRID_BIT).to_bytes(4, "little").hex() + srid.to_bytes(4, "little").hex()
    return F.concat(F.unhex(F.lit(head)), double_bytes(lon), double_bytes(lat))


def line_wkb(points: Column) -> Column:
    """WKB of a line through an array of structs with lon and lat, lowest byte first."""
    count = F.unhex(_in_order(F.lpad(F.hex(F.size(points)), 8, "0"), 4, F.lit(True)))
    return F.aggregate(
        points, F.concat(F.unhex(F.lit("0102000000")), count), lambda out, p: F.concat(out, double_bytes(p.lon), double_bytes(p.lat))
    )


def binary_srid(geometry: Column) -> Column:
    """SRID of a WKB or EWKB value; 0 where it carries none."""

    def read(x: Column) -> Column:
        little = F.substring(x.digits, 1, 2) == "01"
        kind, srid = (_unsigned(_in_order(F.substring(x.digits, at, 8), 4, little)) for at in (3, 11))
        return F.when(kind.bitwiseAND(F.lit(EWKB_SRID_BIT).cast("long")) != 0, srid).otherwise(F.lit(0).cast("long"))

    return named(read, digits=F.hex(F.substring(geometry, 1, 9)))


def _run(at: Column, n: Column, size: Column, little: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"), size.cast("long").alias("size"), little.alias("little"))


def _header(geometry: Column, state: Column) -> Column:
    """The state after the header of the next shape, and after its points where it is a point or a line."""
    none = F.lit(0).cast("long")

    def flags(x: Column) -> Column:
        # EWKB marks Z, M and SRID by its highest bits, ISO adds thousands for Z and M.
        plain = x.kind.bitwiseAND(F.lit(0x0FFFFFFF).cast("long"))
        iso = F.floor(plain / 1000)
        has_z = (x.kind.bitwiseAND(F.lit(0x80000000).cast("long")) != 0) | iso.isin(1, 3)
        has_m = (x.kind.bitwiseAND(F.lit(0x40000000).cast("long")) != 0) | iso.isin(2, 3)
        tagged = x.kind.bitwiseAND(F.lit(EWKB_SRID_BIT).cast("long")) != 0
        return named(
            body, little=x.little, shape=plain % 1000, at=state.at + 5 + F.when(tagged, 4).otherwise(0),
            wide=(16 + F.when(has_z, 8).otherwise(0) + F.when(has_m, 8).otherwise(0)).cast("long"),
        )

    def body(x: Column) -> Column:
        return named(after, little=x.little, shape=x.shape, at=x.at, wide=x.wide, count=_word(geometry, x.at, x.little))

    def after(x: Column) -> Column:
        # 1 point, 2 line, 3 polygon, 4 to 7 collections of shapes.
        point, line = x.shape == 1, x.shape == 2
        runs = F.when(point, F.array(_run(x.at, F.lit(1), x.wide, x.little)))
        runs = runs.when(line, F.array(_run(x.at + 4, x.count, x.wide, x.little))).otherwise(F.array().cast(RUNS))
        return F.struct(
            F.when(point, x.at + x.wide).when(line, x.at + 4 + x.count * x.wide).otherwise(x.at + 4).alias("at"),
            (state.shapes - 1 + F.when(x.shape > 3, x.count).otherwise(none)).alias("shapes"),
            F.when(x.shape == 3, x.count).otherwise(none).alias("rings"),
            x.wide.alias("size"), x.little.alias("little"), F.concat(state.runs, runs).alias("runs"),
        ).cast(STATE)

    def kind(x: Column) -> Column:
        return named(flags, little=x.little, kind=_word(geometry, state.at + 1, x.little))

    return named(kind, little=F.hex(geometry.substr(state.at, F.lit(1))) == "01")


def _ring(geometry: Column, state: Column) -> Column:
    """The state after the next run of points of a polygon."""

    def after(x: Column) -> Column:
        run = _run(state.at + 4, x.points, state.size, state.little)
        return F.struct(
            (state.at + 4 + x.points * state.size).alias("at"), state.shapes.alias("shapes"), (state.rings - 1).alias("rings"),
            state.size.alias("size"), state.little.alias("little"), F.concat(state.runs, F.array(run)).alias("runs"),
        ).cast(STATE)

    return named(after, points=_word(geometry, state.at, state.little))


def _step(geometry: Column, state: Column) -> Column:
    """Reads the next header or run of points of a WKB value.

    The state has the next byte (at), shapes still to come, runs of points of the current polygon still to
    come (rings), bytes a point (size), byte order, and the runs found.
    """
    more = (state.shapes > 0) & (state.at < F.length(geometry))
    return F.when(state.rings > 0, _ring(geometry, state)).when(more, _header(geometry, state)).otherwise(state)


def binary_extent(geometry: Column) -> Column:
    """Extent of any WKB or EWKB geometry as a struct of xmin, ymin, xmax, ymax; NULL sides where it has no points.

    Points, lines, polygons and collections of them, nested or not, with or without Z, M and SRID, in both byte orders.
    Of a value that is cut off, the points that are there count.
    """
    start = F.struct(
        F.lit(1).cast("long").alias("at"), F.lit(1).cast("long").alias("shapes"), F.lit(0).cast("long").alias("rings"),
        F.lit(16).cast("long").alias("size"), F.lit(True).alias("little"), F.array().cast(RUNS).alias("runs"),
    ).cast(STATE)
    # Every part takes four bytes at least. Most values have one; only longer ones of several are walked on.
    kind = _word(geometry, F.lit(2), F.hex(F.substring(geometry, 1, 1)) == "01").bitwiseAND(F.lit(0x0FFFFFFF).cast("long")) % 1000
    steps = F.when(kind < 3, 1).otherwise(F.greatest(F.floor(F.length(geometry) / 4), F.lit(1)))
    read = F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, lambda state, _: _step(geometry, state))

    def values(runs: Column, offset: int) -> Column:
        none = F.array().cast("array<bigint>")

        def run(r: Column) -> Column:
            # A count can promise more points than there are bytes.
            n = F.least(r.n, F.floor((F.length(geometry) - r.at + 1) / r.size))
            at = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(none)
            return F.transform(at, lambda k: _double(geometry, r.at + k * r.size + offset, r.little))

        return F.flatten(F.transform(runs, run))

    def sides(p: Column) -> Column:
        return F.struct(
            F.array_min(p.xs).alias("xmin"), F.array_min(p.ys).alias("ymin"), F.array_max(p.xs).alias("xmax"), F.array_max(p.ys).alias("ymax")
        )

    box = named(lambda x: named(sides, xs=values(x.runs, 0), ys=values(x.runs, 8)), runs=read.runs)
    return F.when(geometry.isNotNull(), box)
