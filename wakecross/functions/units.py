"""Fixed values shared by the operators, with their units."""

# One metre in degrees at the equator, and the radii built on it.
ONE_METRE = 0.00001 - 0.000001
HARBOUR_RADIUS = 10 * 1000 * ONE_METRE
PING_RADIUS = 100 * ONE_METRE
LINE_RADIUS = 200 * ONE_METRE

# Grid levels that stand in for the ~174 m hexagon grid, and a
# coarser one on which buffered lines meet.
PING_LEVEL = 17
LINE_LEVEL = 14

# Knots to km/h, tumbling window of a trajectory, area cap (m2).
KNOT_KMPH = 1.852
TRAJECTORY_WINDOW = "15 minutes"
AREA_CAP = 1e9

# Metres in one degree of latitude or of the equator, for areas.
DEGREE_METRES = 111_320.0
