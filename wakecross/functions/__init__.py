"""Column functions: grid, geometry, motion, map scale, geometry text."""
