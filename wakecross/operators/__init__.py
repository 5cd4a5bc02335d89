"""Operators over DataFrames of pings, trajectories, harbours and encounters."""
