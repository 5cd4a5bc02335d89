"""Operators for training data: de-duplication, scans, scoring, tokens."""
