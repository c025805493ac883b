"""Composite algorithms: driver loops over DataFrame jobs that keep scalars and centre sets only."""
