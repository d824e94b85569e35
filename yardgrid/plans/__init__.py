"""Whole runs: the weekly stages, the given tables as tracking data, and the query catalogue."""
