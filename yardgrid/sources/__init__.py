"""Readers of the input files and the stage tables."""
