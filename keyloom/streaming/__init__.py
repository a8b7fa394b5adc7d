"""Snapshots maintained from streams."""
