"""Derived layouts, versioned snapshots and the typed CSV format."""
