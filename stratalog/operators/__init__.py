"""Operators on logs, sorted files, levels, value logs, manifests and access streams."""
