"""Versioned key-value logs as Spark DataFrames.

A log is rows ``(key, seq, value)``: for equal keys the highest seq is the latest.
Sorted files, levels, value logs, manifests and garbage collection are ordinary tables
and the questions about them DataFrame queries.
"""
