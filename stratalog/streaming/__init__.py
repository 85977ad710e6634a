"""Logs fed by streams."""
