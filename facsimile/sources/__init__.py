"""Inputs and sinks: the contracts table, tagged multi-source load, files."""
