"""Keyed DataFrame operators: de-duplication, gap filling, window frames, series."""
