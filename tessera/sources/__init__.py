"""Readers, sinks and series."""
