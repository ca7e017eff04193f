"""Profiling over streams."""
