"""Whole analyses: configuration, the preprocessing plan, the pipeline and its outputs."""
