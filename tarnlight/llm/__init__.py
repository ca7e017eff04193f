"""Operators for preparing training text: packing, counting, filtering, joining and writing documents."""
