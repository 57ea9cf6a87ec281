"""Oblong: a PySpark engine for tables of axis-aligned layouts and the experiments run on them."""

__version__ = "0.1.0"
