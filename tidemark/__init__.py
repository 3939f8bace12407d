"""Spark-first analytics over bars, ticks, orders and positions."""

__version__ = "0.1.0"
