"""Time-lapse image analytics and observation-series operators on Spark DataFrames."""

__version__ = "0.1.0"
