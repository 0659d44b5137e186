"""evalspark: score analytics agents at table scale with Spark DataFrames."""

__version__ = "0.1.0"
