"""lakeseek: feature discovery and data processing over a data lake, on Spark."""

__version__ = "0.1.0"
