"""Case-log analytics on Spark: sources, operators, plans and sinks over DataFrames."""

__version__ = "0.1.0"
