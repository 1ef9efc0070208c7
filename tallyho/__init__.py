"""tallyho: tabular preparation, profiling and model-metrics operators on Spark."""

__version__ = "0.1.0"
