"""Event-log scoring and slice analytics on Spark, declared as DataFrame plans."""

__version__ = "0.2.0"
