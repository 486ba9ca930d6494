"""millrace: feature engineering and warehouse loading, expressed as Spark plans."""

__version__ = "0.1.0"
