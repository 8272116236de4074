"""lumenspark: learning-analytics and data-processing operators written as Spark plans."""

__version__ = "0.1.0"
