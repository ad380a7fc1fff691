"""noetik: a knowledge-analytics engine on PySpark DataFrames."""

__version__ = "0.1.0"
