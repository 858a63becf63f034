"""Evidence correlation, entity resolution and corpus preparation on PySpark."""

__version__ = "0.1.0"
