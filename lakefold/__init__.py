"""lakefold: retrieval, ranking, audit and training-data operators as PySpark DataFrame transformations."""

__version__ = "0.1.0"
