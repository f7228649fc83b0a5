"""graphloom: Spark-native building of typed, provenance-tracked knowledge graphs."""

__version__ = "0.1.0"
