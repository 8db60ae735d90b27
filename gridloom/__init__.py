"""gridloom: a Spark-native engine that turns messy grids into tidy tables."""

__version__ = "0.1.0"
