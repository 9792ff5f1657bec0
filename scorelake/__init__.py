"""scorelake: a PySpark-native analytics engine for credit-risk and scorecard work."""

__version__ = "0.1.0"
