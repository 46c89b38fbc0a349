"""mentia: a Spark-native engine for monitoring what is said about brands, products and people."""

__version__ = "0.1.0"
