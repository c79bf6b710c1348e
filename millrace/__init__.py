"""millrace: a Spark-native engine for feedback-driven curation of text datasets."""

__version__ = "0.1.0"
