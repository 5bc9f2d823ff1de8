"""millrace: a Spark-native retrieval, knowledge-graph and training-data engine."""

__version__ = "0.1.0"
