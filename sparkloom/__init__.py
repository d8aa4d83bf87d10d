"""sparkloom: a Spark-native engine for hybrid search, context retrieval and code-corpus processing."""

__version__ = "0.1.0"
