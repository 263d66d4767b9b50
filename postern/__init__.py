"""A Spark-native engine for message evidence: parse once, then every fact is a DataFrame."""
