"""A PySpark-native engine for tool output, usage records, code graphs, sensitive data and agent memory."""
