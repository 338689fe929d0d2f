"""threadloom: a PySpark-native engine for conversation history, retrieval and corpus preparation."""
