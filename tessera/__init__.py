"""PySpark-native temporal knowledge-graph retrieval and analytics."""
