"""PySpark-native analytics over versioned documents, evidence graphs and training corpora."""
