"""loomwright: Spark-native document, retrieval and training-data analytics."""
