"""A Spark-native engine for dataflow-style data mining."""
