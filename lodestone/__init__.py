"""A Spark-native engine for updatable nearest-neighbour search over dense vectors."""
