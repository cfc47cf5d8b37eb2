"""A Spark-native engine for change data: filter, route, map, compact, apply, merge and verify."""
