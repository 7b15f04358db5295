"""Spark-native analytics over sensor frames, with DataFrame operators, sources, metrics and streaming folds."""
