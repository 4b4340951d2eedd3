"""Spark-native image-formation and detector-robustness analytics."""
