"""A Spark-native engine for annotation analytics: scan, profile, score, select, export and report."""
