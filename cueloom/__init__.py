"""A Spark-native engine for narration and caption timelines."""
