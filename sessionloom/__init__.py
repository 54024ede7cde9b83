"""Spark-native analytics over semi-structured agent session transcripts."""
