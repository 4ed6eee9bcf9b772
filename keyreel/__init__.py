"""Spark-native analytics over keyframe, speech, screen-text and vector tables."""
