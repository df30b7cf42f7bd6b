"""Spark-native analytics for multichannel signals and for text corpora."""
