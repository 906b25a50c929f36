"""Spark-native snapshot analytics: files and texts in, typed and fingerprinted snapshots out."""
