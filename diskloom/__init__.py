"""Spark-native analytics over sector-level floppy-disk images."""
