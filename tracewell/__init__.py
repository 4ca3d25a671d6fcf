"""Spark-native analytics over transaction ledgers: detection, scoring and investigation as DataFrame programs."""
