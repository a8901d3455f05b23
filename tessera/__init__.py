"""Tessera: PySpark-native analytics over large corpora of nested vulnerability records."""
