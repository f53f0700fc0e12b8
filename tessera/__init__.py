"""Tessera: a PySpark-native engine for document corpora and operational logs."""
