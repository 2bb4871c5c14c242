"""Spark-native reconciliation of scanned-document lots with tabular manifests."""
