"""Tessera: a Spark-native property-graph analytics engine."""
