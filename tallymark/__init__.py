"""Spark-native settlement reconciliation and period-close analytics."""
