"""Spark-native file triage and corpus analytics."""
