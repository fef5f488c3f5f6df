"""Spark-native engine for contact-guided genome scaffolding."""
