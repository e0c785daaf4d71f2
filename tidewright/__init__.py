"""Spark-native funnel analytics, record refinement and corpus preparation."""
