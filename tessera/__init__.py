"""Spark-native operators for visual assembly workloads and training-data pipelines."""
