"""Configurable batch and streaming data pipelines on Spark."""
