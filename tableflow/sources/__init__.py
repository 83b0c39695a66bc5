"""Scans: files, JDBC, Kafka, SQL text, incremental reads."""
