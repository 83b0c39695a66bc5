"""Sinks: delimited files, versioned and partitioned tables, JDBC."""
