"""Text parsing as DataFrame operations on Apache Spark."""
