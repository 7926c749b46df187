"""Inkwell: document overlap, writing analytics and corpus preparation on Apache Spark."""
