"""Change-stream replication and analytics as Spark DataFrame transformations."""
