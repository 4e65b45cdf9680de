"""Change-history mining and bug-fix classification as Spark jobs."""
