"""The checks, each a Spark plan and a verdict on it."""
