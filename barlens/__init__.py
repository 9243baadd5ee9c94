"""Market-bar signals, point-in-time evaluation and event evidence as Spark jobs."""
