"""Network-flow security analytics as Spark DataFrame, SQL, ML and streaming jobs."""
