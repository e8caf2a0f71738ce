"""A Spark-first engine for evidence retrieval and its diagnosis."""
