"""A Spark-first engine for auditing agent trajectories and curating training corpora."""
