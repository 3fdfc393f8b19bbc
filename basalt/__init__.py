"""basalt: a relational analytics engine that is written for Spark from the start."""
