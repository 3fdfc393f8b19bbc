"""Plans: the SQL dialect, the bulk operator tree, the console and the registry of queries."""
