"""Plans over several operators, and the catalog of queries with their SQL."""
