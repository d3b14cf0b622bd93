"""Plans: end-to-end runs over a tree, fixtures from the test tables, the
registered queries and their DuckDB oracles."""
