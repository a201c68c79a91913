"""Query plans: stand-in tables, queries, SQL."""
