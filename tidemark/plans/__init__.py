"""Schema descriptions that plans are built from, and the catalogue of queries."""
