"""SQL front end, plan explanation and the catalogue of queries."""
