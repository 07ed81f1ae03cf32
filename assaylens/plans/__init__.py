"""Role mapping onto the given tables, end-to-end flows and the query registry."""
