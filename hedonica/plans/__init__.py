"""The analysis put together: stage tables, registered queries, check queries."""
