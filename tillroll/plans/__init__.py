"""End-to-end plans: the query registry, its SQL oracle and the staged workflow."""
