"""End-to-end flows, and the queries registered for checking."""
