"""Query plans: how operators combine, and the queries registered for the driver."""
