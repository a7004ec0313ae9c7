"""Column-level expressions: hydrology, alert rules, geography, text and time."""
