"""Training-data pipeline operators; nothing outside this package imports it."""
