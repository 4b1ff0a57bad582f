"""Column -> Column expressions; every one stays inside Catalyst unless noted."""
