"""Column expressions: sun and sky, and the calendar. No UDFs."""
