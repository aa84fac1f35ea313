"""Queries: operators put together over the driver's tables, with the SQL each is checked against."""
